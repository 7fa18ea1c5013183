"""Personal data: formats, and candidates judged by boosted trees.

Four formats (email, ip, card, phone) are always reported.  Beside them, generators of high recall propose
spans that may overlap, of one kind too; boosted trees score each by its format and the words before it; a
calibrated threshold for each kind selects, and of selected spans that overlap the best stays.  DataFrame functions
only; the trees are fitted on the driver from made-up examples, SAMPLE for each kind, and run as one SQL expression.

Texts are searched where they are; then candidates are rows of a few numbers and short strings, scored and sorted
out by windows over the candidates of a text.  Work is near linear in the matches of a text, too.

Patterns avoid repeated groups that Java's matcher follows by recursion: a repeated group is one character wide
here, so that texts of any length can be matched.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Boosted, fit, threshold
from .common import staged, text_of

LOCAL = "A-Za-z0-9._%+-"
#: Formats.  Starts are where a leftmost match can start: at a run's first character or where the last match ended.
FORMATS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]+\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:(?!\x20(?![0-9]))(?!-(?![0-9]))[0-9\x20-])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs for a format or generator to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# fixed values: how addresses are spelt out in English, French, Spanish and German
AT, DOT = r"(?:at|arobase|arroba|klammeraffe)", r"(?:dot|point|punto|punkt)"
#: Generators: kind, what the text needs, pattern.  Those of one kind may propose overlapping spans.
GENERATORS = (
    ("email", rf"(?i)[\[({{<] ?(?:{AT}|@|{DOT}|\.) ?[\])}}>]", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}} ?(?:[\[({{<] ?(?:{AT}|@) ?[\])}}>]|@|{AT}) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:[\[({{<] ?(?:{DOT}|\.) ?[\])}}>]|\.|\b{DOT}\b) ?[A-Za-z][A-Za-z0-9-]{{0,62}}){{1,4}}(?![A-Za-z0-9])"),
    ("email", rf"(?i) {AT} \S+ {DOT} ", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}} {AT} [A-Za-z0-9-]{{1,63}}(?: {DOT} [A-Za-z][A-Za-z0-9-]{{0,62}}){{1,4}}(?![A-Za-z0-9])"),
    ("ip", "[0-9A-Fa-f:]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![0-9A-Za-z:])"),
    ("ip", "::[0-9A-Fa-f]", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){0,6}:[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])"),
    ("card", "[0-9]{4}", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("card", r"[0-9]{4}[ ./-][0-9]{4}", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./-][0-9]{4}){3}(?![0-9A-Za-z])"),
    ("phone", "[0-9]{2}", r"(?<![0-9A-Za-z+.-])[(]?[0-9][0-9() ./-]{5,17}[0-9](?![0-9A-Za-z-])"),
    ("phone", r"\b0[0-9]", r"(?<![0-9A-Za-z+./-])0[0-9]{1,4}(?:[ ./-][0-9]{2,8}){1,4}(?![0-9A-Za-z-])"),
    ("secret", "[A-Za-z0-9+/_-]{20}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"),
    ("secret", r"(?i)(?:token|key|secret|passw|api|bearer|auth)\w* ?[=:]", r"(?<==|= |: |=\"|= \"|: \")[A-Za-z0-9!#$%&*+,./?@^_~-]{12,128}(?=[\"\s]|$)"),
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
)
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
WORDS = {
    "email": "mail|contact|write to|reach|correo|schreib|écri",
    "ip": r"\bip\b|host|server|address|client|adresse|servidor",
    "card": "card|visa|credit|karte|tarjeta|carte|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|tél|dial|anruf|appel|llam",
    "secret": "token|key|secret|passw|api|bearer|auth",
    "iban": "iban|account|konto|cuenta|compte|bank|banque|banco",
}
CONTEXT = 24
#: Made-up examples for each kind, and the precision that thresholds must reach on as many others.
SAMPLE, PRECISION = 300, 0.98
NAMES = ["kind", "n", "digits", "letters", "upper", "marks", "groups", "distinct", "luhn", "hexa", "words", "assigned", "double", "brackets", "spelt", "domain", "mod97", "zero"]
SPELT, DOMAIN = rf"(?i)\b{DOT}\b", r"(?i)\b(?:com|org|net|edu|gov|info|biz|io|co|eu|uk|us|de|at|ch|fr|be|es|mx)$"
ACCOUNT = r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{8,30}$"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return bool(digits) and total % 10 == 0


def mod97(span: str) -> bool:
    """Whether the check digits of an account number fit."""
    x = span.replace(" ", "")
    return re.search(ACCOUNT, x) is not None and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def features(kind: int, span: str, before: str) -> list[float]:
    """The numbers NAMES of one span in plain Python, for fitting."""
    digits = re.sub(r"[^0-9]", "", span)
    return [
        kind,
        len(span),
        len(digits),
        len(re.sub(r"[^A-Za-z]", "", span)),
        len(re.sub(r"[^A-Z]", "", span)),
        len(re.sub(r"[^ ().:-]", "", span)),
        len(re.findall(r"[0-9]+", span)),
        len(set(span)),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(re.search(r"^[0-9A-Fa-f]+$", span) is not None),
        float(re.search(WORDS[KINDS[kind]], before.lower()) is not None),
        float(re.search(r"[=:] ?[\"']?$", before) is not None),
        float("::" in span),
        float(re.search(r"[\[({<]", span) is not None),
        float(re.search(SPELT, span) is not None),
        float(re.search(DOMAIN, span) is not None),
        float(mod97(span)),
        float(re.search(r"^\(?0", span) is not None),
    ]


def _mod97(span: Column) -> Column:
    x = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: ((a * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.when(x.rlike(ACCOUNT), rest == 1).otherwise(False)


def _feature_columns(kind: Column, said: Column, span: Column, before: Column) -> list[Column]:
    digits = F.regexp_replace(span, r"[^0-9]", "")
    count = lambda pattern: F.length(F.regexp_replace(span, pattern, ""))
    out = [
        kind,
        F.length(span),
        F.length(digits),
        count(r"[^A-Za-z]"),
        count(r"[^A-Z]"),
        count(r"[^ ().:-]"),
        F.regexp_count(span, F.lit(r"[0-9]+")),
        F.size(F.array_distinct(F.split(span, ""))),
        F.length(digits).between(12, 19) & F.call_function("luhn_check", digits),
        span.rlike(r"^[0-9A-Fa-f]+$"),
        said,
        before.rlike(r"[=:] ?[\"']?$"),
        F.contains(span, F.lit("::")),
        span.rlike(r"[\[({<]"),
        span.rlike(SPELT),
        span.rlike(DOMAIN),
        _mod97(span),
        span.rlike(r"^\(?0"),
    ]
    return [c.cast("double") for c in out]


def feature_columns(kind: int, span: Column, before: Column) -> list[Column]:
    """The same as Columns."""
    return _feature_columns(F.lit(kind), F.lower(before).rlike(WORDS[KINDS[kind]]), span, before)


def examples(seed: int, each: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Made-up spans of each kind with the words before them: half of them personal data, half look-alikes."""
    r = random.Random(seed)
    pick, some = r.choice, lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a=2, b=9: "".join(r.choice("aeiourstnlmdcp") for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(5)) + " "
    hexa = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
    lead = {
        "email": ["contact ", "mail: ", "write to "],
        "ip": ["host ", "server ", "ip "],
        "card": ["card ", "visa: ", "credit card number "],
        "phone": ["call ", "phone: ", "tel. "],
        "secret": ['token = "', "api_key=", 'secret: "'],
        "iban": ["IBAN ", "Konto: ", "account "],
    }
    at, dot = ["at", "arobase", "arroba", "klammeraffe"], ["dot", "point", "punto", "punkt"]
    end = lambda: pick(["com", "org", "net", "de", "fr", "es", "co", "info"])

    def valid(n: int) -> str:
        head = pick("3456") + some(n - 2)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def spaced(x: str, mark: str) -> str:
        return mark.join(x[k : k + 4] for k in range(0, len(x), 4))

    def account() -> str:
        land, body = pick(["DE", "FR", "ES", "GB", "NL", "AT"]), some(r.choice([16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{check:02d}{body}"

    def yes(kind: str) -> str:
        if kind == "email":
            k = r.randrange(4)
            a, b = at[k], dot[k]
            marks = pick([f"({a})|({b})", f"[{a}]|[{b}]", f" ({a}) | ({b}) ", f" {a} | {b} ", f"{{{a}}}|.", f" [@] |.", f" {a} | ({b}) "]).split("|")
            return f"{word()}{pick(['.', '_', ''])}{word()}{marks[0]}{word(3)}{marks[1]}{end()}"
        if kind == "ip":
            if r.random() < 0.5:
                return ":".join("%x" % r.randrange(65536) for _ in range(8))
            return ":".join("%x" % r.randrange(256, 65536) for _ in range(r.randint(1, 4))) + "::" + ":".join("%x" % r.randrange(65536) for _ in range(r.randint(1, 2)))
        if kind == "card":
            return spaced(valid(16), pick([".", "/", "", " ", "-"]))
        if kind == "phone":
            return pick(
                [f"({some(3)}) {some(3)}-{some(4)}", f"{some(3)}-{some(3)}-{some(4)}", f"0{some(3)} {some(7)}", f"{some(3)}.{some(3)}.{some(4)}", f"0{some(2)}/{some(7)}"]
                + [f"0{some(1)} " + " ".join(some(2) for _ in range(4)), f"0{some(3)}-{some(7)}", f"9{some(2)} {some(3)} {some(3)}"]
            )
        if kind == "iban":
            return pick([account(), spaced(account(), " ")])
        return hexa(pick([32, 40, 64])) if r.random() < 0.6 else "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(r.randint(24, 44)))

    def no(kind: str) -> str:
        if kind == "email":
            k = r.randrange(4)
            return pick([f"{word()} {at[k]} {word()} {dot[k]} {word()}", f"{word()} at the ({dot[k]}) {word()}", f"{word()} {at[k]} {word()} {dot[k]} {word(4)} {dot[k]} {word()}", f"{word()} at {word()}.{word(6)}"])
        if kind == "ip":
            return pick([":".join(some(2) for _ in range(r.randint(3, 5))), f"{some(2)}:{some(2)}:{some(2)}", "::" + hexa(1), f"{hexa(2)}::{word(4, 4)[:1]}", f"{some(1)}:{some(2)}:{some(3)}"])
        if kind == "card":
            x = pick([some(r.randint(13, 19)), spaced(some(16), pick([".", "/", "", " ", "-"]))])
            return x if not luhn(re.sub("[^0-9]", "", x)) else "1234567890123"
        if kind == "phone":
            return pick(
                [f"20{some(2)}-{pick(['01', '07', '12'])}-{pick(['05', '17', '28'])}", f"19{some(2)} - 20{some(2)}", some(7), some(8), f"{some(2)}.{some(2)}.{some(4)}", f"{some(1)}.{some(7)}"]
                + [f"{some(4)} {some(4)}", some(16), f"978-{some(1)}-{some(2)}-{some(6)}", f"{pick(['01', '07', '12'])}/{pick(['05', '17', '28'])}/20{some(2)}", f"1{some(2)} {some(3)} {some(3)} {some(3)}", some(13)]
            )
        if kind == "iban":
            x = pick(["AB", "NO", "ID", "DE", "FR"]) + some(2) + pick([some(16), hexa(16).upper(), some(8)])
            return x if not mod97(x) else "XX00" + some(12)
        return pick(
            [word(20, 30), "-".join(word(3, 8) for _ in range(5)), "/".join(word(4, 9) for _ in range(5)), "_" * r.randint(20, 40), "a" * r.randint(20, 30), word(9, 12) + "-" + word(9, 12) + some(2), f"{word(6)}.{word(6)}/{word()}"]
            + [f"https://{word()}.com/{word(6)}/{word(6)}"[6:], some(r.randint(20, 24))]
        )

    rows, truth = [], []
    for k, kind in enumerate(KINDS):
        for m in range(each):
            label = m % 2
            span = yes(kind) if label else no(kind)
            near = r.random() < (0.7 if label else 0.03)
            if kind == "phone" and label and not near and r.random() < 0.5:
                near = True
            before = prose() + (pick(lead[kind]) if near else "")
            rows.append(features(k, span, before[-CONTEXT:]))
            truth.append(label)
    return np.array(rows, float), np.array(truth, float)


@lru_cache(maxsize=1)
def judge() -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the log-odds (0 at least) from which on spans are selected."""
    model = fit(*examples(1), NAMES)
    x, y = examples(2)
    score = model.score(x)
    return model, {kind: max(0.0, threshold(score[x[:, 0] == k], y[x[:, 0] == k], PRECISION)) for k, kind in enumerate(KINDS)}


def let(value: Column, use) -> Column:
    """``use(value)``, the value worked out once."""
    return F.transform(F.array(value), use)[0]


def before_each(sizes: Column) -> Column:
    """The sum of what stands before each element, in two levels: arrays that grow by appending have about the square root of its length."""
    none = F.array().cast("array<int>")
    grown = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    running = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), grown, lambda a: a["out"])
    whole = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def cut(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), (F.greatest(F.size(xs), F.lit(1)) - 1).cast("int"), width), lambda at: F.slice(xs, at + 1, width))

    return let(sizes, lambda xs: let(cut(xs), lambda parts: F.flatten(F.zip_with(parts, running(F.transform(parts, whole), F.lit(0)), running))))


def found(text: Column, pattern: str, needs: str, entry) -> Column:
    """Leftmost non-overlapping matches as an array of entry(span, start, end, text before): the gaps between matches tell their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = lambda ms: F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(ms), F.lit(1)))
    pairs = let(matches, lambda ms: F.filter(F.zip_with(ms, gaps(ms), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.right(g, F.lit(CONTEXT)).alias("b"))), lambda p: p["m"].isNotNull()))
    spans = let(
        pairs,
        lambda ps: F.zip_with(ps, before_each(F.transform(ps, lambda p: p["g"] + F.length(p["m"]))), lambda p, at: entry(p["m"], at + p["g"], at + p["g"] + F.length(p["m"]), p["b"])),
    )
    none = F.array().cast("array<struct<m:string,s:int,b:string>>")
    return F.when(text.rlike(needs), spans).otherwise(F.transform(none, lambda p: entry(p["m"], p["s"], p["s"], p["b"])))


def _holds(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "ip":
        return span.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def personal_data(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``formats`` and ``spans`` for each row: arrays of (order, start, end, kind) by kind, then start; code points, end exclusive.

    ``formats``: matches of the four formats.  ``spans``: these and the selected candidates that overlap none of
    them; of candidates that overlap, the one of highest odds, then of the first kind, start and longest, stays.
    Null and empty texts have none; each row is by itself, so ties, repeated rows and other columns play no part.
    """
    model, least = judge()
    value = text_of("__text")
    own = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*own, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__r"))
    mark = lambda k, kind: lambda m, s, e, b: F.struct(F.lit(k).alias("k"), s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"), m.alias("m"))
    bare = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    full = lambda k: lambda m, s, e, b: F.struct(F.lit(k).alias("k"), s.alias("s"), e.alias("e"), m.alias("m"), b.alias("b"))

    def reported(k: int, kind: str, pattern: str) -> Column:
        return F.transform(F.filter(found(value, pattern, NEEDS[kind], mark(k, kind)), lambda x: _holds(kind, x["m"])), bare)

    formats = F.concat(*[reported(k, kind, pattern) for k, (kind, pattern) in enumerate(FORMATS.items())])
    candidates = F.concat(*[found(value, pattern, needs, full(KINDS.index(kind))) for kind, needs, pattern in GENERATORS])
    rows = staged(rows.select(*[f"__k{i}" for i in range(len(keep))], "__r", formats.alias("formats"), candidates.alias("candidates")), "pii-candidates")
    some = rows.where(F.size("candidates") > 0)
    flat = some.select("__r", F.explode("candidates").alias("x")).select("__r", "x.*").distinct()
    by_kind = lambda value_: F.element_at(F.array(*[value_(kind) for kind in KINDS]), F.col("k") + 1)
    said = F.lit(False)
    for k, kind in enumerate(KINDS):
        said = F.when(F.col("k") == k, F.lower("b").rlike(WORDS[kind])).otherwise(said)
    # one of one: the optimizer moves no filter below an explode, else it would work out the features anew for each tree
    once = lambda value_: F.explode(F.array(value_))
    features_ = F.struct(*[c.alias(f"x{i}") for i, c in enumerate(_feature_columns(F.col("k"), said, F.col("m"), F.col("b")))])
    measured = flat.select("__r", "k", "s", "e", once(features_).alias("x")).select("__r", "k", "s", "e", "x.*")
    scored = measured.select("__r", "k", "s", "e", once(F.expr(model.sql(lambda name: f"x{NAMES.index(name)}"))).alias("odds"))
    scored = scored.where(F.col("odds") >= by_kind(lambda kind: F.lit(float(least[kind]))))
    # formats and candidates of a text by their starts: what reaches over a candidate's start, and what starts before its end
    base = some.select("__r", F.explode("formats").alias("x")).select("__r", "x.k", "x.s", "x.e", F.lit(None).cast("double").alias("odds"))
    both = base.unionByName(scored).withColumn("own", F.col("odds").isNull())
    upwards = Window.partitionBy("__r").orderBy("s", F.col("own").desc())
    downwards = Window.partitionBy("__r").orderBy(F.col("s").desc(), "own")
    both = both.withColumn("over", F.max(F.when(F.col("own"), F.col("e"))).over(upwards.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next", F.min(F.when(F.col("own"), F.col("s"))).over(downwards.rowsBetween(Window.unboundedPreceding, 0)))
    free = both.where(~F.col("own") & ~(F.coalesce(F.col("over") > F.col("s"), F.lit(False)) | F.coalesce(F.col("next") < F.col("e"), F.lit(False))))
    # candidates that overlap one another are an island; in each the best stays, then the best of those apart from it
    by_start = Window.partitionBy("__r").orderBy("s", "e", "k", "odds")
    free = free.withColumn("reach", F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    free = free.withColumn("island", F.sum(F.when(F.col("reach") > F.col("s"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct((-F.col("odds")).alias("worse"), "k", "s", (-F.col("e")).alias("until"), "e")
    islands = free.groupBy("__r", "island").agg(F.array_sort(F.collect_list(order)).alias("xs"))
    apart = lambda x, y: (x["e"] <= y["s"]) | (y["e"] <= x["s"])
    none = F.slice("xs", 1, 0)
    best = F.aggregate("xs", none, lambda a, x: F.when(F.forall(a, lambda y: apart(x, y)), F.concat(a, F.array(x))).otherwise(a))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    more = islands.select("__r", F.explode(best).alias("x")).groupBy("__r").agg(F.collect_list(F.struct("x.k", "x.s", "x.e", F.element_at(kinds, F.col("x.k") + 1).alias("kind"))).alias("more"))
    spans = F.array_sort(F.concat("formats", F.coalesce("more", F.slice("formats", 1, 0))))
    return rows.join(more, "__r", "left").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "formats", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as <kind>; of overlapping spans, what the earlier one has covered is not written twice."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    out = F.aggregate(
        order,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda a, x: F.when(x["s"] < a["at"], F.struct(a["t"].alias("t"), F.greatest(a["at"], x["e"]).alias("at"))).otherwise(
            F.struct(F.concat(a["t"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("t"), x["e"].alias("at"))
        ),
    )
    return F.concat(out["t"], F.substring(text, out["at"] + 1, F.length(text)))
