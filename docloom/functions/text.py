"""Text functions: Column -> Column, all of them built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params

# fixed values: letters that scans confuse, and the patterns of references, noise and plans
LATIN, CYRILLIC = "AaBEeKkMHOoPpCcTXxYy", "АаВЕеКкМНОоРрСсТХхУу"
BREAK = r"(?U)(?:\n+|(?<=\.)\s+)"
CITATION = (
    r"(?iU)(?:^\s*\d{1,3}[\).\]]\s+)"
    r"|(?:\b(et\s*al\.?|еt\s*аl\.?)\b)"
    r"|(?:\bdoi[:\s/]|10\.\d{3,9}/\S+)"
    r"|(?:\bEpub\b|\bPublished\b|\bRetrieved\b)"
    r"|(?:\b\d{4}\b\s*;\s*\d{1,4}\s*(?:\(\d{1,4}\))?\s*:\s*\d{1,5}(?:[-–]\d{1,5})?)"
)
LOOSE_CITATION = r"(?iU)(?:^\s*\d{1,3}[\).\]]\s+|et\s*al\.?|doi[:\s/]|10\.\d{3,9}/\S+|\b\d{4}\b\s*;\s*\d+)"
HEADER = r"(?imU)^\s*(?:спис[оo]к\s+литератур[аы]|литератур[аы]|источники|использованн[а-яё]+\s+литератур[аы]|references?|bibliograph\w*)\s*[:\-–—]?\s*$"
MARKS = r"[.,;:·•▪\-|_/\\\[\]()]"
NEGATIVE = r"(?iU)\b(отрицает|не\s+обнаружено|не\s+находился|не\s+отягощен)\b[.,;:\s]*"
FILLER = r"(?iU)\b(безболезненная|кожа обычной окраски|умеренно влажная|свободн\w*|по средней линии)\b[.,;:\s]*"
PLAN_HEADER = r"(?iU)(?:^|\n)\s*(?:Назначени[ея]|План(?:\s+лечения)?|Рекомендац[ии]|Терапия|Лечение)\s*[:\-]?\s*\n([\s\S]+)$"
BULLET, NUMBER = r"(?U)^[-•∙–]\s*", r"(?U)^\d+[.)]\s*"
DOSE = r"(?iU)\b(мг|г|мл|р/д|таб|\bсвеч|\bмазь|\bкрем|\bгель)\b"
FENCE = r"```[a-zA-Z0-9_+\-]*\s*([\s\S]*?)```"
THINK = r"(?i)<think>([\s\S]*?)</think>"


def _c(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def clean_text(text: Column | str, homoglyphs: bool = True) -> Column:
    """Scanned text as paragraphs: hyphenation joined, single line breaks as spaces, Latin look-alikes as Cyrillic."""
    t = F.replace(F.replace(_c(text), F.lit("\r"), F.lit("")), F.lit("-\n"), F.lit(""))
    # pairs of line breaks from the left, what is left over is a space
    t = F.array_join(F.transform(F.split(t, "\n\n"), lambda x: F.replace(x, F.lit("\n"), F.lit(" "))), "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.translate(t, LATIN, CYRILLIC) if homoglyphs else t)


def normalize_text(text: Column | str) -> Column:
    """Lines with single spaces, and one blank line at most between them."""
    t = F.translate(_c(text), "\r\t", "\n ")
    lines = F.transform(F.split(F.regexp_replace(t, r"\n{3,}", "\n\n"), "\n"), lambda line: strip(F.regexp_replace(line, r"(?U)\s+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalize_for_hash(text: Column | str) -> Column:
    t = F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " ")
    return strip(F.regexp_replace(t, r"[^0-9a-zа-яё %/.,;:()\-\n]+", " "))


def text_hash(text: Column | str) -> Column:
    return F.sha1(normalize_for_hash(text).cast("binary"))


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")


def terms(text: Column | str) -> Column:
    """Search terms: runs of letters, digits and underscores, in lower case."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def term_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"[\p{L}\p{N}_]+")).cast("long")


def split_lines(text: Column | str) -> Column:
    """Lines and sentences, stripped, none empty."""
    return F.filter(F.transform(F.split(_c(text), BREAK), strip), lambda x: x != "")


def is_citation(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) >= 20) & s.rlike(CITATION)


def has_references_header(text: Column | str) -> Column:
    return _c(text).rlike(HEADER)


def references_page(text: Column | str, p: Params = Params()) -> Column:
    """struct(is_refs, ratio, n_lines)."""

    def judged(lines: Column) -> Column:
        n = F.size(lines)
        ratio = F.when(n >= p.refs_min_lines, F.size(F.filter(lines, is_citation)) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
        return F.struct(ratio.alias("ratio"), n.alias("n_lines"))

    counted = let(split_lines(text), judged)
    return let(counted, lambda x: F.struct(((x["n_lines"] >= p.refs_min_lines) & (x["ratio"] >= p.refs_ratio)).alias("is_refs"), x["ratio"].alias("ratio"), x["n_lines"].alias("n_lines")))


def drop_citations(text: Column | str) -> Column:
    return strip(F.array_join(F.filter(split_lines(text), lambda x: ~is_citation(x)), "\n"))


def drop_loose_citations(text: Column | str) -> Column:
    parts = F.filter(F.split(_c(text), BREAK), lambda x: (x != "") & ~x.rlike(LOOSE_CITATION))
    return strip(F.array_join(parts, "\n"))


def is_noise(text: Column | str, min_chars: int | None = None, p: Params = Params()) -> Column:
    """Too short, too many digits or marks, or mostly short lines."""

    def noisy(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        short = let(split_lines(t), lambda lines: F.size(F.filter(lines, lambda x: F.length(x) < p.noise_short_line)) / F.greatest(F.size(lines), F.lit(1)))
        return (
            (F.length(t) < (p.noise_min_chars if min_chars is None else min_chars))
            | (F.length(F.regexp_replace(t, r"(?U)[^\d]", "")) / n > p.noise_digits)
            | (F.length(F.regexp_replace(t, MARKS.replace("[", "[^", 1), "")) / n > p.noise_marks)
            | (short > p.noise_short_share)
        )

    return let(strip(text), noisy)


def looks_meaningless(text: Column | str) -> Column:
    t = F.lower(strip(text))
    few = F.size(F.array_distinct(F.split(t, ""))) < 5
    return (
        F.when(F.length(t) < 3, True)
        .when(t.rlike(r"^[a-z]\d{1,2}(\.\d+)?$"), False)
        .when(~t.rlike(r"[a-zа-яё0-9]"), True)
        .otherwise(t.rlike(r"(?U)^[a-zа-яё\s]+$") & few & (F.length(t) < 20))
    )


def worth_preview(text: Column | str) -> Column:
    """More than ten letters, digits or underscores of any script."""
    return F.length(F.regexp_replace(_c(text), r"(?U)\W", "")) > 10


def sentences(text: Column | str) -> Column:
    return F.split(_c(text), r"(?U)(?<=[.!?])\s+")


def compact_text(text: Column | str, target: int = 1400) -> Column:
    """Findings that say nothing shortened, repeated sentences dropped, cut at a sentence's end if that is late enough."""
    t = F.regexp_replace(_c(text), r"[ \t]+", " ")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    t = F.regexp_replace(F.regexp_replace(t, NEGATIVE, "нет. "), FILLER, "")
    t = F.regexp_replace(t, r"(?U)[.;:,]\s*(?:[.;:,]\s*)+", ". ")
    t = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    keyed = F.transform(sentences(t), lambda s: F.struct(F.regexp_replace(F.lower(strip(s)), r"(?U)\W+", "").alias("k"), strip(s).alias("s")))
    kept = F.aggregate(
        F.filter(keyed, lambda x: F.length(x["k"]) >= 5),
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(F.array_contains(a["keys"], x["k"]), a).otherwise(F.struct(F.array_append(a["keys"], x["k"]).alias("keys"), F.array_append(a["out"], x["s"]).alias("out"))),
        lambda a: F.array_join(a["out"], " "),
    )
    return let(kept, lambda x: _cut_at_dot(x, target))


def _cut_at_dot(t: Column, target: int) -> Column:
    cut = F.substring(t, 1, target)
    last = target - F.instr(F.reverse(cut), ".")  # place of the last dot, target if there is none
    dotted = F.contains(cut, F.lit(".")) & (last > target * 0.6)
    return strip(F.when(F.length(t) <= target, t).when(dotted, F.substring(cut, F.lit(1), last + 1)).otherwise(cut))


def safe_trim(text: Column | str, most: int = 2000, least: int = 200) -> Column:
    """At most ``most`` characters, cut at a space if that is not too early, and marked."""
    t = _c(text)
    cut = F.substring(t, 1, most)
    space = F.when(F.contains(cut, F.lit(" ")), most - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(space < least, cut).otherwise(F.substring(cut, F.lit(1), space)), F.lit(" …")))


def head(text: Column | str, most: int, mark: str = "") -> Column:
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(mark))).otherwise(t)


def strip_fences(text: Column | str) -> Column:
    """The first fenced block, else the text."""
    t = _c(text)
    return F.when(t.rlike(FENCE), strip(F.regexp_extract(t, FENCE, 1))).otherwise(strip(t))


def strip_fences_loose(text: Column | str) -> Column:
    """Without a leading fence line and trailing back quotes."""
    t = F.regexp_replace(F.replace(_c(text), F.lit("\r"), F.lit("")), r"(?U)^\s+", "")
    t = F.when(t.startswith("```"), F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise("")).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, "`+$", ""), r"(?U)\s+$", "")


def clean_free_text(text: Column | str) -> Column:
    t = strip_fences(text)
    t = F.when(F.contains(t, F.lit("```")), strip_fences_loose(t)).otherwise(t)
    return strip(F.regexp_replace(strip(t), "^`+|`+$", ""))


def thoughts(text: Column | str) -> Column:
    """struct(thought, answer): the last think block, and the text without any."""
    found = F.regexp_extract_all(_c(text), F.lit(THINK), F.lit(1))
    return F.struct(strip(F.try_element_at(found, F.lit(-1))).alias("thought"), strip(F.regexp_replace(_c(text), THINK, "")).alias("answer"))


def case_and_plan(text: Column | str) -> Column:
    """struct(case_text, plan): lines of a plan section (or of all) that are bullets, numbered or doses, and the lines that are not."""
    t = strip(text)
    block = F.when(t.rlike(PLAN_HEADER), F.regexp_extract(t, PLAN_HEADER, 1)).otherwise(t)
    lines = F.transform(F.split(block, "\r\n|[\n\r]"), strip)
    planned = F.filter(lines, lambda s: s.rlike(BULLET) | s.rlike(NUMBER) | s.rlike(DOSE))
    plan = strip(F.array_join(planned, "\n"))
    rest = strip(F.array_join(F.filter(F.split(t, "\r\n|[\n\r]"), lambda x: ~F.array_contains(planned, strip(x))), "\n"))
    return F.struct(F.when(plan != "", rest).otherwise(t).alias("case_text"), F.when(F.length(plan) < 15, "").otherwise(plan).alias("plan"))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} for each value given, put in at once: a value that has such a mark in it is left as it is; other braces stand."""
    import re

    parts = re.split("(" + "|".join(re.escape("{%s}" % n) for n in values) + ")", template)
    return F.concat(*[_c(values[x[1:-1]]) if x[1:-1] in values and x == "{%s}" % x[1:-1] else F.lit(x) for x in parts])


def printable(line: Column | str) -> Column:
    """Without control, format and unassigned characters and without spaces other than the plain one; tabs and line ends stay. NFKC is functions.unicode.nfkc."""
    return F.regexp_replace(_c(line), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\r\n]]", "")
