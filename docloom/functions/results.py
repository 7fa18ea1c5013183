"""Model answers as structured results: JSON out of noisy text, elements of mixed types normalised.  Values of unknown shape are VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SCORED
from . import text as X

ANSWER_KEYS = ("raw_block", "response", "text", "message", "content", "answer")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def parse_loose(text: Column | str) -> Column:
    """The JSON of a text as VARIANT: of its fenced block or the whole, else from its first { to its last }; null if there is none."""

    def inner(t: Column) -> Column:
        first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((first > 0) & F.contains(t, F.lit("}")) & (last > first), F.substring(t, first, last - first + 1))

    raw = X._c(text)
    bare = X.let(X.strip_fences(raw), lambda t: X.strip(F.when(t == raw, X.strip_fences_loose(t)).otherwise(t)))
    return X.let(bare, lambda t: F.coalesce(F.try_parse_json(F.nullif(t, F.lit(""))), F.try_parse_json(inner(t))))


def critical_errors(v: Column) -> Column:
    """array<struct<type, explain>> of a list of objects and strings, or of one string."""
    entry = lambda t, e: F.struct(t.alias("type"), e.alias("explain"))
    none = F.array().cast("array<struct<type:string,explain:string>>")
    of = lambda x: F.when(_is(x, "OBJECT"), entry(X.strip(_get(x, "$.type", "string")), X.strip(_get(x, "$.explain", "string")))).when(_is(x, "STRING"), entry(F.lit(""), X.strip(_get(x, "$", "string"))))
    items = F.filter(F.transform(_get(v, "$", "array<variant>"), of), lambda x: x.isNotNull() & ((x["type"] != "") | (x["explain"] != "")))
    one = X.strip(_get(v, "$", "string"))
    return F.when(_is(v, "ARRAY"), items).when(_is(v, "STRING") & (one != ""), F.array(entry(F.lit(""), one))).otherwise(none)


def recommendations(v: Column) -> Column:
    """array<string> of strings, objects (what — why) and other values as JSON; the first of equals stays."""

    def of(x: Column) -> Column:
        what, why = X.strip(_get(x, "$.what_to_change", "string")), X.strip(_get(x, "$.rationale", "string"))
        both = F.when((what != "") & (why != ""), F.concat(what, F.lit(" — "), why)).when(what != "", what).otherwise(why)
        return F.when(_is(x, "STRING"), X.clean_free_text(_get(x, "$", "string"))).when(_is(x, "OBJECT"), X.clean_free_text(both)).otherwise(F.to_json(x))

    items = F.transform(_get(v, "$", "array<variant>"), of)
    single = F.when(_is(v, "STRING"), X.clean_free_text(_get(v, "$", "string"))).otherwise(X.clean_free_text(F.to_json(v)))
    every = F.when(_is(v, "ARRAY"), items).when(v.isNull() | _is(v, "VOID"), F.array().cast("array<string>")).otherwise(F.array(single))
    return F.array_distinct(F.filter(F.transform(every, X.strip), lambda s: s != ""))


def any_text(v: Column) -> Column:
    """The first of the usual keys that holds a string with more than white space."""
    found = [F.when(_is(_get(v, f"$.{k}"), "STRING") & (X.strip(_get(v, f"$.{k}", "string")) != ""), _get(v, f"$.{k}", "string")) for k in ANSWER_KEYS]
    return F.coalesce(*found, F.lit(""))


def _meta(v: Column) -> Column:
    m = _get(v, "$.meta")
    return F.when(_is(m, "OBJECT"), _get(v, "$.meta", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))


def _citations(v: Column) -> Column:
    c = _get(v, "$.citations")
    text = lambda x: F.when(_is(x, "STRING"), _get(x, "$", "string")).otherwise(F.to_json(x))
    return F.when(_is(c, "ARRAY"), F.filter(F.transform(_get(v, "$.citations", "array<variant>"), text), lambda s: s.isNotNull() & ~s.isin("", "null", "false", "0"))).otherwise(F.array().cast("array<string>"))


def _string(v: Column, path: str) -> Column:
    return F.when(_is(_get(v, path), "STRING"), _get(v, path, "string")).otherwise("")


_ERRORS, _STRINGS, _MAP = "array<struct<type:string,explain:string>>", "array<string>", "map<string,string>"


def from_text(text: Column | str) -> Column:
    """The result of an answer's text: its JSON object, or the text itself as free text."""

    def made(v: Column) -> Column:
        there = _is(v, "OBJECT")
        return F.struct(
            F.when(there, X.let(_get(v, "$.critical_errors"), critical_errors)).otherwise(F.array().cast(_ERRORS)).alias("critical_errors"),
            F.when(there, X.let(_get(v, "$.recommendations"), recommendations)).otherwise(F.array().cast(_STRINGS)).alias("recommendations"),
            F.when(there, _citations(v)).otherwise(F.array().cast(_STRINGS)).alias("citations"),
            F.when(there, _string(v, "$.disclaimer")).otherwise("").alias("disclaimer"),
            F.when(there, _meta(v)).otherwise(F.create_map().cast(_MAP)).alias("meta"),
            F.when(there, "").otherwise(X.clean_free_text(text)).alias("free_text"),
        )

    return X.let(parse_loose(text), made)


def from_object(json: Column | str) -> Column:
    """The result of an answer that is an object itself; lists that it lacks come from JSON inside its text."""

    def made(v: Column, raw: Column, inner: Column) -> Column:
        there = _is(inner, "OBJECT")
        said = X.strip(F.coalesce(*[F.nullif(_get(inner, f"$.{k}", "string"), F.lit("")) for k in ("answer", "text", "message")], F.lit("")))
        free = F.when(raw == "", "").when(there & (said != ""), X.clean_free_text(said)).otherwise(X.clean_free_text(raw))
        errors = X.let(X.let(_get(v, "$.critical_errors"), critical_errors), lambda e: F.when((F.size(e) == 0) & there, X.let(_get(inner, "$.critical_errors"), critical_errors)).otherwise(e))
        recs = X.let(X.let(_get(v, "$.recommendations"), recommendations), lambda r: F.when((F.size(r) == 0) & there, X.let(_get(inner, "$.recommendations"), recommendations)).otherwise(r))
        return F.struct(errors.alias("critical_errors"), recs.alias("recommendations"), _citations(v).alias("citations"), _string(v, "$.disclaimer").alias("disclaimer"), _meta(v).alias("meta"), free.alias("free_text"))

    return X.let(F.try_parse_json(X._c(json)), lambda v: X.let(any_text(v), lambda raw: X.let(parse_loose(raw), lambda inner: made(v, raw, inner))))


def scored(text: Column | str, schema) -> Column:
    """An answer by a fixed schema; one that is no such JSON has score 0, empty lists and a disclaimer that says so."""
    parsed = F.from_json(X._c(text), schema)
    good = parsed.isNotNull() & parsed["score"].isNotNull()
    empty = {"score": F.lit(0), "disclaimer": F.lit("Ответ не прошёл строгий JSON.")}
    fallback = F.struct(*[(empty.get(f.name, F.array() if f.dataType.typeName() == "array" else F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields])
    return F.when(good, parsed).otherwise(fallback)


def valid_score(result: Column, schema=SCORED) -> Column:
    """Whether a result holds all that its schema asks for: a score of 1 to 100, all subscores of 0 to 100, lists, and in each entry all fields but its citations, which are whole where given."""

    def whole(kind, v: Column, name: str) -> Column:
        if kind.typeName() == "array":
            inside = F.coalesce(F.forall(v, lambda x: whole(kind.elementType, x, "")), F.lit(True))
            return inside if name == "citations" else v.isNotNull() & inside
        if kind.typeName() == "struct":
            out = v.isNotNull()
            for field in kind.fields:
                out = out & whole(field.dataType, v[field.name], field.name)
            return out
        return v.isNotNull()

    checks = result.isNotNull() & result["score"].between(1, 100)
    for field in schema.fields:
        checks = checks & (result[field.name].isNotNull() if field.dataType.typeName() == "array" else F.lit(True)) & whole(field.dataType, result[field.name], field.name)
    for field in schema["subscores"].dataType.fields:
        checks = checks & result["subscores"][field.name].between(0, 100)
    return F.coalesce(checks, F.lit(False))
