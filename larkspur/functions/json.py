"""Model answers: lenient parsing into VARIANT, then typed extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_unit(value: Column, default: float = 0.5) -> Column:
    """a number clamped to [0, 1]; the default where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def parse_object(text: Column) -> Column:
    """the whole text as JSON, else what stands between the first { and the last }; null if neither parses."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def repair(text: Column) -> Column:
    """full-width colons and commas, trailing commas, quoted braces."""
    t = F.translate(text, "：，", ":,")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r'"\{', "{"), r'\}"', "}")


#: What a scan for brackets steps over: whole strings, one bracket, a stretch of anything else, or a quote that is never closed.
PIECES = r'(?s)("(?:[^"\\]++|\\.)*+"|[%s]|[^"%s]++|")'

SCALAR = r'^(?s)(-?[0-9][0-9.eE+-]*|true|false|null|"(?:[^"\\]++|\\.)*+")$'


def balanced(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to the closer that balances it, brackets in strings left aside; null if there is none.

    One fold over the pieces of the text: the depth, and the length up to where it is 0 again.
    """
    both = "".join(f"\\{c}" for c in (opener, closer))
    tail = F.substr(text, F.locate(opener, text), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece == opener, 1).when(piece == closer, -1).otherwise(0)
        return F.when(s["closed"], s).otherwise(F.struct(depth.alias("depth"), (s["length"] + F.length(piece)).alias("length"), (depth == 0).alias("closed")))

    end = F.aggregate(F.regexp_extract_all(tail, F.lit(PIECES % (both, both)), F.lit(1)), start, step, lambda s: F.when(s["closed"], s["length"]))
    return F.when(F.contains(text, F.lit(opener)), F.substr(tail, F.lit(1), end))


def outermost(text: Column) -> Column:
    """F16: the JSON in a model's answer, as it stands there; null if there is none.

    The inside of the first code fence, else the whole text, else the first balanced object, else the first balanced array: the first of
    them that parses.  Only the first { and the first [ are tried; brackets in strings do not count.
    """
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_replace(F.regexp_extract(whole, r"(?s)```(?:json)?\s*(.*?)```", 1), r"(?U)^\s+|\s+$", "")
    parses = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    # the parser reads one value and does not look at what follows it
    alone = lambda t: F.when(F.startswith(t, F.lit("{")), t == balanced(t, "{", "}")).when(F.startswith(t, F.lit("[")), t == balanced(t, "[", "]")).otherwise(t.rlike(SCALAR))
    parts = [F.when(alone(t), parses(t)) for t in (fenced, whole)]
    return F.coalesce(*parts, parses(balanced(whole, "{", "}")), parses(balanced(whole, "[", "]")))


def int_list(value: Column) -> Column:
    """The integers of a VARIANT array: other elements, booleans among them, are left out."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v).isin("BIGINT", "TINYINT", "SMALLINT", "INT")), lambda v: F.try_variant_get(v, "$", "int"))
