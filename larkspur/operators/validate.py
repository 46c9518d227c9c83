"""Checks of extracted memories: item by item (P04), by group (P05), and the extractor's own lenient form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import json as J
from larkspur.schema import VALID_CATEGORIES


def valid_category(memory_type: Column, category: Column) -> Column:
    """Whether the category is one of the type's."""
    return reduce(lambda c, kv: c | ((memory_type == kv[0]) & category.isin(*kv[1])), VALID_CATEGORIES.items(), F.lit(False))


def _unit(value: Column) -> Column:
    """A JSON number from 0 to 1; booleans and text are none."""
    kind, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    return F.coalesce((kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")) & number.between(0.0, 1.0), F.lit(False))


def verify_items(items: DataFrame, kind: str = "kind", item: str = "item") -> DataFrame:
    """Items (kind, item VARIANT) with ``errors`` (all of them, in order) and ``valid``; a null kind is not compared."""
    v = F.col(item)
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    has = lambda name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    fields = ("memory_content", "memory_type", "memory_category", "importance", "confidence", "cite")
    content = text("memory_content")
    kind_of, category = F.lower(F.trim(text("memory_type"))), F.lower(F.trim(text("memory_category")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    cites = F.try_variant_get(v, "$.cite", "array<variant>")
    bad_cite = F.exists(cites, lambda c: ~F.coalesce(F.schema_of_variant(c) == "BIGINT", F.lit(False)))
    checks = [
        *[(~has(f), f"missing {f}") for f in fields],
        (blank(content), "memory_content is blank"),
        (blank(kind_of), "memory_type is blank"),
        (~blank(kind_of) & ~kind_of.isin(*VALID_CATEGORIES), "memory_type is unknown"),
        (kind_of.isin(*VALID_CATEGORIES) & F.col(kind).isNotNull() & (kind_of != F.col(kind)), "memory_type differs from its group"),
        (blank(category), "memory_category is blank"),
        (~blank(category) & ~F.coalesce(valid_category(kind_of, category), F.lit(False)), "memory_category is not one of its type"),
        (~_unit(F.try_variant_get(v, "$.importance", "variant")), "importance is no number from 0 to 1"),
        (~_unit(F.try_variant_get(v, "$.confidence", "variant")), "confidence is no number from 0 to 1"),
        (cites.isNull(), "cite is no array"),
        (F.coalesce(bad_cite, F.lit(False)), "cite holds more than integers"),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in checks]))
    return items.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def verify_rollup(verified: DataFrame, by: list[str]) -> DataFrame:
    """Valid, total and valid_count of each group, and how many items failed each check."""
    return verified.groupBy(*by).agg(F.bool_and("valid").alias("valid"), F.count("*").alias("total"), F.count_if("valid").alias("valid_count"), F.sum(F.size("errors")).alias("n_errors"))


def extracted(answers: DataFrame, force_kind: bool = True) -> DataFrame:
    """Memories from answers (topic_id, kind, answer): JSON as the model wrote it, perhaps with prose around it.

    A list may stand bare or under ``memories``; content under two names.  The type is the answer's kind, or with force_kind=False the item's
    own, if known.  Items without content or with a category that is not of their type are dropped; cites keep their integers; scores are
    clamped, 0.5 where missing.  (topic_id, memory_type, memory_category, memory_content, cites, importance, confidence, position)
    """
    parsed = answers.withColumn("v", F.coalesce(J.parse_object(F.col("answer")), F.try_parse_json("answer")))
    listed = F.coalesce(F.try_variant_get("v", "$.memories", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    items = parsed.select("topic_id", "kind", F.posexplode(listed).alias("position", "item"))
    field = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    content = F.coalesce(F.when(F.trim(field("content")) != "", F.trim(field("content"))), F.trim(field("memory_content")))
    kind = F.col("kind") if force_kind else F.lower(F.trim(field("memory_type")))
    category = F.lower(F.trim(field("memory_category")))
    return (
        items.withColumns({"memory_type": kind, "memory_category": category, "memory_content": content})
        .where(valid_category(F.col("memory_type"), F.col("memory_category")) & (F.col("memory_content") != ""))
        .select(
            "topic_id", "memory_type", "memory_category", "memory_content",
            F.coalesce(J.int_list(F.try_variant_get("item", "$.cite", "variant")), F.array().cast("array<int>")).alias("cites"),
            J.safe_unit(field("importance")).alias("importance"), J.safe_unit(field("confidence")).alias("confidence"), "position",
        )
    )
