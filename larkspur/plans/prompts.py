"""Prompts for models, within a budget, and their answers brought back to what they speak of.

The templates are this engine's own; what they ask for is the JSON that ``operators.validate`` and ``operators.ranking`` read.
Payloads are taken row by row in order while the running sum of their tokens stays within the budget; the first row is always
there.  A group's rows are bounded by that before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import json as J
from larkspur.functions import text as T
from larkspur.schema import VALID_CATEGORIES

MOST_CANDIDATES, MOST_CHARS = 40, 500

ITEM = '{"topic": "...", "memories": [{"memory_type": "...", "memory_category": "...", "content": "...", "cite": [0], "importance": 0.5, "confidence": 0.5}]}'


def _kind(kind: str) -> str:
    return f"Read the numbered messages and write down what they say about the user that is of kind {kind}. Categories: {', '.join(VALID_CATEGORIES[kind])}. Cite message numbers. Answer with JSON only, like {ITEM}\n\n{{text}}"


TEMPLATES = {kind: _kind(kind) for kind in VALID_CATEGORIES} | {
    "unified": "Read the numbered messages and write down what they say about the user, of the kinds " + "; ".join(f"{k} ({', '.join(c)})" for k, c in VALID_CATEGORIES.items()) + f". Cite message numbers. Answer with JSON only, like {ITEM}\n\n{{text}}",
    "merge": 'Do these memories, newest first, say the same? If so, merge them into one. Answer with JSON only, like {"should_merge": true, "merged_content": "...", "memory_type": "...", "memory_category": "...", "importance": 0.5, "confidence": 0.5}\n\n{memories_json}',
    "category": "Write a Markdown document about the user from these memories, most important first.\n\n{memories_json}",
    "rerank": 'Order the candidates by how well they answer the query. Answer with JSON only, like {"ranked": [{"index": 0, "score": 0.9, "reason": "..."}]}\n\nQuery: {query}\n\n{memories_json}',
}


def filled(template: str, **values: Column) -> Column:
    """A template as a Column; {name} stands for a value."""
    parts, rest = [], TEMPLATES[template]
    while rest:
        at = {rest.find("{" + n + "}"): n for n in values if "{" + n + "}" in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        i = min(at)
        parts += [F.lit(rest[:i]), values[at[i]]]
        rest = rest[i + len(at[i]) + 2 :]
    return F.concat(*parts)


def extraction_prompt(kind: str, text: Column) -> Column:
    """The prompt of a kind, or ``unified``, for a topic's text."""
    return filled(kind, text=text)


def within_budget(rows: DataFrame, by: list[str], order: list[Column], content: str, tokens: int | None, most: int | None = None) -> DataFrame:
    """The first rows of each group, numbered by ``place`` from 0: as many as the tokens of their contents allow, one at least, ``most`` at most."""
    w = W.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(w) - 1)
    if most is not None:
        rows = rows.where(F.col("place") < most)
    if tokens is not None:
        total = F.sum(T.token_count(F.col(content))).over(w.rowsBetween(W.unboundedPreceding, 0))
        rows = rows.withColumn("_total", total).where((F.col("_total") <= tokens) | (F.col("place") == 0)).drop("_total")
    return rows


def _payload(rows: DataFrame, by: list[str], item: Column) -> DataFrame:
    out = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", F.to_json(item).alias("j")))).alias("x"))
    return out.select(*by, F.size("x").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["j"]), ","), F.lit("]")).alias("payload"))


def rerank_candidates(hits: DataFrame, most: int = MOST_CANDIDATES, chars: int = MOST_CHARS, tokens: int | None = None) -> DataFrame:
    """(query_id, index, memory_id, memory_content, memory_type, memory_category, updated_at, score, retrieval_count) of hits (query_id, rank, ...): the first ``most`` of a query, contents cut."""
    cut = hits.withColumn("memory_content", F.substring(F.coalesce("memory_content", F.lit("")), 1, chars))
    rows = within_budget(cut, ["query_id"], [F.col("rank"), F.col("memory_id")], "memory_content", tokens, most)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("query_id", F.col("place").alias("index"), "memory_id", "memory_content", blank("memory_type"), blank("memory_category"), blank("updated_at"), "score", "retrieval_count")


def rerank_prompts(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, prompt) of candidates and queries (query_id, text)."""
    item = F.struct("index", "memory_id", "memory_content", "memory_type", "memory_category", "updated_at", "score", "retrieval_count")
    rows = _payload(candidates.withColumn("place", F.col("index")), ["query_id"], item)
    return rows.join(queries.select("query_id", "text"), "query_id").select("query_id", "n", filled("rerank", query=F.col("text"), memories_json=F.col("payload")).alias("prompt"))


def ranked_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, pos, idx, llm_score, memory_id) of answers (query_id, response): the ranked list, or the whole answer if it is a list, joined to the candidates by index.

    Entries without a whole number as index, or with one that no candidate has, are dropped, and so are later ones of one index.
    """
    found = answers.select("query_id", J.parse_object(F.col("response")).alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.ranked", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = found.select("query_id", F.posexplode(listed).alias("pos", "e"))
    rows = rows.select("query_id", "pos", F.try_variant_get("e", "$.index", "int").alias("idx"), J.safe_unit(F.try_variant_get("e", "$.score", "double"), 0.0).alias("llm_score"))
    first = rows.where("idx IS NOT NULL").groupBy("query_id", "idx").agg(F.min(F.struct("pos", "llm_score")).alias("x"))
    return first.join(candidates.select("query_id", F.col("index").alias("idx"), "memory_id"), ["query_id", "idx"]).select("query_id", "x.pos", "idx", "x.llm_score", "memory_id")


def merge_prompts(members: DataFrame, tokens: int = 2048) -> DataFrame:
    """(cluster, n, prompt) of members (cluster, memory_id, memory_content, memory_type, memory_category, importance, confidence, created_at): newest first, within the budget."""
    rows = within_budget(members, ["cluster"], [F.desc("created_at"), F.col("memory_id")], "memory_content", tokens)
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    item = F.struct("memory_id", "memory_content", "memory_type", "memory_category", "importance", "confidence", at)
    return _payload(rows, ["cluster"], item).select("cluster", "n", filled("merge", memories_json=F.col("payload")).alias("prompt"))


def merge_decisions(answers: DataFrame) -> DataFrame:
    """Decisions for ``merge.consolidate`` of answers (component, response); what cannot be read means no merge."""
    v = J.parse_object(F.col("response"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    number = lambda name: F.try_variant_get("v", f"$.{name}", "double").alias(f"llm_{name}")
    rows = answers.select("component", v.alias("v"))
    return rows.select("component", F.coalesce(F.try_variant_get("v", "$.should_merge", "boolean"), F.lit(False)).alias("should_merge"), text("merged_content"), text("memory_type"), text("memory_category"), number("importance"), number("confidence"))


def category_prompts(memories: DataFrame, most: int = 60, tokens: int | None = None) -> DataFrame:
    """(user_id, memory_type, memory_category, n, prompt): the ``most`` best active memories of each category, within the budget."""
    by = ["user_id", "memory_type", "memory_category"]
    rows = within_budget(memories.where("status = 'active'"), by, [F.desc("importance"), F.desc("created_at"), F.col("memory_id")], "memory_content", tokens, most)
    item = F.struct("memory_id", "memory_content", "importance", "confidence", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return _payload(rows, by, item).select(*by, "n", filled("category", memories_json=F.col("payload")).alias("prompt"))


def category_answers(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Documents (user_id, memory_type, memory_category, n, markdown) with a model's Markdown (same keys, response) in place, normalised, where there is one that is not blank."""
    by = ["user_id", "memory_type", "memory_category"]
    both = docs.join(answers.select(*by, T.blank_to_null(F.col("response")).alias("response")), by, "left")
    own = T.normalise_markdown(F.col("response"), F.col("memory_type"), F.col("memory_category"))
    return both.select(*by, "n", F.coalesce(own, "markdown").alias("markdown"))
