"""From conversations to memories, with models behind columns or tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import compress as C
from larkspur.operators import dialogue, validate

KINDS = ("profile", "episodic", "state")


def extract(valid: DataFrame, answer: Callable[[Column, Column], Column] | DataFrame, compress: Callable[[Column], Column] | float | None = None, force_kind: bool = True, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, memories, report) of valid messages (conv_id, turn, role, content, seq[, user_id]).

    ``answer`` stands for the model: a function of (kind, topic text), such as a pandas UDF, or a replay table (prompt_md5, response) by the md5
    of kind and text; a missing answer yields no memories, and a topic without memories is dropped.  ``compress``: a function of a text
    column, or the rate for ``operators.compress``; a message of which nothing would be left stays as it is there.
    """
    if isinstance(compress, float):
        keyed = valid.withColumn("_key", F.concat_ws("\u0001", "conv_id", "seq"))
        short = C.compress(keyed, "_key", "content", compress).select("_key", T.blank_to_null(F.col("compressed")).alias("_short"))
        valid = keyed.join(short, "_key").withColumn("content", F.coalesce("_short", "content")).drop("_key", "_short")
    elif compress is not None:
        valid = valid.withColumn("content", compress(F.col("content"))).where(F.trim("content") != "")
    segments = dialogue.topic_segments(dialogue.turn_records(valid), embed=embed)
    texts = dialogue.topic_texts(dialogue.topic_entries(valid, segments)).where(F.trim("topic_text") != "")
    topics = texts.withColumn("topic_id_", T.deterministic_id("top_", F.col("conv_id"), F.col("topic_id")))
    asked = topics.select(F.col("topic_id_").alias("topic_id"), F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"), "topic_text")
    if isinstance(answer, DataFrame):
        prompts = asked.withColumn("prompt_md5", F.md5(F.concat_ws("\n", "kind", "topic_text").cast("binary")))
        answers = prompts.join(answer.select("prompt_md5", F.col("response").alias("answer")), "prompt_md5")
    else:
        answers = asked.withColumn("answer", answer(F.col("kind"), F.col("topic_text")))
    memories = validate.extracted(answers, force_kind)
    memories = memories.withColumn("memory_id", T.deterministic_id("mem_", F.col("topic_id"), F.col("memory_type"), F.col("position"), F.col("memory_content")))
    kept = topics.join(memories.select(F.col("topic_id").alias("topic_id_")).distinct(), "topic_id_", "left_semi").select("conv_id", "topic_id_", "topic_id", "topic_text").withColumnsRenamed({"topic_id": "topic_idx", "topic_id_": "topic_id"})
    report = memories.join(kept.select("topic_id", "conv_id"), "topic_id").groupBy("conv_id").agg(
        F.countDistinct("topic_id").alias("topics"), *[F.count_if(F.col("memory_type") == k).alias(k) for k in KINDS]
    )
    return kept, memories, report


def dry_run(valid: DataFrame) -> DataFrame:
    """C11: the model-free pipeline: contents are marked, conversations cut in the middle, memories counted by text length.

    (conv_id, topic_idx, n_messages, text_chars, profile, state)
    """
    n = F.count("*").over(dialogue.W.partitionBy("conv_id"))
    rows = valid.withColumn("n", n).withColumn("topic_idx", F.when(F.col("n") == 1, 0).otherwise((F.col("seq") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).cast("int")))
    at = F.row_number().over(dialogue.W.partitionBy("conv_id", "topic_idx").orderBy("seq")) - 1
    content = F.replace(F.concat("content", F.lit(" [compressed]")), F.lit("\n"), F.lit(" "))
    rows = rows.withColumn("line", F.concat(F.lit("["), at.cast("string"), F.lit("] "), "role", F.lit(": "), content))
    out = rows.groupBy("conv_id", "topic_idx").agg(F.count("*").alias("n_messages"), (F.sum(F.length("line")) + F.count("*") - 1).alias("text_chars"))
    return out.withColumn("profile", F.greatest(F.lit(1), F.floor(F.col("text_chars") / 80))).withColumn("state", F.lit(1))


def dry_run_sql(messages: str) -> str:
    return f"""WITH {messages}, t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM msg), h AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN seq >= greatest(1, n // 2) THEN 1 ELSE 0 END AS topic_idx FROM t),
l AS (SELECT conv_id, topic_idx, '[' || (row_number() OVER (PARTITION BY conv_id, topic_idx ORDER BY seq) - 1) || '] ' || role || ': ' || replace(content || ' [compressed]', chr(10), ' ') AS line FROM h)
SELECT conv_id, topic_idx::INT AS topic_idx, count(*) AS n_messages, (sum(length(line)) + count(*) - 1)::BIGINT AS text_chars, greatest(1, (sum(length(line)) + count(*) - 1) // 80)::BIGINT AS profile, 1::INT AS state FROM l GROUP BY ALL"""


def chat_prompts(valid: DataFrame, memories: DataFrame) -> DataFrame:
    """(conv_id, history, prompt): a conversation's history, and its last user turn with the memories (conv_id, position, content) found for it."""
    line = F.struct("seq", F.concat("role", F.lit(": "), "content").alias("line"))
    history = valid.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(line)).alias("x"), F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("seq"))).alias("said")
    )
    block = memories.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- "), "content").alias("line")))).alias("m"))
    joined = history.where("said IS NOT NULL").join(block, "conv_id", "left")
    lines = lambda c: F.array_join(F.transform(c, lambda e: e["line"]), "\n")
    tail = F.coalesce(F.concat(F.lit("\n\n[memories]\n"), lines("m")), F.lit(""))
    return joined.select("conv_id", lines("x").alias("history"), F.concat("said", tail).alias("prompt"))
