"""Conversations: validation, turns, topic segmentation, topic texts; all conversations at once.

messages: (conv_id, turn, role, content).  No step puts a conversation into Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vector as V
from larkspur.schema import ROLES

GATE_TOKENS, BOUNDARY = 512, 0.55


def valid_messages(messages: DataFrame) -> DataFrame:
    """Trimmed messages of a known role that are not blank; ``seq`` counts them from 0."""
    role, content = F.lower(F.trim("role")), F.trim("content")
    kept = messages.withColumns({"role": role, "content": content}).where(F.col("role").isin(*ROLES) & (F.col("content") != ""))
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)


def validate_history(histories: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) histories of the HISTORY schema.

    A history needs a user_id and a valid message; its id is the first given of three names, its time ``now`` if it has none.
    """
    good = F.filter(
        F.transform("conversation", lambda m: F.struct(F.lower(F.trim(m["role"])).alias("role"), F.trim(m["content"]).alias("content"))),
        lambda m: m["role"].isin(*ROLES) & (m["content"] != ""),
    )
    user = T.blank_to_null(F.col("user_id"))
    named = F.coalesce(*[T.blank_to_null(F.trim(c)) for c in ("raw_conversation_id", "raw_convation_id", "session_id")])
    time = F.coalesce(T.blank_to_null(F.trim("conversation_date_time")), F.lit(now))
    error = F.when(user.isNull(), "user_id is missing").when(F.coalesce(F.size("conversation"), F.lit(0)) <= 0, "conversation is empty").when(F.size(good) == 0, "no valid message")
    made = T.session_id(F.col("user_id"), time, F.size("conversation"))
    out = histories.withColumns({"error": error, "messages": good, "conversation_time": time, "conversation_id": F.coalesce(named, made)})
    valid = out.where("error IS NULL").select("user_id", "conversation_id", "conversation_time", "messages")
    return valid, out.where("error IS NOT NULL").select(*histories.columns, "error")


def turn_records(valid: DataFrame) -> DataFrame:
    """(conv_id, record, text, n_messages, tokens): messages two by two by place, an odd last one alone."""
    paired = valid.withColumn("record", F.floor(F.col("seq") / 2).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))  # two at most
    out = paired.groupBy("conv_id", "record").agg(parts.alias("m"), F.sum(T.token_count(F.col("content"))).alias("tokens"))
    return out.select("conv_id", "record", F.array_join(F.transform("m", lambda x: x["content"]), "").alias("text"), F.size("m").alias("n_messages"), "tokens")


def adjacent_similarity(records: DataFrame, embed=None, digits: int = 9) -> DataFrame:
    """Records with ``similarity`` to the record before; only neighbours are compared."""
    embed = embed or (lambda text: V.hash_embedding(T.bm25_terms(text)))
    w = W.partitionBy("conv_id").orderBy("record")
    vectors = records.withColumn("vec", embed(F.col("text")))
    return vectors.withColumn("before", F.lag("vec").over(w)).withColumn("similarity", F.round(V.dot(F.col("vec"), F.col("before")), digits)).drop("vec", "before")


def topic_segments(records: DataFrame, threshold: float = BOUNDARY, gate: int = GATE_TOKENS, embed=None) -> DataFrame:
    """(conv_id, topic_id, start_record, end_record, n_messages, token_count, segmented).

    Conversations of at most ``gate`` tokens, or of one record, are one topic and are not embedded.
    """
    whole = W.partitionBy("conv_id")
    sized = records.withColumns({"total": F.sum("tokens").over(whole), "n": F.count("*").over(whole)})
    short = (F.col("total") <= gate) | (F.col("n") <= 1)
    alone = sized.where(short).withColumn("topic_id", F.lit(0))
    long = adjacent_similarity(sized.where(~short), embed)
    cut = F.coalesce((F.col("similarity") < threshold).cast("int"), F.lit(0))
    long = long.withColumn("topic_id", F.sum(cut).over(W.partitionBy("conv_id").orderBy("record")).cast("int"))
    rows = alone.select("conv_id", "record", "n_messages", "tokens", "topic_id").unionByName(long.select("conv_id", "record", "n_messages", "tokens", "topic_id"))
    out = rows.groupBy("conv_id", "topic_id").agg(
        F.min("record").alias("start_record"), F.max("record").alias("end_record"), F.sum("n_messages").alias("n_messages"), F.sum("tokens").alias("token_count")
    )
    return out.withColumn("segmented", F.count("*").over(whole) > 1)


def topic_entries(valid: DataFrame, segments: DataFrame) -> DataFrame:
    """(conv_id, topic_id, index, speaker, content): places in the topic count blank messages, which are then left out."""
    at = valid.withColumn("record", F.floor(F.col("seq") / 2).cast("int"))
    joined = at.join(segments.select("conv_id", "topic_id", "start_record", "end_record"), "conv_id").where(F.col("record").between(F.col("start_record"), F.col("end_record")))
    index = F.row_number().over(W.partitionBy("conv_id", "topic_id").orderBy("seq")) - 1
    rows = joined.withColumn("index", index).where(F.trim("content") != "")
    return rows.select("conv_id", "topic_id", "index", T.role_alias(F.col("role")).alias("speaker"), F.replace("content", F.lit("\n"), F.lit("\\n")).alias("content"))


def topic_texts(entries: DataFrame) -> DataFrame:
    """one text a topic, a line an entry."""
    line = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] speaker:"), F.col("speaker"), F.lit(",content:"), F.col("content"))
    rows = entries.groupBy("conv_id", "topic_id").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("x"))
    return rows.select("conv_id", "topic_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("topic_text"))


def repair_speakers(turns: DataFrame) -> DataFrame:
    """An unknown speaker alternates from the last known one; dia_id is renumbered D{session}:{n}.

    turns: (session, n, speaker) with speaker a, b or null.
    """
    w = W.partitionBy("session").orderBy("n")
    at = F.row_number().over(w)
    known = turns.withColumn("at", at).withColumn("last", F.last(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "at")), ignorenulls=True).over(w))
    last, gap = F.coalesce(F.col("last.speaker"), F.lit("b")), F.col("at") - F.coalesce(F.col("last.at"), F.lit(0))
    fixed = F.when(gap % 2 == 0, last).otherwise(F.when(last == "a", "b").otherwise("a"))
    dia = F.concat(F.lit("D"), F.col("session").cast("string"), F.lit(":"), F.col("at").cast("string"))
    return known.select("session", "n", fixed.alias("speaker"), F.col("speaker").isNull().alias("fixed"), dia.alias("dia_id"))
