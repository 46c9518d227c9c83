"""A02, A03 kept up to date by a stream: each user's document count, length sum and document frequencies.

Counts are sums over documents, so a user's documents are dealt to SLOTS states of their own by
the hash of their id: a user with a third of all documents is no single task.  A state
holds its totals as a value and its document frequencies as a map by term, on disk in
RocksDB, and gives out what a micro-batch has changed.  These rows are appended to a table
as upserts, and a read adds the slots up.

A document counts once: a second delivery within the watermark is dropped, and so is one
that comes later than the watermark.  Counts age out ``ttl_ms`` after they last changed,
if that is given.  Restarting from the checkpoint goes on with the states as they were.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larkspur.functions import text as T
from larkspur.operators.log import Delta, Store

SLOTS = 8
#: The state store that states with maps need; a setting of the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "user_id string, slot int, term string, df bigint, n_docs bigint, length bigint"
TABLE = f"change_key string, {CHANGES}"


class Counts(StatefulProcessor):
    """One slot of a user; rows (user_id, slot, length, terms), the distinct terms parted by blanks."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n_docs bigint, length bigint", self.ttl_ms)
        self.df = handle.getMapState("df", "term string", "df bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        user_id, slot = key
        docs, length, df = 0, 0, Counter()
        for row in rows:
            if row.length:
                docs, length = docs + 1, length + row.length
                df.update(row.terms.split(" "))
        if not docs:
            return
        was = self.totals.get() if self.totals.exists() else (0, 0)
        docs, length = docs + was[0], length + was[1]
        self.totals.update((docs, length))
        yield Row(user_id=user_id, slot=slot, term=None, df=None, n_docs=docs, length=length)
        for term, n in df.items():
            n += self.df.getValue((term,))[0] if self.df.containsKey((term,)) else 0
            self.df.updateValue((term,), (n,))
            yield Row(user_id=user_id, slot=slot, term=term, df=n, n_docs=None, length=None)

    def close(self) -> None:
        pass


def changes(documents: DataFrame, late: str = "1 hour", ttl_ms: int | None = None, slots: int = SLOTS) -> DataFrame:
    """The stream (user_id, slot, term, df, n_docs, length) of changed counts of a stream (user_id, memory_id, memory_content, ts); term is null in totals.

    Documents are exchanged twice, by id and by state: as their length and distinct terms, which hold no blank, in one string.
    """
    terms = T.bm25_terms(F.col("memory_content"))
    sized = documents.withWatermark("ts", late).select("user_id", "memory_id", "ts", F.size(terms).alias("length"), F.array_join(F.array_distinct(terms), " ").alias("terms"))
    once = sized.dropDuplicatesWithinWatermark(["user_id", "memory_id"])
    rows = once.select("user_id", F.pmod(F.xxhash64("memory_id"), F.lit(slots)).cast("int").alias("slot"), "length", "terms")
    return rows.groupBy("user_id", "slot").transformWithState(statefulProcessor=Counts(ttl_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def keep(documents: DataFrame, store: Store, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts the stream into a table of the store; a batch that is repeated after a failure upserts the same counts."""
    documents.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    store.ensure(**{table: (TABLE, "change_key", ())})

    def put(batch: DataFrame, _: int) -> None:
        key = F.concat_ws("\u0001", "user_id", "slot", F.coalesce(F.concat(F.lit("t"), F.col("term")), F.lit("")))
        store.append(Delta(table, "upsert", batch.withColumn("change_key", key), once=True))  # a state gives each of its terms once a batch

    return changes(documents, **options).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(user_id, term, df) from the kept table."""
    return counts.where("term IS NOT NULL").groupBy("user_id", "term").agg(F.sum("df").alias("df"))


def stats(counts: DataFrame) -> DataFrame:
    """(user_id, n_docs, avgdl, n_terms, max_df): what ``search.bm25_index`` computes from all documents."""
    totals = counts.where("term IS NULL").groupBy("user_id").agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avgdl"))
    terms = document_frequencies(counts).groupBy("user_id").agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
    return totals.join(terms, "user_id")
