"""Tables that are changed by appending: a base in buckets of keys, deltas on top, folded when read.

A table's base lies in one folder a bucket of its key's hash.  A change appends a delta, a
folder of rows: ``upsert`` puts whole rows, ``patch`` the values that are not null, ``bump``
adds to the counters and raises the latest times, ``delete`` takes keys away.  A read
gathers the deltas by key, in the order of commits, and folds them onto the base rows; where
they name few keys, rows that they do not name are left as they are.  ``compact`` folds the buckets that deltas touch, and no others, into
new folders.

Every folder and draft has a fresh name, and nothing that was committed is ever written
again.  A commit becomes visible by one small file, POINTER-<version>, put in place only
if no other writer has put it: by a hard link on local disks, else by a rename that does not
overwrite, which is atomic where the file system's rename is (HDFS).  A writer that comes
second reads the newer state and tries again: appended deltas go on top of it; a table that
is replaced or compacted must be as it was, else the commit fails and changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("upsert", "patch", "bump", "delete")
#: Deltas of a table at which a commit asks for compaction, which bounds the rows of a key that a read folds.
MOST_DELTAS = 64
BUCKETS = 16
#: Keys named by deltas up to which they are broadcast when a table is read: some 50 MB.
BROADCAST_KEYS = 500_000


class Conflict(OSError):
    """Another writer changed what this commit was computed from."""


@dataclass(frozen=True)
class Delta:
    """Rows to append to a table. patch: the key and the columns to change; bump: the key, counts to add and times to raise; delete: the key.

    once: the rows are known to hold each key once, and are written as they come, without an exchange by key.
    """

    table: str
    kind: str
    rows: DataFrame
    once: bool = False


class Store:
    """Named tables under one folder of any file system that Spark knows; each has a key and columns that an upsert keeps."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # --- the pointer ---

    def _state(self) -> dict:
        """The newest committed state: version and tables."""
        found = self._fs.globStatus(self._path(f"{self.root}/POINTER-*"))
        names = sorted(f.getPath().getName() for f in found or ())
        if not names:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first()[0])

    def _put_if_absent(self, name: str, content: str) -> bool:
        """Whether the file was put in place, whole, by this call; false if there is one by that name."""
        draft, target = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                return self._linked(draft, target)
            return self._renamed(draft, target)
        finally:
            self._fs.delete(draft, False)

    def _linked(self, draft, target) -> bool:
        local = lambda p: unquote(urlparse(p.toUri().toString()).path)
        try:
            os.link(local(draft), local(target))
        except FileExistsError:
            return False
        return True

    def _renamed(self, draft, target) -> bool:
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            if self._fs.exists(target):
                return False
            raise e
        return True

    def _commit(self, change: Callable[[dict, int], dict]) -> int:
        """Puts what ``change`` makes of the newest tables, for the version it gets; again on a newer state while others come first."""
        while True:
            now = self._state()
            version = now["version"] + 1
            tables = change(json.loads(json.dumps(now["tables"])), version)
            if self._put_if_absent(f"POINTER-{version:012d}", json.dumps({"version": version, "tables": tables})):
                return version

    # --- folders ---

    def _folder(self, table: str) -> str:
        return f"{table}/{uuid.uuid4().hex}"

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write_base(self, table: str, key: str, rows: DataFrame) -> dict[str, str]:
        """{bucket: folder} of the rows; no folder for a bucket without any."""
        folder = self._folder(table)
        # each task writes a file a bucket: rows are not shuffled once more, nor a bucket held by one task
        rows.withColumn("_bucket", self._bucket(key)).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self._fs.globStatus(self._path(f"{self.root}/{folder}/_bucket=*")) or ()]
        return {name.partition("=")[2]: f"{folder}/{name}" for name in found}

    # --- reading ---

    def tables(self) -> list[str]:
        return sorted(self._state()["tables"])

    def version(self) -> int:
        return self._state()["version"]

    def read(self, table: str) -> DataFrame:
        """The table as of the newest commit."""
        entry = self._state()["tables"][table]
        return self._folded(entry, self._base(entry, list(entry["base"])), entry["deltas"])

    def _base(self, entry: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.root}/{entry['base'][b]}" for b in buckets]
        reader = self.spark.read.schema(entry["schema"])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], entry["schema"])

    def _deltas(self, entry: dict, deltas: list[dict]) -> DataFrame:
        """All rows of the deltas with their sequence and kind."""
        rows = self.spark.createDataFrame([], f"{entry['schema']}, _seq bigint, _kind string")
        for d in deltas:
            one = self.spark.read.parquet(f"{self.root}/{d['path']}").withColumns({"_seq": F.lit(d["seq"]).cast("bigint"), "_kind": F.lit(d["kind"])})
            rows = rows.unionByName(one, allowMissingColumns=True)
        return rows

    def _folded(self, entry: dict, base: DataFrame, deltas: list[dict]) -> DataFrame:
        deltas = [d for d in deltas if d["rows"]]
        if not deltas:
            return base
        if not entry["base"] and len(deltas) == 1 and deltas[0]["kind"] == "upsert":
            # the first rows of a table, once a key: there is nothing to fold
            return self.spark.read.schema(entry["schema"]).parquet(f"{self.root}/{deltas[0]['path']}")
        key, columns = entry["key"], base.columns
        changes = self._deltas(entry, deltas)
        named, few = changes.select(key).distinct(), sum(d["rows"] for d in deltas) <= BROADCAST_KEYS
        rest = base.join(F.broadcast(named), key, "left_anti") if few else None
        old = base.join(F.broadcast(named), key, "left_semi") if few else base
        # changes alone are gathered by key; rows of the base meet them once and travel in no list
        steps = changes.groupBy(key).agg(F.collect_list(F.struct("_seq", F.struct("_kind", *columns).alias("_row"))).alias("_steps"))
        in_order = F.array_sort(F.coalesce("_steps", F.array().cast(steps.schema["_steps"].dataType)), lambda a, b: F.when(a["_seq"] < b["_seq"], -1).when(a["_seq"] > b["_seq"], 1).otherwise(0))
        types = {f.name: f.dataType for f in base.schema}
        met = old.select(key, F.struct(*columns).alias("_old")).join(steps, key, "full_outer")
        folded = met.select(fold(in_order, types, key, entry["keep"], F.col("_old")).alias("_r")).where("_r._kind = 'alive'").select(*[F.col("_r").getField(c).alias(c) for c in columns])
        return folded if rest is None else rest.unionByName(folded)

    # --- writing ---

    def ensure(self, **tables: tuple[str, str, tuple[str, ...]]) -> None:
        """Adds the tables {name: (columns as DDL, key, columns that upserts keep)} that are not there yet, without rows."""
        if not set(tables) - set(self._state()["tables"]):
            return
        made = {n: {"key": key, "keep": list(keep), "schema": _ddl(self.spark.createDataFrame([], ddl)), "base": {}, "deltas": []} for n, (ddl, key, keep) in tables.items()}
        self._commit(lambda now, _: made | now)

    def replace(self, tables: dict[str, tuple[DataFrame, str, tuple[str, ...]]], since: int | None = None) -> int:
        """Writes whole tables {name: (rows, key, columns that upserts keep)} in one commit; gives its version.

        since: the version that the rows were computed from; a table that has changed after it is a Conflict, as is one that changes meanwhile.
        """
        seen = self._state()
        if since is not None and since != seen["version"]:
            old = json.loads(self.spark.read.text(f"{self.root}/POINTER-{since:012d}", wholetext=True).first()[0])["tables"] if since else {}
        else:
            old = seen["tables"]
        made = {n: {"key": key, "keep": list(keep), "schema": _ddl(rows), "base": self._write_base(n, key, rows), "deltas": []} for n, (rows, key, keep) in tables.items()}

        def change(now: dict, version: int) -> dict:
            for n, entry in made.items():
                if now.get(n) != old.get(n):
                    raise Conflict(f"{n} was committed by another writer")
                now[n] = entry
            return now

        return self._commit(change)

    def append(self, *deltas: Delta) -> int:
        """Appends all deltas in one commit, whatever other writers append; gives its version.

        Of several rows of a key in an upsert or a patch any one counts; those of a bump are added up before they are written.
        """
        seen, made = self._state()["tables"], []
        for d in deltas:
            if d.kind not in KINDS:
                raise ValueError(f"{d.kind} is none of {KINDS}")
            entry, path = seen[d.table], self._folder(d.table)
            types = {f.name: f.dataType for f in _schema(self.spark, entry["schema"])}
            rows = d.rows.select(*[F.col(c).cast(types[c]).alias(c) for c in d.rows.columns])
            if d.kind == "upsert" and set(rows.columns) != set(types):
                raise ValueError(f"an upsert has all columns of {d.table}")
            if d.kind == "bump":
                more = [(F.sum(c) if _is_count(types[c]) else F.max(c)).cast(types[c]).alias(c) for c in rows.columns if c != entry["key"]]
                rows = rows.groupBy(entry["key"]).agg(*more)
            elif not d.once:
                rows = rows.dropDuplicates([entry["key"]])
            rows.where(F.col(entry["key"]).isNotNull()).write.parquet(f"{self.root}/{path}")
            made.append((d.table, entry["key"], {"path": path, "kind": d.kind, "rows": self.spark.read.parquet(f"{self.root}/{path}").count()}))

        def change(now: dict, version: int) -> dict:
            for i, (name, key, delta) in enumerate(made):
                if name not in now or now[name]["key"] != key or now[name]["schema"] != seen[name]["schema"]:
                    raise Conflict(f"{name} has other columns by now")
                now[name]["deltas"].append(delta | {"seq": version * 1000 + i})
            return now

        version = self._commit(change)
        for name in {d.table for d in deltas}:
            if len(self._state()["tables"][name]["deltas"]) >= MOST_DELTAS:
                try:
                    self.compact(name)
                except Conflict:
                    pass  # another writer has just compacted it; what was appended here is committed
        return version

    def compact(self, table: str) -> list[str]:
        """Folds the deltas that are there now into new folders of the buckets they touch; gives these. Deltas appended meanwhile stay."""
        entry = self._state()["tables"][table]
        taken = entry["deltas"]
        if not taken:
            return []
        key = entry["key"]
        touched = sorted({str(r[0]) for r in self._deltas(entry, taken).select(self._bucket(key)).distinct().collect()})
        rows = self._folded(entry, self._base(entry, [b for b in touched if b in entry["base"]]), taken)
        new = self._write_base(table, key, rows)

        def change(now: dict, version: int) -> dict:
            there = now.get(table, {"base": {}, "deltas": []})
            if there["base"] != entry["base"] or there["deltas"][: len(taken)] != taken:
                raise Conflict(f"{table} was replaced or compacted by another writer")
            there["base"] = {b: f for b, f in there["base"].items() if b not in touched} | new
            there["deltas"] = there["deltas"][len(taken) :]
            return now

        self._commit(change)
        return touched


def _is_count(kind) -> bool:
    return kind.typeName() in ("integer", "long", "short", "double", "float") or kind.typeName().startswith("decimal")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def fold(steps: Column, types: dict, key: str, keep: list[str], old: Column) -> Column:
    """One row (_kind, columns) from a key's old row, null if there is none, and its steps (_seq, _row (_kind, columns)) in order; _kind is ``alive``, or ``gone``.

    An upsert replaces the row but for the columns that it keeps; a patch puts the values it has; a bump adds numbers and takes the later of
    other values; these two change no row that is not there.
    """
    first = F.struct(F.when(old.isNull(), "gone").otherwise("alive").alias("_kind"), *[old[c].alias(c) for c in types])

    def bumped(old: Column, new: Column, c: str) -> Column:
        if c == key or types[c].typeName() in ("array", "map", "struct", "variant"):
            return old
        more = F.coalesce(old, F.lit(0).cast(types[c])) + new if _is_count(types[c]) else F.greatest(old, new)
        return F.when(new.isNull(), old).otherwise(more.cast(types[c]))

    def step(row: Column, s: Column) -> Column:
        new, alive = s["_row"], row["_kind"] == "alive"
        kind = new["_kind"]
        out = []
        for c in types:
            put = F.when(alive, row[c]).otherwise(new[c]) if c in keep else new[c]
            out.append(F.when(kind == "upsert", put).when(alive & (kind == "patch"), F.coalesce(new[c], row[c])).when(alive & (kind == "bump"), bumped(row[c], new[c], c)).otherwise(row[c]).alias(c))
        state = F.when(kind == "upsert", "alive").when(kind == "delete", "gone").otherwise(row["_kind"])
        return F.struct(state.alias("_kind"), *out)

    return F.aggregate(steps, first, step)
