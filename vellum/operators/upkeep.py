"""Derived rows kept true to their source without making all of them again.

A `Source` is a table in the shared folder, its rows dealt out to a fixed number of buckets by key, a folder each. An `Upkeep`
holds what is derived from it, bucket by bucket, and a stamp per source row. `sync` goes down three steps and stops at the first
that shows no change:

1. the files: names, sizes and times of each bucket's files make its stamp; no file is opened. Buckets whose stamp is the
   one of the last sync are passed over;
2. the rows of the other buckets: each row's stamp (a hash over all columns) meets the one kept for its key, which tells the keys
   that are new, changed or gone;
3. the derivation runs over the rows of these keys only. Their derived rows take the place of the old ones.

The new files of a bucket are written beside the old ones, and a manifest of a row per bucket, named by its version, is renamed into
place last: a reader sees one version or the next, and a run that is broken off leaves the last version as it was. A derivation has a version of
its own; raising it makes all rows again.

Rows are dealt out by key before the derivation, in parts that each lie in one bucket: one that groups by the key moves source rows
only, never what it makes of them, and its rows are written from where they are made.

Nulls: a null key is a key like any other, and all rows of one key are derived together. Repeated rows count as often as they
are there. An empty source has no derived rows. The derivation is given whole keys and returns rows that carry the key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.session import checkpoints

BUCKETS = 64
#: Bytes of source or stored files that go to a part of a bucket.
PART = 32 << 20
_BUCKET = "__bucket"


def bucket(key: str, buckets: int):
    """The number of a key's bucket: the hash that repartition deals by, so that each of k * buckets parts lies in one bucket."""
    return F.pmod(F.hash(F.col(key)), F.lit(buckets)).cast("int")


def _by_key(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join by a key that may be null."""
    return rows.join(keys.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), how)


def _without(rows: DataFrame, keys: DataFrame, key: str, null: bool) -> DataFrame:
    """Rows whose key isn't among keys; null: null is. Joined by the bare key, so that rows stay in the parts they were dealt to."""
    left = rows.join(keys.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    return left.filter(F.col(key).isNotNull()) if null else left


class Folder:
    """Hadoop's view of a folder, for names and sizes, not for data."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._new = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        p = self._new(f"{self.path}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def drop(self, sub: str) -> None:
        self._fs.delete(self._new(f"{self.path}/{sub}"), True)

    def read(self, name: str) -> str:
        f = self._fs.open(self._new(f"{self.path}/{name}"))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def size(self, sub: str) -> int:
        """Bytes of the files in a folder."""
        p = self._new(f"{self.path}/{sub}")
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def move(self, sub: str, to: str) -> None:
        """A folder put in the place of another."""
        self.drop(to)
        if not self._fs.rename(self._new(f"{self.path}/{sub}"), self._new(f"{self.path}/{to}")):
            raise RuntimeError(f"{sub} could not be put in the place of {to} in {self.path}")

    def put(self, name: str, text: str) -> bool:
        """Written beside and renamed; False if there is one of that name."""
        own = self._new(f"{self.path}/.{uuid.uuid4().hex}")
        f = self._fs.create(own)
        try:
            f.write(bytearray(text.encode()))
        finally:
            f.close()
        if self._fs.exists(self._new(f"{self.path}/{name}")):
            self._fs.delete(own, False)
            return False
        return self._fs.rename(own, self._new(f"{self.path}/{name}"))


class Source:
    """A table of rows by key, which callers replace a bucket at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.folder = Folder(spark, self.path)

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: the folders of others are not listed."""
        there = [n for n in self.folder.names() if n.startswith(f"{_BUCKET}=") and (only is None or int(n.split("=")[1]) in only)]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in there])

    def replace(self, rows: DataFrame) -> None:
        """Put these rows in the place of all rows of their buckets."""
        dealt = rows.withColumn(_BUCKET, bucket(self.key, self.buckets))
        dealt.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def apply(self, upserts: DataFrame, gone: DataFrame) -> None:
        """Rows by key put in the place of stored ones, and keys taken out; only the buckets that they touch are written."""
        changed = upserts.select(self.key).union(gone.select(self.key)).distinct()
        touched = [r[0] for r in changed.select(bucket(self.key, self.buckets)).distinct().collect()]  # no more than there are buckets
        if touched:
            kept = _by_key(self.rows(touched), changed, self.key, "left_anti")
            new = kept.unionByName(upserts.select(*kept.columns)).withColumn(_BUCKET, bucket(self.key, self.buckets))
            beside = f".new-{uuid.uuid4().hex}"  # read from the folders that it will replace
            new.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{beside}")
            left = {int(n.split("=")[1]) for n in self.folder.names(beside) if n.startswith(f"{_BUCKET}=")}
            for b in touched:
                if b in left:
                    self.folder.move(f"{beside}/{_BUCKET}={b}", f"{_BUCKET}={b}")
                else:
                    self.folder.drop(f"{_BUCKET}={b}")
            self.folder.drop(beside)

    def stamps(self) -> dict[int, str]:
        """A stamp per bucket, from names, sizes and times of its files. No file is opened."""
        if not any(n.startswith(f"{_BUCKET}=") for n in self.folder.names()):
            return {}
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.path).select("path", "modificationTime", "length")
        own = files.select(F.regexp_extract("path", f"{_BUCKET}=(-?\\d+)/", 1).cast("int").alias("b"), F.xxhash64("path", F.unix_micros("modificationTime"), "length").alias("h"))
        return {r["b"]: f"{r['n']}:{r['s']}" for r in own.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).collect()}


@dataclass
class Report:
    """What a sync did: version now, buckets read, keys made again and gone."""

    version: int
    buckets: int = 0
    made: int = 0
    gone: int = 0


class Upkeep:
    """The rows that derive(rows of whole keys) gives, kept in a folder."""

    def __init__(self, source: Source, path: str, derive: Callable[[DataFrame], DataFrame], schema: StructType, version: int = 1):
        self.source, self.path, self.derive, self.schema, self.derivation = source, path.rstrip("/"), derive, schema, version
        self.spark, self.key = source.spark, source.key
        self.folder = Folder(self.spark, self.path)
        key = source.schema[source.key]
        self.stamp_schema = StructType().add(key.name, key.dataType).add("stamp", "decimal(38,0)")

    def manifest(self) -> dict:
        versions = [int(n[9:-5]) for n in self.folder.names() if n.startswith("manifest-")]
        if not versions:
            return {"version": 0, "derivation": self.derivation, "buckets": {}}
        return json.loads(self.folder.read(f"manifest-{max(versions):012d}.json"))

    def _read(self, part: str, schema: StructType, buckets: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{b['at']}/{part}/{_BUCKET}={b['bucket']}" for b in buckets]) if buckets else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The derived rows of the current version."""
        return self._read("rows", self.schema, [b for b in self.manifest()["buckets"].values() if b["rows"]])

    def sync(self) -> Report:
        before, stamps = self.manifest(), self.source.stamps()
        old = before["buckets"] if before["derivation"] == self.derivation else {}
        changed = sorted(b for b in {*stamps, *map(int, before["buckets"])} if old.get(str(b), {}).get("stamp") != stamps.get(b))
        if not changed:
            return Report(before["version"])
        checkpoints(self.spark)
        key, of = self.key, [old[str(b)] for b in changed if str(b) in old]
        rows = self.source.rows(changed)
        # Rows of a key add up, in any order.
        now = rows.groupBy(key).agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("stamp"))
        kept = self._read("stamps", self.stamp_schema, [b for b in of if b["stamps"]])
        a, b = now.alias("a"), kept.alias("b")
        met = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
        differ = met.filter(~F.col("a.stamp").eqNullSafe(F.col("b.stamp")))
        differ = differ.select(F.when(F.col("a.stamp").isNotNull(), F.col(f"a.{key}")).otherwise(F.col(f"b.{key}")).alias(key), F.col("a.stamp").isNull().alias("gone")).checkpoint()
        made, gone = differ.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
        parts = self._parts(changed, of)
        # Dealt out before they are derived: all that follows stays in the part of its key.
        fresh = self.derive(_by_key(rows, differ, key, "left_semi").repartition(parts, key))
        whole, kept_buckets = fresh.select(*self.schema.names), [b for b in of if b["rows"]]
        if kept_buckets:
            stored = self._read("rows", self.schema, kept_buckets).repartition(parts, key)
            whole = _without(stored, differ, key, not differ.filter(F.col(key).isNull()).isEmpty()).unionByName(whole)
        at = f"v-{uuid.uuid4().hex}"
        dealt = now.select(*self.stamp_schema.names).withColumn(_BUCKET, bucket(key, self.source.buckets)).repartition(_BUCKET)
        for part, df in (("rows", whole.withColumn(_BUCKET, bucket(key, self.source.buckets))), ("stamps", dealt)):
            df.write.partitionBy(_BUCKET).parquet(f"{self.path}/{at}/{part}")
        there = {part: {int(n.split("=")[1]) for n in self.folder.names(f"{at}/{part}") if n.startswith(_BUCKET)} for part in ("rows", "stamps")}
        entries = {b: x for b, x in old.items() if int(b) not in changed}
        entries |= {str(b): {"bucket": b, "stamp": stamps[b], "at": at, "rows": b in there["rows"], "stamps": b in there["stamps"]} for b in changed if b in stamps}
        version = before["version"] + 1
        if not self.folder.put(f"manifest-{version:012d}.json", json.dumps({"version": version, "derivation": self.derivation, "buckets": entries})):
            raise RuntimeError(f"another sync has written version {version} of {self.path}")
        return Report(version, len(changed), made, gone)

    def _parts(self, changed: list[int], of: list[dict]) -> int:
        """A multiple of the buckets: PART bytes a part in the fullest case, and no fewer than a shuffle has."""
        size = sum(self.source.folder.size(f"{_BUCKET}={b}") for b in changed) + sum(self.folder.size(f"{b['at']}/rows/{_BUCKET}={b['bucket']}") for b in of)
        buckets = self.source.buckets
        return buckets * max(1, -(-max(size // PART, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) // buckets))

    def tidy(self) -> None:
        """Remove what only earlier versions name. Not while these are still read."""
        current = self.manifest()
        used = {b["at"] for b in current["buckets"].values()}
        for n in self.folder.names():
            if n.startswith("v-") and n not in used or n.startswith("manifest-") and int(n[9:-5]) < current["version"]:
                self.folder.drop(n)
