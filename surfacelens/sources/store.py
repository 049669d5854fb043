"""Snapshots in a folder: written in full beside what is there, then switched to by one rename.

``data/version=<id>/part=<n>`` has the facts of one snapshot of one commit, bucketed by (kind,
key); ``manifests/<number>`` says which of them are current. A manifest is written under
another name and renamed to the next number; the rename fails if someone else took the number,
and is tried again on top of theirs. Readers take the highest number once, so that they see the
folder as it was before a commit or after it. The file system must rename a file in one step and
not over another one.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import tidy
from ..functions.columns import packed, unpacked
from ..schema import FACT, SNAPSHOT

_DIGITS = 20


def snapshot_key(headers: DataFrame) -> DataFrame:
    """What a stored snapshot may stand in for: reference, target set, sorted partitions, completeness."""
    return headers.withColumn("cache_key", F.concat_ws("|", "ref", "target_set", F.array_join(F.array_sort(F.coalesce("partitions", F.array().cast("array<string>"))), ","), F.coalesce("complete", F.lit(False)).cast("string")))


class _Folder:
    """The file system calls that a commit needs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root, self.conf = path.rstrip("/"), spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file in full and give it its name; False if the name is taken."""
        spare = f"manifests/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(spare), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(self.at(spare)), self.fs.makeQualified(self.at(name)), plain)
        except Py4JJavaError as e:
            self.fs.delete(self.at(spare), False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


def _current(folder: _Folder) -> tuple[int, list[dict]]:
    """(number, entries) of the current manifest."""
    numbers = [int(n) for n in folder.names("manifests") if n.isdigit()]
    if not numbers:
        return 0, []
    return max(numbers), [json.loads(x) for x in folder.read(f"manifests/{max(numbers):0{_DIGITS}d}").splitlines()]


def write_snapshot(facts: DataFrame, headers: DataFrame, path: str, buckets: int | None = None) -> int:
    """Commit the snapshots of ``headers`` with their ``facts`` (one row per identity); returns the commit's number.

    A snapshot takes the place of the stored one that covers the same (``snapshot_key``) and has
    the same id; one of a part of the tree never that of a wider one. All of a commit becomes
    visible at once, a header without facts too. Facts are bucketed by (kind, key), in as many
    buckets as the folder has already, else ``buckets`` (by default the number of shuffle
    partitions), so that a comparison needs no shuffle. Headers are as many as snapshots and go
    through the driver.
    """
    spark, folder, version = facts.sparkSession, _Folder(facts.sparkSession, path), uuid.uuid4().hex
    known = [r.asDict() for r in snapshot_key(headers).select("cache_key", "snapshot_id", F.to_json(F.struct(*[c.split()[0] for c in SNAPSHOT.split(", ") if c.split()[0] in headers.columns])).alias("header")).distinct().collect()]
    entries = [r | {"version": version, "part": k} for k, r in enumerate(sorted(known, key=lambda r: (r["cache_key"], r["snapshot_id"])))]
    n = next((r["buckets"] for r in _current(folder)[1]), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = [r | {"buckets": n} for r in entries]
    parts = spark.createDataFrame([(r["snapshot_id"], r["part"]) for r in entries], "snapshot_id string, part int")
    table = f"surfacelens_{version}"
    # Attributes are sent as one text, less than half of their map's size.
    rows = facts.select(*[c.split()[0] for c in FACT.split(", ")]).withColumn("attrs", packed("attrs")).join(F.broadcast(parts), "snapshot_id").repartition(n, "kind", "key").withColumn("attrs", unpacked(F.col("attrs")))
    with tidy(spark):
        rows.write.format("parquet").option("compression", "zstd").bucketBy(n, "kind", "key").sortBy("kind", "key").partitionBy("part").option("path", str(folder.at(f"data/version={version}").toString())).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: the folder is not the table's
    same = {(r["cache_key"], r["snapshot_id"]) for r in entries}
    while True:
        number, old = _current(folder)
        kept = [r for r in old if (r["cache_key"], r["snapshot_id"]) not in same]
        text = "\n".join(json.dumps(r) for r in [*kept, *entries])
        if folder.publish(f"manifests/{number + 1:0{_DIGITS}d}", text):
            return number + 1


def _wanted(spark: SparkSession, path: str, wanted: DataFrame | None) -> tuple[_Folder, list[dict]]:
    folder = _Folder(spark, path)
    entries = _current(folder)[1]
    if wanted is not None:
        keys = {tuple(r) for r in snapshot_key(wanted).select("cache_key", "snapshot_id").distinct().collect()}
        entries = [r for r in entries if (r["cache_key"], r["snapshot_id"]) in keys]
    return folder, entries


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all current snapshots."""
    entries = _wanted(spark, path, None)[1]
    rows = spark.createDataFrame([(r["header"],) for r in entries], "header string")
    return rows.select(F.from_json("header", SNAPSHOT).alias("h")).select("h.*")


def read_facts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Facts of the current snapshots; with ``wanted`` (headers) only of those that cover exactly the same.

    One commit is read to the end, whatever is committed meanwhile. The facts are a table in the
    session's catalog that points at the folder, bucketed by (kind, key) over all snapshots.
    """
    folder, entries = _wanted(spark, path, wanted)
    there = {v: set(folder.names(f"data/version={v}")) for v in {r["version"] for r in entries}}
    some = [r for r in entries if f"part={r['part']}" in there[r["version"]]]  # a snapshot without facts has no folder
    if not some:
        return spark.createDataFrame([], FACT)
    table = f"surfacelens_{zlib.crc32(folder.root.encode()):08x}_{some[0]['buckets']}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({FACT}, version STRING, part INT) USING parquet PARTITIONED BY (version, part) CLUSTERED BY (kind, key) SORTED BY (kind, key) INTO {some[0]['buckets']} BUCKETS LOCATION '{folder.at('data').toString()}'")
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(f"PARTITION (version='{r['version']}', part={r['part']})" for r in some))
    current = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("part").isin(*[r["part"] for r in some if r["version"] == v]) for v in sorted({r["version"] for r in some})])
    return spark.table(table).where(current).drop("version", "part")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions and manifests that the last ``keep`` commits don't name; returns the versions' names. Readers of older commits must be done."""
    folder = _Folder(spark, path)
    numbers = sorted(int(n) for n in folder.names("manifests") if n.isdigit())
    live = {json.loads(x)["version"] for n in numbers[-keep:] for x in folder.read(f"manifests/{n:0{_DIGITS}d}").splitlines()}
    gone = [v for v in folder.names("data") if v.removeprefix("version=") not in live]
    for n in numbers[:-keep]:
        folder.fs.delete(folder.at(f"manifests/{n:0{_DIGITS}d}"), False)
    for v in gone:
        folder.fs.delete(folder.at(f"data/{v}"), True)
    return gone
