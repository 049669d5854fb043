"""Snapshots, corpora, listings and briefs: reading and writing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored, tidy
from ..schema import SCHEMA_VERSION

_FACT = "struct<kind:string,key:string,name:string,path:string,line:int,attrs:map<string,string>>"
_SNAPSHOT = f"snapshot_id string, ref string, milestone int, created string, schema int, meta struct<target_set:string,partitions:array<string>,complete:boolean,missing_targets:array<string>,parse_errors:int>, facts array<{_FACT}>"
_BRIEF = "struct<name:string,feature_name:string,shortname:string,id:bigint,summary:string,category:string,standards:struct<spec:string>,browsers:struct<chrome:struct<desktop:string,windows:string>,ff:struct<view:struct<text:string>>,safari:struct<view:struct<text:string>>>>"


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, facts) of snapshot JSON documents; a fact's name defaults to its key, path to '', line to 0.

    Attribute values stay the JSON text that the file has.
    """
    rows = spark.read.schema(_SNAPSHOT).option("multiLine", False).json(path)
    headers = rows.select("snapshot_id", "ref", "milestone", F.try_to_timestamp("created").alias("created"), "meta.target_set", "meta.partitions", "meta.complete", "meta.missing_targets", "meta.parse_errors", "schema")
    some = rows.select("snapshot_id", F.explode("facts").alias("f"))
    facts = some.select("snapshot_id", "f.kind", "f.key", F.coalesce("f.name", "f.key").alias("name"), F.coalesce("f.path", F.lit("")).alias("path"), F.coalesce("f.line", F.lit(0)).alias("line"), F.coalesce("f.attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
    return headers, facts


def fresh_snapshots(headers: DataFrame, version: int = SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """S3: (snapshots written at this schema version, ids of those to build again)."""
    good = headers.where(F.col("schema") == version)
    return good, headers.select("snapshot_id").join(good.select("snapshot_id"), "snapshot_id", "left_anti")


def list_files(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """(snapshot_id, path, size) of all files below ``path``, empty and hidden ones too.

    Spark's own file sources leave both out. The names pass through the driver, as those of Spark's
    file index do; for trees of many millions of files hand ``read_corpus`` a listing instead.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        one = files.next()
        name = one.getPath().toString().removeprefix(base)
        if not name.endswith(".crc") or not name.rsplit("/", 1)[-1].startswith("."):
            found.append((snapshot_id, name, one.getLen()))
    return spark.createDataFrame(found, "snapshot_id string, path string, size long")


def read_corpus(spark: SparkSession, path: str, snapshot_id: str, listing: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, path, text, size, error): a row for every file of the listing, and for each that was read.

    ``listing`` has the paths that should be there; without one it is what is found below
    ``path``. Bytes that are no UTF-8 are replaced. A file is read by the task that has it,
    guarded: one that fails (a wrong checksum, cut short, no permission) or has vanished since it
    was listed ends neither the task nor the job. Such a file's row has a null text and an error;
    an empty file has an empty text. What was read is stored once, and listed files without a read are
    found by their paths alone, so texts are neither shuffled nor read twice.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)
    root = re.sub("^[a-z]+:/*", "/", path.rstrip("/") + "/")
    place = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), root, -1)
    whole = F.length("content") == F.col("length")
    read = rows.select(place.alias("path"), F.when(whole, F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.col("length").alias("size"), F.when(~whole, "cut short").alias("error"))
    read = stored(read, "corpus")
    # What is there now: also the empty files, which Spark's file index leaves out.
    there = list_files(spark, path, snapshot_id).select("path", "size")
    files = there if listing is None else listing.select("path").distinct().join(there, "path", "left")
    error = F.when(F.col("size").isNull(), "missing").when(F.col("size") > 0, "not readable")
    lost = files.join(read.select("path"), "path", "left_anti").select("path", F.when(F.col("size") == 0, "").alias("text"), "size", error.alias("error"))
    return read.unionByName(lost).select(F.lit(snapshot_id).alias("snapshot_id"), "path", "text", "size", "error")


def read_listing(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """A text file of paths, without empty lines."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.lit(snapshot_id).alias("snapshot_id"), F.trim("value").alias("path"))


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Changes, findings or documents, nested, as Parquet or JSON; compressed, as JSON is a tenth then."""
    with tidy(rows.sparkSession):
        rows.write.mode("overwrite").format(kind).option("compression", {"json": "gzip"}.get(kind, "zstd")).save(path)


def read_feature_briefs(spark: SparkSession, path: str, milestone: int, between: str | None = None) -> DataFrame:
    """Feature briefs of JSON texts, each a flat array or a map of shipping type to array, after an anti-inclusion prefix.

    A file is one text; with ``between`` files hold several, with that text between them.
    """
    read = spark.read.text(path, wholetext=True) if between is None else spark.read.text(path, lineSep=between)
    text = read.select(F.regexp_replace("value", r"^\)\]\}'\s*", "").alias("t"))
    nested = text.where(F.col("t").rlike(r"^\s*\{")).select(F.explode(F.from_json(F.coalesce(F.get_json_object("t", "$.features_by_type"), F.col("t")), f"map<string,array<{_BRIEF}>>")).alias("shipping_type", "some")).select("shipping_type", F.explode("some").alias("b"))
    flat = text.where(F.col("t").rlike(r"^\s*\[")).select(F.lit("").alias("shipping_type"), F.explode(F.from_json("t", f"array<{_BRIEF}>")).alias("b"))
    return nested.unionByName(flat).select(F.lit(milestone).alias("milestone"), "b.*", "shipping_type")
