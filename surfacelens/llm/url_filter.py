"""URL rules by a sort-merge range join.

A host's canonical key is its labels in reverse, each ended by a dot: what lies below a host has
the host's key as its prefix, so a rule's host is an interval of keys in byte order, and such
intervals are nested or apart. Urls and rules are sorted by key in one range shuffle. A sweep over
a partition keeps the stack of rules whose interval the key is in; under one host, paths are
sorted too, and a path's rules are the open entries of a second stack of nested prefixes. Rules
that opened in an earlier partition are those of the first key's ancestors: an equi-join on one
key a partition brings them along.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RESULT = ("host", "path", "rule", "verdict")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return _part(url, 2)


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))


def canonical(host: Column) -> Column:
    """Labels of a host in reverse, each ended by a dot: 'www.example.com' is 'com.example.www.'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Host:
    """The rules of one host: their paths in order, each with the entry that it lies in."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.paths: list[str] = []
        self.outer: list[int] = []
        self.open: list[int] = []
        self.found: list[tuple[int, str, str]] = []  # (length of host and path, rule, verdict)

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Take the next rule by path."""
        while self.open and not path.startswith(self.paths[self.open[-1]]):
            self.open.pop()
        if self.open and self.paths[self.open[-1]] == path:
            return  # the same rule, brought along and met again
        self.outer.append(self.open[-1] if self.open else -1)
        self.open.append(len(self.paths))
        self.paths.append(path)
        self.found.append((len(rule), rule, verdict))

    def longest(self, path: str) -> tuple[int, str, str] | None:
        """The rule with the longest path that ``path`` starts with: the entry before it in order, or one that this lies in."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return self.found[at] if at >= 0 else None


class _Sweep:
    """Active rules while keys go up."""

    def __init__(self, default: str) -> None:
        self.default, self.part, self.stack = default, None, []
        self.last: tuple[str, str] | None = None
        self.answer: tuple[str | None, str] = (None, default)

    def move(self, part: int, key: str) -> None:
        """Go to a key; in another partition the stack begins anew."""
        if part != self.part:
            self.part, self.stack, self.last = part, [], None
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(_Host(key))
        self.stack[-1].add(path, rule, verdict)
        self.last = None

    def url(self, key: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict): the longest rule of all active hosts; of equally long ones the deepest host's."""
        if (key, path) != self.last:
            best = None
            for host in self.stack:
                found = host.longest(path)
                if found and (best is None or found[0] >= best[0]):
                    best = found
            self.last, self.answer = (key, path), best[1:] if best else (None, self.default)
        return self.answer


def rule_rows(rules: DataFrame) -> DataFrame:
    """(key, path, rule, verdict), each host and path once."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    rows = rules.select(host.alias("h"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("h != '' and verdict is not null")
    return rows.groupBy("h", "path").agg(F.max("verdict").alias("verdict")).select(canonical(F.col("h")).alias("key"), "path", F.concat("h", "path").alias("rule"), "verdict")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, the rule that decides and its verdict; ``default`` and a null rule where none fits.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the url's path
    starts with the rule's (no '/' is put in for an empty path). The longest rule by characters of
    host and path wins; of equally long ones the one with the deeper host. Of rules with equal
    host and path the verdict last in byte order counts, so 'block' before 'allow'. A null rule
    path is empty; rules with a null or empty host or a null verdict fit nothing.

    A null url, or one without '://', has an empty host and path, fits no rule and gets
    ``default``. Repeated rows are judged each; an empty table stays empty, and without rules
    all get ``default``. Columns of ``urls`` called like the results give way to them. Urls of
    any length are read whole; all columns are shuffled once, so hand in an id and the url.

    A task holds the rules of the hosts above its current key: those of a host with many path
    rules are in the memory of each task that meets urls below it. Rules are never broadcast.
    """
    spark = urls.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [f for f in urls.schema.fields if f.name not in RESULT]
    # One url may make up a third of all rows: rows are told apart by their columns, so that ranges can part them.
    salt = F.xxhash64(*[F.col(f"`{f.name}`") for f in urls.schema.fields if isinstance(f.dataType, T.AtomicType)])
    row = T.StructType(kept)
    target = F.col(f"`{url}`")
    own = urls.select(
        canonical(host_of(target)).alias("key"), F.lit(1).alias("kind"), path_of(target).alias("path"), salt.alias("salt"), host_of(target).alias("host"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row"),
    )
    known = stored(rule_rows(rules), "rules")
    marks = known.select("key", F.lit(0).alias("kind"), "path", F.lit(0).cast("long").alias("salt"), F.lit("").alias("host"), "rule", "verdict", F.lit(None).cast(row).alias("row"))
    ranged = own.unionByName(marks).repartitionByRange(n, "key", "kind", "path", "salt").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "by-key")
    # Hosts above a partition's first one, as deep as rules go: what was open before it began.
    deepest = known.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    labels = F.split(F.substring_index("first", ".", deepest), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.concat(F.array_join(F.slice("labels", F.lit(1), k), "."), F.lit(".")))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first")).withColumn("labels", labels)
    brought = firsts.select("part", F.explode(F.array_distinct(above)).alias("key")).join(known, "key")
    brought = brought.select("key", F.lit(0).alias("kind"), "path", F.lit(0).cast("long").alias("salt"), F.lit("").alias("host"), "rule", "verdict", F.lit(None).cast(row).alias("row"), "part")
    runs = ranged.unionByName(brought).repartitionById(n, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(default)
        for batch in batches:
            part, key, kind, path, rule, verdict = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict"))
            at, rules_, verdicts = [], [], []
            for i, k in enumerate(key):
                state.move(part[i], k)
                if kind[i]:
                    told = state.url(k, path[i])
                    at.append(i)
                    rules_.append(told[0])
                    verdicts.append(told[1])
                else:
                    state.rule(k, path[i], rule[i], verdict[i])
            if at:
                urls_ = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([urls_.column("row"), urls_.column("host"), urls_.column("path"), pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], names=["row", *RESULT])

    out = T.StructType([T.StructField("row", row), *[T.StructField(c, T.StringType()) for c in RESULT]])
    told = runs.mapInArrow(sweep, out)
    return told.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in kept], *RESULT)
