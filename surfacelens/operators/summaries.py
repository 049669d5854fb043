"""Summary tables of changes and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import trim_location
from .ranking import placed
from .signals import story_of
from .words import describe, screen_of, where_of

_TYPES = (rules.ADDED, rules.REMOVED, rules.MODIFIED)


def _directions() -> list[Column]:
    return [F.count_if(F.col("change_type") == t).alias(f"n_{t}") for t in _TYPES]


def change_summary(changes: DataFrame) -> DataFrame:
    """Changes by kind and direction."""
    return changes.groupBy("pair_id", "kind").agg(*_directions())


_WHOLE = ("owner", "bucket", "group", "lead", "outside", "story")


def condensed(findings: DataFrame) -> DataFrame:
    """Findings counted by all that A7 to A9 and A18 to A20 tell apart, in one scan and one aggregation.

    Two grouping sets: owner, bucket, group, leading signal, outside and story (``by_screen`` is
    false), some thousand rows a pair at most; and the screen. Each of those tables sums up these
    rows. What is condensed already stays as it is, so that a stored result serves all of them.
    """
    if "by_screen" in findings.columns:
        return findings
    rows = findings.select("pair_id", *_WHOLE[:-1], story_of(F.col("lead")).alias("story"), screen_of().alias("screen"), "change_type", "severity", "score")
    by = lambda *names: [F.col("pair_id"), *[F.col(f"`{n}`") for n in names]]
    some = rows.groupingSets([by(*_WHOLE), by("screen")], *by(*_WHOLE, "screen"))
    return some.agg((F.grouping("screen") == 0).alias("by_screen"), F.count("*").alias("n"), *_directions(), F.max("severity").alias("severity"), F.max("score").alias("score"))


def _whole(findings: DataFrame) -> DataFrame:
    return condensed(findings).where("not by_screen")


def _number(when: Column | None = None) -> Column:
    """How many findings the condensed rows stand for, of those with a property."""
    return F.sum(F.col("n") if when is None else F.when(when, F.col("n")).otherwise(0))


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in _TYPES]]


def finding_summary(findings: DataFrame) -> DataFrame:
    """Counts by bucket, owner, group and leading signal, in all, and outside our build: (pair_id, what, value, n).

    Buckets and owners without findings come with 0. A pair without findings has no rows.
    """
    one = lambda what, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(what).alias("what"), value.alias("value")))
    counted = [one("bucket", F.col("bucket")), one("owner", F.col("owner")), one("group", F.col("group"), F.col("group") != ""), one("signal", F.col("lead"), F.col("lead") != ""), one("total", F.lit("")), one("not_in_build", F.lit(""), F.col("outside"))]
    rows = _whole(findings).select("pair_id", F.explode(F.array_compact(F.array(*counted))).alias("s"), "n").groupBy("pair_id", "s").agg(F.sum("n").alias("n"))
    slots = [("bucket", b) for b in rules.BUCKETS] + [("owner", o) for o in rules.OWNERS] + [("not_in_build", "")]
    zero = F.array(*[F.struct(F.struct(F.lit(w).alias("what"), F.lit(v).alias("value")).alias("s"), F.lit(0).cast("long").alias("n")) for w, v in slots])
    every = rows.groupBy("pair_id").agg(F.collect_list(F.struct("s", "n")).alias("got"))  # some dozens a pair
    missing = F.filter(zero, lambda z: ~F.exists("got", lambda g: g["s"] == z["s"]))
    return every.select("pair_id", F.explode(F.concat("got", missing)).alias("r")).select("pair_id", "r.s.what", "r.s.value", "r.n")


def owner_bucket_matrix(findings: DataFrame) -> DataFrame:
    """Findings of each owner by bucket, and in all; owners without any are left out."""
    return _whole(findings).groupBy("pair_id", "owner").agg(*[_number(F.col("bucket") == b).alias(b) for b in rules.BUCKETS], _number().alias("total"))


def measured_figures(findings: DataFrame) -> DataFrame:
    """Breaking findings by owner, and findings without a signal."""
    return _whole(findings).groupBy("pair_id", "owner").agg(_number(F.col("bucket") == rules.BREAKING).alias("breaking"), _number(F.col("lead") == "").alias("no_signal"))


def stories(findings: DataFrame) -> DataFrame:
    """Findings by group and story, with counts by direction and the highest severity and score."""
    return _whole(findings).groupBy("pair_id", "group", "story").agg(*_sums(), F.max("severity").alias("severity"), F.max("score").alias("score"))


def screens(findings: DataFrame) -> DataFrame:
    """UI findings by screen."""
    rows = condensed(findings).where("by_screen and screen is not null")
    return rows.select("pair_id", "screen", "n", *[f"n_{t}" for t in _TYPES], "score")


def screen_totals(findings: DataFrame) -> DataFrame:
    """How many screens changed, and by how much."""
    return screens(findings).groupBy("pair_id").agg(F.count("*").alias("n_screens"), *_sums()[1:])


def top_n_per_group(findings: DataFrame, group: str, n: int, where: Column | None = None) -> DataFrame:
    """The first n findings of each group by score, kind and key, and how many remain."""
    rows = findings if where is None else findings.where(where)
    sizes = rows.groupBy("pair_id", group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))
    return placed(rows, ["pair_id", group], [F.desc("score"), F.col("kind"), F.col("key")], n).join(sizes, ["pair_id", group])


def order_screen_items(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """UI findings in reading order within their screen: added, modified, removed; then score, key."""
    turn = F.when(F.col("change_type") == rules.ADDED, 0).when(F.col("change_type") == rules.MODIFIED, 1).otherwise(2)
    # Exploded, the screen is worked out once, not again for the filter and the sort.
    rows = findings.withColumn("screen", F.explode(F.array_compact(F.array(screen_of())))).withColumn("turn", turn)
    return placed(rows, ["pair_id", "screen"], [F.col("turn"), F.desc("score"), F.col("key"), F.col("kind")], limit).drop("turn")


def order_stories(some: DataFrame) -> DataFrame:
    """Stories with their place: severity, count, name. A story is a row, and there are some dozens."""
    return some.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("severity"), F.desc("n"), "story", "group")))


def order_screens(some: DataFrame) -> DataFrame:
    """Screens with their place: count, score, name. A screen is a row, and there are some hundreds."""
    return some.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("n"), F.desc("score"), "screen")))


def filter_findings(findings: DataFrame, bucket: str | None = None, kind: str | None = None, group: str | None = None, owner: str | None = None, text: str | None = None) -> DataFrame:
    """equality filters, and a text searched without regard to case in names, kinds, places, words, signals, reasons and paths."""
    rows = findings
    for name, value in (("bucket", bucket), ("kind", kind), ("group", group), ("owner", owner)):
        rows = rows if value is None else rows.where(F.col(f"`{name}`") == value)
    if text:
        everything = F.lower(F.concat_ws(" ", "name", "kind", "key", where_of(), describe(), F.array_join("signals", " "), F.array_join("reasons", " "), F.array_join("paths", " ")))
        rows = rows.where(F.contains(everything, F.lit(text.lower())))
    return rows


def flatten_findings(findings: DataFrame) -> DataFrame:
    """A flat row for a dashboard: where it is, what it is in words, why it is there, and the first six places and deltas, values cut at 90.

    Deltas of platform attributes show our platform's entry and are left out where that did not move.
    """
    name = F.when(F.col("kind").isin("idl_member", "mojo_method", "mojo_field"), F.col("key")).otherwise(F.col("name"))
    platform = lambda d: d["attr"].isin("platform_state", "platform_status")
    cut = lambda v: F.when(F.length(v) > 90, F.concat(F.substring(v, 1, 89), F.lit("…"))).otherwise(F.coalesce(v, F.lit("-")))
    ours = lambda d, side: F.when(platform(d), F.coalesce(F.get_json_object(d[side], f"$.{rules.PLATFORM}"), F.lit("?"))).otherwise(cut(d[side]))
    kept = F.filter("deltas", lambda d: ~platform(d) | (ours(d, "old") != ours(d, "new")))
    moves = F.transform(F.slice(kept, 1, 6), lambda d: F.concat(d["attr"], F.when(platform(d), f" [{rules.PLATFORM}]").otherwise(""), F.lit(": "), ours(d, "old"), F.lit(" -> "), ours(d, "new")))
    places = F.transform(F.slice(F.when(F.size("locations") > 0, F.col("locations")).otherwise(F.col("paths")), 1, 6), lambda p: trim_location(p))
    return findings.select(
        "pair_id", F.concat_ws(":", "kind", "key").alias("id"), name.alias("name"), "kind", "group", "owner", "bucket", "score", "change_type", where_of().alias("where"),
        describe().alias("what"), story_of(F.col("lead")).alias("why"), F.array_join(places, "; ").alias("places"), F.array_join(moves, "; ").alias("deltas"), F.array_join("reasons", "; ").alias("reasons"),
    )
