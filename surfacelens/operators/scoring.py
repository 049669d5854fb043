"""Scores: what a run can prove discounts what it claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import lookup, read_percent, share
from .ranking import placed
from .signals import bucket_of, group_of, leading_signal, not_in_build, owner_of


def evidence_direction() -> Column:
    """The direction a change's evidence points in; a lost overload is a removal."""
    was = F.filter("deltas", lambda d: d["attr"] == "signatures")[0]
    items = lambda j: F.coalesce(F.from_json(j, "array<string>"), F.array().cast("array<string>"))
    lost = F.size(F.array_except(items(was["old"]), items(was["new"]))) > 0
    return F.when(F.exists("deltas", lambda d: d["attr"] == "signatures"), F.when(lost, rules.REMOVED).otherwise(rules.ADDED)).otherwise(F.col("change_type"))


def incomplete_reason(headers: DataFrame) -> DataFrame:
    """What a snapshot misses, in words; '' if nothing."""
    missing, failed = F.size(F.coalesce("missing_targets", F.array().cast("array<string>"))), F.coalesce("parse_errors", F.lit(0))
    text = F.concat_ws(" and ", F.when(missing > 0, F.concat(missing, F.lit(" absent target(s)"))), F.when(failed > 0, F.concat(failed, F.lit(" unreadable file(s)"))))
    return headers.select("snapshot_id", text.alias("gap"))


def surface_share(changes: DataFrame, coverage: DataFrame, pairs: DataFrame, direction: Column | None = None) -> DataFrame:
    """Adds ``share``: the read share of the change's surface on the side its evidence comes from.

    Falls back to that side's overall share, then to the newer side's. A surface that is listed
    but unmeasured is unknown (null). Coverage is a row per snapshot and surface and is looked up three
    ways: give a written table. It is broadcast if Spark finds it small.
    """
    rows = coverage.select("snapshot_id", "surface", share(F.col("candidates"), F.col("read")).alias("s"))
    side = F.when((F.col("change_type") if direction is None else direction) == rules.ADDED, F.col("from_id")).otherwise(F.col("to_id"))
    keyed = changes.join(F.broadcast(pairs), "pair_id").withColumn("side", side).withColumn("surface", lookup(rules.by_member(rules.SURFACES), F.col("kind")))
    own = rows.where("surface is not null").select(F.col("snapshot_id").alias("side"), "surface", F.struct("s").alias("own"))
    overall = rows.where("surface is null").select(F.col("snapshot_id").alias("side"), F.col("s").alias("overall"))
    newer = overall.select(F.col("side").alias("to_id"), F.col("overall").alias("newer"))
    out = keyed.join(own, ["side", "surface"], "left").join(overall, "side", "left").join(newer, "to_id", "left")
    value = F.when(F.col("own").isNotNull(), F.col("own.s")).otherwise(F.coalesce("overall", "newer"))
    return out.withColumn("share", value).select(*changes.columns, "share")


def score_changes(changes: DataFrame, coverage: DataFrame, headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings: changes with score, bucket, owner, group and reasons.

    Not in our build: 0, housekeeping. Otherwise the severity, less a penalty for a claim of
    absence that the run can't confirm; such removals of preferences and switches, and additions
    that cannot be shown to be new, are housekeeping.
    """
    gaps = incomplete_reason(headers)
    side = lambda c, name: gaps.select(F.col("snapshot_id").alias(c), F.col("gap").alias(name))
    gapped = pairs.join(side("from_id", "from_gap"), "from_id", "left").join(side("to_id", "to_gap"), "to_id", "left").select("pair_id", F.coalesce("from_gap", F.lit("")).alias("from_gap"), F.coalesce("to_gap", F.lit("")).alias("to_gap"))
    rows = surface_share(changes.withColumn("direction", evidence_direction()), coverage, pairs, F.col("direction")).join(F.broadcast(gapped), "pair_id")
    direction, removed, added = F.col("direction"), F.col("direction") == rules.REMOVED, F.col("direction") == rules.ADDED
    lead, outside = F.col("lead"), F.col("outside")
    # What several rules ask for is worked out once, a step before them.
    rows = rows.withColumns({"lead": leading_signal(), "outside": not_in_build(), "gap": F.when(added, F.col("from_gap")).otherwise(F.col("to_gap"))})
    confirmed = (F.col("gap") == "") & (F.col("share").isNull() | (F.col("share") >= rules.CONFIRMING))
    absent = removed | (added & (F.col("from_gap") != ""))
    rows = rows.withColumns({"doubtful": absent & ~confirmed & ~outside, "first": bucket_of(lead)})
    rows = rows.withColumn("demoted", F.col("doubtful") & lead.isin(*rules.UNCONFIRMED_SIGNALS))
    rows = rows.withColumn("bucket", F.when(F.col("demoted"), rules.HOUSEKEEPING).otherwise(F.col("first")))
    rows = rows.withColumn("unproven", added & (F.col("bucket") == rules.NEW) & (F.col("from_gap") != "") & ~outside)
    doubtful, demoted, unproven, gap = F.col("doubtful"), F.col("demoted"), F.col("unproven"), F.col("gap")
    headline = F.when(lead != "", F.regexp_replace(lead, "_", " ")).otherwise(F.concat_ws(" ", "change_type", F.regexp_replace("kind", "_", " ")))
    why = F.when(gap != "", F.concat(F.lit("unconfirmed: "), gap)).otherwise(F.concat(F.lit("unconfirmed: "), read_percent(F.col("share")), F.lit(" of that surface was read")))
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("severity "), F.col("severity"), F.lit(": "), headline),
            F.when(outside, F.lit("0: not compiled for our platform on either side")),
            F.when(doubtful, F.concat(F.lit(f"-{rules.PENALTY} "), why, F.when(demoted, "; filed as housekeeping").otherwise(""))),
            F.when(unproven, F.lit("filed as housekeeping: not shown to be new")),
        )
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("severity") - F.when(doubtful, rules.PENALTY).otherwise(0)))
    return rows.select(
        *changes.columns,
        F.when(outside, 0).otherwise(score).cast("int").alias("score"),
        F.when(outside | unproven, rules.HOUSEKEEPING).otherwise(F.col("bucket")).alias("bucket"),
        owner_of(lead).alias("owner"),
        group_of().alias("group"),
        "lead",
        "outside",
        reasons.alias("reasons"),
    )


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings with their place within the pair: score descending, kind, key."""
    return placed(findings, ["pair_id"], [F.desc("score"), F.col("kind"), F.col("key")], name="rank")


def rank(changes: DataFrame, coverage: DataFrame, headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scored changes with their place within the pair."""
    return rank_findings(score_changes(changes, coverage, headers, pairs))
