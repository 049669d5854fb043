"""Feature briefs beside findings, and choices by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import collapse_ws, norm_ascii, parse_version


def cut_text(text: Column, most: int) -> Column:
    """A text in one line, cut at a word's end with '...' if it is longer than ``most``."""
    line = collapse_ws(text)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, most), r"\s+\S*$", ""), F.lit("...")))


def compact_brief(briefs: DataFrame, most: int = 600) -> DataFrame:
    """Briefs with their summary in one line, cut to ``most``, the specification, the milestone that shipped and others' positions; empty ones are null."""
    some = lambda c: F.when(c != "", c)
    shipped = F.coalesce(some(F.col("browsers.chrome.windows")), some(F.col("browsers.chrome.desktop")))
    return briefs.select(
        "milestone", "name", "feature_name", "shortname", "id", some(cut_text(F.col("summary"), most)).alias("summary"), some(F.col("category")).alias("category"), some(F.col("shipping_type")).alias("shipping"),
        some(F.col("standards.spec")).alias("spec"), shipped.alias("shipped_milestone"), some(F.col("browsers.ff.view.text")).alias("ff_position"), some(F.col("browsers.safari.view.text")).alias("safari_position"),
    )


def newest_feature_per_name(briefs: DataFrame) -> DataFrame:
    """The brief of the newest milestone for each name, then the smallest id; nameless ones are left out; summaries cut to 220."""
    turn = Window.partitionBy("name").orderBy(F.desc("milestone"), "id")
    rows = compact_brief(briefs).where("name != ''").withColumn("n", F.row_number().over(turn)).where("n = 1").drop("n")
    return rows.withColumn("summary", cut_text(F.col("summary"), 220))


def enrich(findings: DataFrame, briefs: DataFrame) -> DataFrame:
    """Findings with the brief found by their name, else by their key; housekeeping gets none.

    A brief answers to its name, feature name and short name, without regard to case and signs. Of
    several a later milestone wins, within a milestone the smaller id.
    """
    names = F.array_distinct(F.filter(F.transform(F.array("name", "feature_name", "shortname"), lambda x: norm_ascii(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    rows = compact_brief(briefs)
    keyed = rows.withColumn("t", F.explode(names))
    turn = Window.partitionBy("t").orderBy(F.desc("milestone"), "id")
    some = keyed.withColumn("n", F.row_number().over(turn)).where("n = 1").select("t", F.struct(*rows.columns).alias("b"))
    open_ = F.col("bucket") != rules.HOUSEKEEPING
    asked = findings.withColumns({"t1": F.when(open_, norm_ascii(F.col("name"))), "t2": F.when(open_, norm_ascii(F.col("key")))})
    out = asked.join(some.select(F.col("t").alias("t1"), F.col("b").alias("b1")), "t1", "left").join(some.select(F.col("t").alias("t2"), F.col("b").alias("b2")), "t2", "left")
    return out.withColumn("brief", F.coalesce("b1", "b2")).select(*findings.columns, "brief")


def latest_version_per_milestone(versions: DataFrame) -> DataFrame:
    """The numerically greatest four-part version of each milestone."""
    rows = versions.withColumn("v", parse_version(F.col("version"))).where("v is not null")
    return rows.groupBy(F.element_at("v", 1).alias("milestone")).agg(F.max_by("version", "v").alias("version"))


def milestone_span(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The newest ``limit`` milestones after start up to end; end alone if there is no start before it; none without an end."""
    start, end = F.col("start"), F.col("end")
    span = F.when(end.isNull(), F.array().cast("array<int>")).when(start.isNull() | (start >= end), F.array(end)).otherwise(F.sequence(F.greatest(start + 1, end - limit + 1), end))
    return rows.withColumn("milestones", span)
