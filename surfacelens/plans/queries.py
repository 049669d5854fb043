"""The registered queries of the library's operators, over facts, listings and corpora derived from the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import stored
from ..functions.columns import attr, platform_value, skip_reason
from ..operators import coverage, diff, enrich, facts, graph, scoring, signals, summaries, words
from ..sources import fixtures
from . import corpus, report

MILESTONE = 40
Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.raw_facts(spark, sf)


def _facts(spark: SparkSession, sf: str, kinds: tuple[str, ...]) -> DataFrame:
    """Facts of the kinds that a query is about, for one that reads them several times."""
    return stored(facts.dedupe_facts(_raw(spark, sf).where(F.col("kind").isin(*kinds))), "facts")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return diff.compare(_raw(spark, sf), fixtures.headers(spark), fixtures.pairs(spark), MILESTONE, declared=True)


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    """Changes before renames and repoints are paired."""
    return diff.diff_snapshots(_raw(spark, sf), fixtures.pairs(spark), MILESTONE, declared=True)


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_join(fixtures.listing(spark, sf), fixtures.scope(spark))


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, a row a snapshot and surface: written once, as scores look it up three ways."""
    return stored(coverage.coverage(_covered(spark, sf)), "coverage")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings for a query that reads them once: only the columns that it needs are worked out."""
    return scoring.score_changes(_changes(spark, sf), _coverage(spark, sf), fixtures.headers(spark), fixtures.pairs(spark))


def _stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings for a query that reads them several times."""
    return stored(_findings(spark, sf), "findings")


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = _stored_findings(spark, sf)
    return found, stored(graph.build_clusters(graph.link_findings(found)), "clusters")


def _join(items: str | Column, mark: str = ",") -> Column:
    return F.array_join(items, mark)


def _long(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("long").alias(alias or name)


def _moves() -> Column:
    return _join(F.transform("deltas", lambda d: F.concat(d["attr"], F.lit(": "), F.coalesce(d["old"], F.lit("-")), F.lit(" > "), F.coalesce(d["new"], F.lit("-")))), "; ")


def dedupe_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A1 to A4, J11."""
    text = lambda name: F.coalesce(attr("attrs", name), F.lit(""))
    rows = facts.dedupe_facts(_raw(spark, sf))
    return rows.select("snapshot_id", "kind", "key", "name", "path", "line", platform_value("attrs", "platform_state").alias("state"), text("signatures").alias("signatures"), text("overload_traits").alias("traits"), text("overload_locations").alias("places"))


def keep_lowest(spark: SparkSession, sf: str) -> DataFrame:
    """W1."""
    return facts.keep_lowest(_raw(spark, sf)).select("snapshot_id", "kind", "key", "path", "line")


def overload_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3."""
    rows = facts.dedupe_facts(_raw(spark, sf).where(F.col("kind") == facts.OVERLOADED)).where(attr("attrs", "signatures").isNotNull())
    return rows.select("snapshot_id", "key", attr("attrs", "signatures").alias("signatures"), F.coalesce(attr("attrs", "overload_traits"), F.lit("")).alias("traits"))


def count_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return facts.count_by_kind(facts.dedupe_facts(_raw(spark, sf)))


def stamp_platform_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """J11 on raw declarations."""
    return facts.stamp_platform_dirs(_raw(spark, sf)).groupBy("snapshot_id", "kind", platform_value("attrs", "platform_state").alias("state")).agg(F.count("*").alias("n_rows"))


def interface_shape(spark: SparkSession, sf: str) -> DataFrame:
    """A23."""
    return facts.interface_shape(facts.dedupe_facts(_raw(spark, sf))).withColumn("members", _join("members"))


def meaningful_attrs(spark: SparkSession, sf: str) -> DataFrame:
    """F11, all kinds."""
    return diff.meaningful_attrs(facts.dedupe_facts(_raw(spark, sf))).select("snapshot_id", "kind", "key", _join(F.array_sort(F.map_keys("attrs"))).alias("names"))


def member_position(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as members of their order."""
    rows = fixtures.read_sql(spark, sf, "SELECT DISTINCT 'v1' AS snapshot_id, l_orderkey AS declaration, l_partkey AS offset, concat('f', l_partkey) AS member, l_orderkey % 3 = 0 AS stable FROM {lineitem}")
    return facts.member_position(rows).select("declaration", "member", _long("position"))


def occurrence_index(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as elements of their order's page."""
    rows = fixtures.read_sql(spark, sf, "SELECT DISTINCT 'v1' AS snapshot_id, concat('p', l_orderkey % 500) AS path, concat('tag-', l_suppkey % 7) AS tag, l_orderkey * 100000 + l_partkey AS offset, CASE WHEN l_partkey % 5 = 0 THEN 'id' ELSE '' END AS identity FROM {lineitem}")
    return facts.occurrence_index(rows).select("path", "offset", "identity")


def diff_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Changes with the values that moved."""
    return _differences(spark, sf).select("kind", "key", "change_type", _moves().alias("deltas"))


def compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    """J1, J2 of five pairs of four versions in one pass: changes by pair, kind and direction, how many values moved, and how long they are."""
    moves = diff.diff_snapshots(fixtures.raw_facts(spark, sf, True), fixtures.chain_pairs(spark), MILESTONE, declared=True).select("pair_id", "kind", "change_type", F.size("deltas").cast("long").alias("moves"), F.length(_moves()).cast("long").alias("chars"))
    return moves.groupBy("pair_id", "kind", "change_type").agg(F.count("*").alias("n"), F.sum("moves").alias("n_moves"), F.sum("chars").alias("n_chars"))


def change_places(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and places of paired changes."""
    return _changes(spark, sf).select("kind", "key", "name", _join("paths").alias("paths"), _join("locations").alias("places"))


def change_signals(spark: SparkSession, sf: str) -> DataFrame:
    """C1 to C20 on paired changes."""
    return _changes(spark, sf).select("kind", "key", "change_type", _join(F.array_sort("signals")).alias("signals"), signals.leading_signal().alias("lead"), "severity", signals.bucket_of().alias("bucket"), signals.owner_of().alias("owner"), signals.group_of().alias("consequence"))


def detect_renames(spark: SparkSession, sf: str) -> DataFrame:
    """J5."""
    rows = stored(_differences(spark, sf), "changes")
    return diff.detect_renames(rows).where(F.exists("deltas", lambda d: d["attr"] == "value")).select("kind", "key", "name")


def detect_repoints(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    rows = stored(_differences(spark, sf), "changes")
    merged = diff.detect_repoints(rows).where((F.col("kind") == "webui_control") & F.col("name").contains(" -> "))
    return merged.select("kind", "key", F.array_contains("signals", "ui_control_type_changed").alias("retyped"), _moves().alias("deltas"))


def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A6 over Z1: the flagship."""
    return summaries.change_summary(_changes(spark, sf)).drop("pair_id")


def rank_changes(spark: SparkSession, sf: str) -> DataFrame:
    """W8."""
    return diff.rank_changes(_changes(spark, sf)).select("kind", "key", _long("rank", "place"))


def resolve_gates(spark: SparkSession, sf: str) -> DataFrame:
    """J4."""
    some, pairs = _facts(spark, sf, ("idl_member", *diff.GATES)), fixtures.pairs(spark)
    rows = diff.resolve_gates(diff.join_pair(some, pairs), some, pairs).where(F.col("kind").isin("idl_member", "idl_interface") & (F.col("o").isNull() | F.col("n").isNull()))
    return rows.select("kind", "key", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change_type"), F.coalesce(F.col("reachable").cast("string"), F.lit("unknown")).alias("reachable"))


def comparable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs, why they can't be compared, and what their newer side lacks."""
    rows, pairs, headers = facts.dedupe_facts(_raw(spark, sf)), fixtures.pairs(spark, True), fixtures.headers(spark)
    small = rows.where("snapshot_id = 'v2' and kind in ('mojo_enum', 'pref')").withColumn("snapshot_id", F.lit("v4"))
    sizes = diff.lopsided(rows.unionByName(small), pairs).withColumnRenamed("reason", "lopsided")
    gaps = scoring.incomplete_reason(headers).withColumnRenamed("snapshot_id", "to_id")
    out = diff.comparable(headers, pairs).join(sizes, "pair_id").join(gaps, "to_id", "left")
    return out.select("pair_id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("lopsided", F.lit("")).alias("lopsided"), "from_facts", "to_facts", F.coalesce("gap", F.lit("")).alias("gap"))


def score_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with their reasons."""
    return _findings(spark, sf).select("kind", "key", "score", "bucket", "owner", "outside", _join("reasons", "; ").alias("reasons"))


def rank_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Z2, W9."""
    rows = scoring.rank(_changes(spark, sf), _coverage(spark, sf), fixtures.headers(spark), fixtures.pairs(spark))
    return rows.select("kind", "key", _long("rank", "place"))


def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return summaries.finding_summary(_findings(spark, sf)).drop("pair_id")


def owner_bucket_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    return summaries.owner_bucket_matrix(_findings(spark, sf)).drop("pair_id")


def measured_figures(spark: SparkSession, sf: str) -> DataFrame:
    """A9."""
    return summaries.measured_figures(_findings(spark, sf)).drop("pair_id")


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """A18, C21, W11."""
    return summaries.order_stories(summaries.stories(_findings(spark, sf))).drop("pair_id").withColumnRenamed("group", "consequence").withColumn("place", _long("place"))


def screens(spark: SparkSession, sf: str) -> DataFrame:
    """A19, C22, W11."""
    return summaries.order_screens(summaries.screens(_findings(spark, sf))).drop("pair_id").withColumn("place", _long("place"))


def screen_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A20."""
    return summaries.screen_totals(_findings(spark, sf)).drop("pair_id")


def screen_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve of each screen."""
    return summaries.order_screen_items(_findings(spark, sf), 12).select("screen", "kind", "key", _long("place"))


def describe(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding in words, and where it is."""
    return _findings(spark, sf).select("kind", "key", words.describe().alias("what"), words.where_of().alias("place"))


def top_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Eight of each owner that are no housekeeping, forty of each bucket."""
    found = _stored_findings(spark, sf)
    some = [("owner", summaries.top_n_per_group(found, "owner", 8, F.col("bucket") != "housekeeping")), ("bucket", summaries.top_n_per_group(found, "bucket", 40))]
    parts = [rows.select(F.lit(by).alias("by"), F.col(by).alias("value"), "kind", "key", _long("place"), "remaining") for by, rows in some]
    return parts[0].unionByName(parts[1])


def filter_findings(spark: SparkSession, sf: str) -> DataFrame:
    """by fields and by text."""
    found = _stored_findings(spark, sf)
    some = [("fields", summaries.filter_findings(found, bucket="breaking", owner="native")), ("text", summaries.filter_findings(found, text="PAGE7")), ("both", summaries.filter_findings(found, kind="base_feature", group="Behaviour switches", text="off → on"))]
    parts = [rows.select(F.lit(by).alias("by"), "kind", "key") for by, rows in some]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def flatten_findings(spark: SparkSession, sf: str) -> DataFrame:
    """S7."""
    return summaries.flatten_findings(_findings(spark, sf)).drop("pair_id", "group", "places").withColumnRenamed("where", "spot")


def enrich_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The brief of each finding that has one."""
    rows = enrich.enrich(_findings(spark, sf), fixtures.briefs(spark, sf)).where("brief is not null")
    return rows.select("kind", "key", F.col("brief.id").alias("brief_id"), "brief.name", F.length("brief.summary").cast("long").alias("n_chars"), "brief.spec", F.coalesce("brief.shipping", F.lit("")).alias("shipping"), F.coalesce("brief.shipped_milestone", F.lit("")).alias("shipped"), "brief.ff_position", F.coalesce("brief.safari_position", F.lit("")).alias("safari_position"))


def newest_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """W4, X15."""
    return enrich.newest_feature_per_name(fixtures.briefs(spark, sf)).select("name", "id", "milestone", "summary")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of each milestone, of versions made of orders."""
    rows = fixtures.read_sql(spark, sf, "SELECT concat(100 + o_orderkey % 40, '.0.', o_custkey % 300, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('.', o_orderkey % 120) END) AS version FROM {orders}")
    return enrich.latest_version_per_milestone(rows)


def milestone_span(spark: SparkSession, sf: str) -> DataFrame:
    """Spans between numbers made of orders."""
    rows = fixtures.read_sql(spark, sf, "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20 + 100 AS INT) END AS start, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 30 + 100 AS INT) END AS end FROM {orders}")
    return enrich.milestone_span(rows).select("id", _join(F.transform("milestones", lambda x: x.cast("string"))).alias("milestones"))


def skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    return fixtures.listing(spark, sf).select("snapshot_id", "path", skip_reason(F.col("path")).alias("reason"))


def route_files(spark: SparkSession, sf: str) -> DataFrame:
    """F4, F5."""
    return coverage.route_files(fixtures.listing(spark, sf)).select("snapshot_id", "path", "extractor")


def could_declare(spark: SparkSession, sf: str) -> DataFrame:
    """F6, F2, F3."""
    return coverage.could_declare(fixtures.listing(spark, sf)).select("snapshot_id", "path", F.col("surfaces")[0].alias("surface"))


def candidates_all(spark: SparkSession, sf: str) -> DataFrame:
    """U5."""
    return coverage.candidates_all(fixtures.listing(spark, sf)).select("snapshot_id", "path", _join("surfaces").alias("surfaces"))


def coverage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A10, A11 over J14."""
    return coverage.coverage(_covered(spark, sf)).select("snapshot_id", F.coalesce("surface", F.lit("")).alias("surface"), "candidates", F.col("read").alias("n_read"))


def reaches(spark: SparkSession, sf: str) -> DataFrame:
    """F7."""
    return coverage.reaches(fixtures.listing(spark, sf), fixtures.scope(spark)).select("snapshot_id", "path")


def partition_scope(spark: SparkSession, sf: str) -> DataFrame:
    """What a scope cut to a partition reads of the listings, and what a whole-root scope does."""
    paths, parts = fixtures.listing(spark, sf), fixtures.partitions(spark)
    cut = coverage.partition_scope(fixtures.scope(spark), parts, ["ui"])
    whole = coverage.complete_scope(parts, ["ui"]).crossJoin(F.broadcast(spark.createDataFrame([("v1",), ("v2",)], "snapshot_id string")))
    some = [coverage.reaches(paths, s).select(F.lit(n).alias("scope"), "snapshot_id", "path") for n, s in (("cut", cut), ("whole", whole))]
    return some[0].unionByName(some[1])


def missed_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    return coverage.missed_by_directory(_covered(spark, sf)).withColumn("place", _long("place"))


def missed_by_area(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    return coverage.missed_by_area(_covered(spark, sf))


def multi_surface_files(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    return coverage.multi_surface_files(_covered(spark, sf))


def missed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All unread candidates, and the first forty with how many there are."""
    rows = stored(_covered(spark, sf), "read")
    parts = [coverage.missed_paths(rows, n).select(F.lit(what).alias("listed"), "snapshot_id", "path", _long("place"), F.col("of").alias("n_missed")) for what, n in (("all", None), ("first", 40))]
    return parts[0].unionByName(parts[1])


def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    """W12."""
    return coverage.catalog_order(stored(_covered(spark, sf), "read")).select("snapshot_id", "path", _long("place"))


def scope_violations(spark: SparkSession, sf: str) -> DataFrame:
    """F10, A15."""
    return coverage.violations_by_suffix(coverage.scope_violations(facts.first_places(_raw(spark, sf)), fixtures.scope(spark)))


def unresolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """J7."""
    return graph.unresolved_references(_facts(spark, sf, graph.REFERRING))


def closure_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A16."""
    return graph.closure_summary(graph.unresolved_references(_facts(spark, sf, graph.REFERRING)))


def link_findings(spark: SparkSession, sf: str) -> DataFrame:
    """J8."""
    return graph.link_findings(_stored_findings(spark, sf)).drop("pair_id")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """G1, A21."""
    found, some = _clusters(spark, sf)
    rows = graph.cluster_summary(found, some)
    return rows.select("cluster", "label", "size", "top_score", _join("kinds").alias("kinds"), _join("buckets").alias("buckets"), _join("members").alias("members"))


def order_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 clusters."""
    found, some = _clusters(spark, sf)
    return graph.order_clusters(graph.cluster_summary(found, some)).select("cluster", "size", _long("place"))


def annotate(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in clusters."""
    found, some = _clusters(spark, sf)
    rows = graph.annotate(found, some).where("cluster is not null")
    return rows.select("kind", "key", F.col("cluster.id").alias("cluster"), "cluster.label", "cluster.size", _join("cluster.kinds").alias("kinds"), "cluster.top_score")


def _lines(tables: dict[str, DataFrame], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """All rows of some tables, each as a line of its columns."""
    out = None
    for name, chosen in columns.items():
        one = tables[name].select(F.lit(name).alias("name"), F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in chosen]).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Z3: every row of the report's tables."""
    changes = stored(_changes(spark, sf), "changes")
    found = stored(scoring.score_changes(changes, _coverage(spark, sf), fixtures.headers(spark), fixtures.pairs(spark)), "findings")
    return _lines(report.report(changes, found), REPORT)


def audit_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the audit's tables."""
    return _lines(report.audit(_facts(spark, sf, graph.REFERRING), fixtures.listing(spark, sf), fixtures.scope(spark), facts.first_places(_raw(spark, sf))), AUDIT)


_TURNS = ("n_added", "n_removed", "n_modified")
#: The tables of the report and the audit by the columns that are told.
REPORT = {
    "changes": ("kind", *_TURNS), "findings": ("what", "value", "n"), "owners": ("owner", "breaking", "behaviour", "new", "housekeeping", "total"), "figures": ("owner", "breaking", "no_signal"),
    "stories": ("group", "story", "n", *_TURNS, "severity", "score", "place"), "screens": ("screen", "n", *_TURNS, "score", "place"), "screen_totals": ("n_screens", *_TURNS),
    "screen_items": ("screen", "kind", "key", "place"), "clusters": ("cluster", "size", "place"), "by_owner": ("owner", "kind", "key", "place", "remaining"), "by_bucket": ("bucket", "kind", "key", "place", "remaining"),
    "flat": ("id", "name", "kind", "owner", "bucket", "score", "change_type", "where", "what", "why", "deltas", "reasons"),
}
AUDIT = {
    "coverage": ("snapshot_id", "surface", "candidates", "read"), "directories": ("snapshot_id", "directory", "missed", "place"), "areas": ("snapshot_id", "area", "candidates", "missed", "percent"),
    "shared": ("snapshot_id", "n_files"), "missed": ("snapshot_id", "path", "place", "of"), "unresolved": ("snapshot_id", "link", "source_key", "target"),
    "closure": ("snapshot_id", "link", "n_references", "names", "more"), "violations": ("snapshot_id", "suffix", "n_files"),
}


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dedupe_facts, keep_lowest, overload_sets, count_by_kind, stamp_platform_dirs, interface_shape, meaningful_attrs, member_position, occurrence_index, diff_snapshots, compare_versions, change_places,
        change_signals, detect_renames, detect_repoints, change_summary, rank_changes, resolve_gates, comparable_pairs, score_changes, rank_findings, finding_summary, owner_bucket_matrix,
        measured_figures, stories, screens, screen_totals, screen_items, describe, top_n_per_group, filter_findings, flatten_findings, enrich_findings, newest_briefs, versions, milestone_span,
        route_files, could_declare, candidates_all, reaches, partition_scope, missed_by_directory, missed_by_area, multi_surface_files, missed_paths, catalog_order, scope_violations,
        unresolved_references, closure_summary, link_findings, clusters, order_clusters, annotate, report_tables, audit_tables,
    )
}
QUERIES |= {"skip_reason": skip_reasons, "coverage": coverage_rows} | corpus.QUERIES
