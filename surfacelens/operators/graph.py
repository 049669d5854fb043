"""References between facts, links between findings, and clusters of linked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from ..functions.columns import attr_list, attr_text, feature_name_from_var, norm_identifier
from .ranking import placed

#: Kinds that refer to others or are referred to.
REFERRING = ("webui_route", "webui_gate", "webui_control", "blink_runtime_feature", "feature_param", "base_feature", "pref")
#: Neighbours from which on a node may be a hub, and how many nodes are hubs at most.
HUB, MOST_HUBS = 1 << 20, 10_000


def _with_least(rows: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """(v, m) of rows (u, v) and a row (u, m, n) per u, where n counts its rows; no task gets more than ``hub`` rows of one u, if that is given.

    The least neighbours of hubs are broadcast, so that their rows stay where they are: of N rows
    at most N / hub nodes have more than ``hub``. The other nodes are joined as usual.
    """
    if hub is None:
        return rows.join(least.drop("n"), "u").select("v", "m")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    rest = rows.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= hub).drop("n"), "u")
    return rows.join(hubs, "u").select("v", "m").unionAll(rest.select("v", "m"))


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b, of one orderable type); a component's id is its smallest node.

    Large-star and small-star steps in turn: each links a node's neighbours to the least of
    them. Every round is written and read back, so that lineage stays short. Loops and repeated
    edges do no harm; null ends are left out. A node with more than ``hub`` neighbours, and with
    more than a ``MOST_HUBS``-th of all edges' ends, is a hub: its least neighbour is found from
    every partition's, and broadcast to its edges, which are not gathered.
    """
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    n_edges, before = now.count(), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Where there are too few edges for a hub, none is looked for.
        size = max(hub, 2 * n_edges // MOST_HUBS) if n_edges > hub else None
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, size).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, size).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        n_edges, before = mark[0], mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def unresolved_references(facts: DataFrame) -> DataFrame:
    """References whose target is absent from the snapshot: (snapshot_id, link, source_key, target).

    Features that gates and runtime flags name by their identifier are looked up by name.
    """
    of = lambda kind: facts.where(F.col("kind") == kind)
    many = lambda kind, name: of(kind).select("snapshot_id", "key", F.explode(attr_list("attrs", name)).alias("target"))
    one = lambda kind, name: of(kind).select("snapshot_id", "key", attr_text("attrs", name).alias("target"))
    keys = lambda kind: of(kind).select("snapshot_id", F.col("key").alias("target"))
    bare = lambda rows: rows.withColumn("target", feature_name_from_var(F.col("target")))
    gate_key = attr_text("attrs", "data_key")
    gates = of("webui_gate").select("snapshot_id", F.when(gate_key != "", gate_key).otherwise(F.col("name")).alias("target"))
    links = {
        "page guard": (many("webui_route", "guards"), gates),
        "gate feature": (bare(many("webui_gate", "features")), keys("base_feature")),
        "control preference": (one("webui_control", "pref"), keys("pref")),
        "runtime flag feature": (bare(one("blink_runtime_feature", "base_feature").where("target != 'none'")), keys("base_feature")),
        "parameter feature": (one("feature_param", "feature"), keys("base_feature")),
    }
    out = None
    for name, (rows, targets) in links.items():
        some = rows.where("target != ''").join(targets, ["snapshot_id", "target"], "left_anti").select("snapshot_id", F.lit(name).alias("link"), F.col("key").alias("source_key"), "target")
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def closure_summary(unresolved: DataFrame, n: int = 8) -> DataFrame:
    """Unresolved targets by link: how many references, the first n targets by name, and how many more.

    Only the first n names of a link are ever gathered.
    """
    targets = unresolved.groupBy("snapshot_id", "link", "target").agg(F.count("*").alias("n"))
    sums = targets.groupBy("snapshot_id", "link").agg(F.sum("n").alias("n_references"), F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    first = placed(targets, ["snapshot_id", "link"], ["target"], n).groupBy("snapshot_id", "link").agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("names"))
    return sums.join(first, ["snapshot_id", "link"]).select("snapshot_id", "link", "n_references", "names", "more")


def _both(name: str) -> Column:
    return F.array_distinct(F.filter(F.array(attr_text("before", name), attr_text("after", name)), lambda x: x != ""))


def _lists(name: str) -> Column:
    return F.array_distinct(F.filter(F.concat(attr_list("before", name), attr_list("after", name)), lambda x: x != ""))


def link_findings(findings: DataFrame) -> DataFrame:
    """Edges (pair_id, a, b) between findings that the data links; a and b are 'kind:key'.

    Page to gate by guard, gate to feature, runtime flag and parameter to feature, control to
    page by label or element id. Both sides of a change are read.
    """
    node = F.concat_ws(":", "kind", "key").alias("node")
    of = lambda *kinds: findings.where(F.col("kind").isin(*kinds))
    edge = lambda rows, targets, on: rows.select("pair_id", F.col("node").alias("a"), F.explode(on).alias("t")).join(targets, ["pair_id", "t"]).select("pair_id", "a", "b")
    target = lambda rows, names: rows.select("pair_id", F.explode(names).alias("t"), F.concat_ws(":", "kind", "key").alias("b")).distinct()
    features = target(of("base_feature"), F.array("key"))
    own = F.filter(F.array(attr_text("before", "data_key"), attr_text("after", "data_key"), F.col("name")), lambda x: x != "")
    gates = target(of("webui_gate"), F.slice(own, 1, 1))
    routes = of("webui_route").withColumn("t", norm_identifier(F.col("name"))).where("t != ''")
    first = F.row_number().over(Window.partitionBy("pair_id", "t").orderBy(F.desc("score"), "kind", "key"))
    routes = routes.withColumn("n", first).where("n = 1").select("pair_id", "t", F.concat_ws(":", "kind", "key").alias("b"))
    at = lambda *kinds: of(*kinds).withColumn("node", node)
    named = F.array_distinct(F.filter(F.transform(F.concat(_both("label"), _both("element_id")), lambda x: norm_identifier(x)), lambda x: x != ""))
    out = edge(at("webui_route"), gates, _lists("guards"))
    for part in (
        edge(at("webui_gate"), features, F.transform(_lists("features"), feature_name_from_var)),
        edge(at("blink_runtime_feature"), features, F.array_distinct(F.concat(F.transform(F.filter(_both("base_feature"), lambda x: x != "none"), feature_name_from_var), F.array("key")))),
        edge(at("feature_param"), features, _both("feature")),
        edge(at("webui_control"), routes, named),
    ):
        out = out.unionByName(part)
    return out.where("a != b").distinct()


def build_clusters(edges: DataFrame) -> DataFrame:
    """G1: (pair_id, node, cluster) of linked findings; a cluster's id is its smallest member."""
    keyed = edges.select(*[F.concat_ws("\u0001", "pair_id", c).alias(c) for c in ("a", "b")])
    out = connected_components(keyed)
    part = lambda c, k: F.element_at(F.split(c, "\u0001"), k)
    return out.select(part("node", 1).alias("pair_id"), part("node", 2).alias("node"), part("component", 2).alias("cluster"))


def cluster_summary(findings: DataFrame, clusters: DataFrame, members: int = 200) -> DataFrame:
    """Per cluster: label (name of the highest score; then kind, key), size, score, kinds, buckets, and its first members by score.

    ``size`` counts all; ``members`` bounds how many of a cluster are listed in its row (``build_clusters`` has them all).
    """
    rows = findings.withColumn("node", F.concat_ws(":", "kind", "key")).join(clusters, ["pair_id", "node"])
    order = F.struct((-F.col("score")).alias("s"), "kind", "key", "name")
    out = rows.groupBy("pair_id", "cluster").agg(F.min(order).alias("top"), F.count("*").alias("size"), F.max("score").alias("top_score"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("bucket")).alias("buckets"))
    first = placed(rows.select("pair_id", "cluster", "node", order.alias("o")), ["pair_id", "cluster"], ["o"], members)
    listed = first.groupBy("pair_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("members"))
    return out.join(listed, ["pair_id", "cluster"]).select("pair_id", "cluster", F.col("top.name").alias("label"), "size", "top_score", "kinds", "buckets", "members")


def order_clusters(summary: DataFrame, limit: int = 25) -> DataFrame:
    """The first clusters of a pair by top score and size, then by id."""
    return placed(summary, ["pair_id"], [F.desc("top_score"), F.desc("size"), F.col("cluster")], limit)


def annotate(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Findings with their cluster's id, label, size, kinds and score; null for those in none."""
    summary = cluster_summary(findings, clusters).select("pair_id", F.col("cluster"), F.struct(F.col("cluster").alias("id"), "label", "size", "kinds", "top_score").alias("of"))
    rows = findings.withColumn("node", F.concat_ws(":", "kind", "key")).join(clusters, ["pair_id", "node"], "left")
    return rows.join(summary, ["pair_id", "cluster"], "left").drop("node", "cluster").withColumnRenamed("of", "cluster")
