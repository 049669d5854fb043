"""Comparison, scoring, coverage and graph operators on small inputs, and queries against DuckDB."""

from __future__ import annotations

import json
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from surfacelens.functions import columns, parsing, rules
from surfacelens.operators import coverage, diff, facts, graph, scoring, signals, summaries
from surfacelens.operators.ranking import placed
from surfacelens.plans import oracles
from surfacelens.plans import queries as library
from surfacelens.sources import fixtures

SF = "/root/testdata/sf0.001"
FACT = "snapshot_id string, kind string, key string, name string, path string, line int, attrs map<string,string>"


def fact(v, kind, key, path="a/b.cc", line=1, **attrs):
    return (f"v{v}", kind, key, key, path, line, {k: json.dumps(x, sort_keys=True, separators=(",", ":")) for k, x in attrs.items()})


def compared(spark, rows, milestone=None):
    table = spark.createDataFrame(rows, FACT)
    out = diff.compare(table, None, fixtures.pairs(spark), milestone).collect()
    return {r["key"]: r for r in out}


def test_signals(spark):
    win = lambda s: {"windows": s}
    rows = [
        fact(1, "base_feature", "same", var="kA", declared_form="x"), fact(2, "base_feature", "same", var="kA", declared_form="y"),
        fact(1, "base_feature", "flip", default_state="disabled"), fact(2, "base_feature", "flip", default_state="enabled"),
        fact(1, "base_feature", "other", default_state="disabled", platform_state=win("disabled")), fact(2, "base_feature", "other", default_state="enabled", platform_state=win("disabled")),
        fact(1, "base_feature", "retired", default_state="enabled"), fact(1, "base_feature", "never", default_state="disabled"),
        fact(1, "blink_runtime_feature", "flag", windows_status="stable"),
        fact(1, "pref", "old.key", var="kP"), fact(2, "pref", "new.key", var="kP"),
        fact(1, "mojo_field", "f", position=0, type="a"), fact(2, "mojo_field", "f", type="a"),
        fact(1, "mojo_field", "g", position=0, type="a"), fact(2, "mojo_field", "g", position=1, type="a"),
        fact(1, "switch", "moved", path="x/y.cc", var="kS"), fact(2, "switch", "moved", path="x/z.cc", var="kS"),
        fact(1, "webui_control", "s/p/1", surface="s", page="p", label="L", pref="a", control="toggle"), fact(2, "webui_control", "s/p/2", surface="s", page="p", label="L", pref="b", control="list"),
        fact(2, "flag_entry", "soon", expiry_milestone=41),
    ]
    got = compared(spark, rows, 40)
    assert "same" not in got and "f" not in got
    assert set(got["flip"]["signals"]) == {"enabled_by_default", "default_flip_on"} and got["flip"]["severity"] == 75
    assert got["other"]["signals"] == ["default_flip_on"]
    assert got["retired"]["signals"] == ["flag_retired_on"] and got["never"]["signals"] == ["flag_retired_off"]
    assert got["flag"]["signals"] == ["killswitch_retired"]
    assert got["old.key"]["signals"] == ["pref_renamed"] and got["old.key"]["name"] == "old.key -> new.key" and "new.key" not in got
    assert got["g"]["signals"] == ["ipc_shape_changed"]
    assert got["moved"]["signals"] == ["declaration_moved"] and got["moved"]["severity"] == 25
    assert got["s/p/1"]["signals"] == ["ui_control_repointed", "ui_control_type_changed"] and "s/p/2" not in got
    assert got["soon"]["signals"] == ["flag_expiring"]


def test_gates_and_overloads(spark):
    rows = [
        fact(2, "blink_runtime_feature", "Exp", windows_status="experimental"), fact(1, "blink_runtime_feature", "Exp", windows_status="experimental"),
        fact(2, "blink_runtime_feature", "Ok", windows_status="stable"), fact(1, "blink_runtime_feature", "Ok", windows_status="stable"),
        fact(2, "idl_interface", "I", ext={"RuntimeEnabled": "Exp"}), fact(1, "idl_interface", "I", ext={"RuntimeEnabled": "Exp"}),
        fact(2, "idl_member", "I.a", interface="I", runtime_enabled="Ok"), fact(2, "idl_member", "J.a", interface="J", runtime_enabled="Ok"),
        fact(2, "idl_member", "I.b", interface="I", runtime_enabled="None"),
        fact(1, "idl_member", "J.s", signature="m()", signatures=["m()", "m(long a)"]), fact(2, "idl_member", "J.s", signature="m()", signatures=["m()", "m(long a)", "m(optional Foo<a, b> c)"]),
    ]
    got = compared(spark, rows)
    assert got["I.a"]["signals"] == ["web_api_added_gated"]
    assert got["J.a"]["signals"] == ["web_api_added_live"]
    assert got["I.b"]["signals"] == ["web_api_added"]
    assert got["J.s"]["signals"] == ["web_api_overload_shadowed"]


def test_dedupe_does_not_depend_on_order(spark):
    rows = [fact(1, "idl_member", "I.m", path=f"p{i % 3}.idl", line=i, signature=f"m({'abc'[i % 3]} x)", runtime_enabled="G" if i % 2 else "") for i in range(12)]
    expected = None
    for n in (1, 3, 7):
        out = facts.dedupe_facts(spark.createDataFrame(rows, FACT).repartition(n).orderBy(F.rand(n))).collect()
        assert len(out) == 1 and out[0]["path"] == "p0.idl" and json.loads(out[0]["attrs"]["signatures"]) == ["m(a x)", "m(b x)", "m(c x)"]
        expected = expected or out
        assert out == expected


def test_declarations_are_compared_in_one_pass(spark):
    pairs, text = fixtures.pairs(spark), F.to_json(F.struct("change_type", "kind", "key", "name", "deltas", "signals", "severity", "paths", "locations", "before", "after"))
    raw = fixtures.raw_facts(spark, SF)
    one, two = (sorted(r[0] for r in diff.compare(rows, None, pairs, 40, declared=declared).select(text).collect()) for rows, declared in ((raw, True), (facts.dedupe_facts(raw), False)))
    assert one == two and len(one) > 1000
    # A side of too few facts ends the comparison here, too; so do none at all.
    for some in (raw.where("snapshot_id = 'v1' or kind = 'pref'"), raw.where("snapshot_id = 'v1'")):
        assert diff.compare(some, None, pairs, 40, declared=True).count() == 0
    # One shuffle of the declarations, besides that of the overload sets.
    plan = facts.versions_of(raw.where("kind = 'mojo_field'"), {"v1": "a", "v2": "b"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(kind") == 1


def test_packed_attributes_sort_and_read_as_their_entries(spark):
    maps = [{}, {"a": "1"}, {"a": None}, {"a": "1", "b": "2"}, {"a": "10"}, {"ab": "1"}, {"a": '"x=;,|"', "b": "[]"}, {"b": ""}]
    rows = spark.createDataFrame([(m,) for m in [*maps, None]], "attrs map<string,string>").withColumn("p", columns.packed("attrs"))
    assert all(r["attrs"] == r["u"] for r in rows.select("attrs", columns.unpacked(F.col("p")).alias("u")).collect())
    turn = lambda by: [r["attrs"] for r in rows.orderBy(by).collect()]
    assert turn(F.col("p")) == turn(F.map_entries("attrs"))


def test_scores(spark):
    rows = [fact(1, "pref", "gone", var="kG"), fact(1, "mojo_method", "m", platform_state={"windows": "not_compiled"}), fact(2, "webui_route", "new")]
    changes = diff.compare(spark.createDataFrame(rows, FACT), None, fixtures.pairs(spark))
    headers = spark.createDataFrame([("v1", [], 0), ("v2", [], 0)], "snapshot_id string, missing_targets array<string>, parse_errors int")
    cov = spark.createDataFrame([("v2", "preference keys and switches", 10, 5), ("v2", None, 10, 10)], "snapshot_id string, surface string, candidates long, read long")
    got = {r["key"]: r for r in scoring.score_changes(changes, cov, headers, fixtures.pairs(spark)).collect()}
    assert (got["gone"]["score"], got["gone"]["bucket"]) == (20, "housekeeping") and "50%" in got["gone"]["reasons"][1]
    assert (got["m"]["score"], got["m"]["bucket"], got["m"]["outside"]) == (0, "housekeeping", True)
    assert (got["new"]["score"], got["new"]["bucket"]) == (40, "new")
    some = summaries.finding_summary(scoring.score_changes(changes, cov, headers, fixtures.pairs(spark)))
    totals = {(r["what"], r["value"]): r["n"] for r in some.collect()}
    assert totals["total", ""] == 3 == sum(n for (w, _), n in totals.items() if w == "bucket") and totals["bucket", "breaking"] == 0


def test_paths(spark):
    paths = {"chrome/test/a.cc": "folder test", "a/b_unittest.cc": "test file", "tools/x.py": "other program", "third_party/zlib/z.h": "vendored", "third_party/blink/a.idl": "", "a\\out\\b.cc": "folder out", "test": ""}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", columns.skip_reason(F.col("path")).alias("r"))
    assert {r[0]: r[1] for r in rows.collect()} == paths
    elsewhere = {"ash/a.cc": True, "x/ash/a.cc": True, "android/a.cc": False, "x/android/a.cc": True, "mac/a.cc": False, "chromecast/a.cc": True, "x/posix/a.cc": False}
    rows = spark.createDataFrame([(p,) for p in elsewhere], "path string").select("path", columns.other_platform_dir(F.col("path")).alias("r"))
    assert {r[0]: r[1] for r in rows.collect()} == elsewhere
    read = {"a/x_features.cc": ["base_features"], "a/content_switches.h": ["base_features", "constants"], "a/x_features.mm": [], "a/b.idl": [], "third_party/blink/renderer/b.idl": ["web_idl"], "a/user_prefs.h": ["constants"], "a/flags_unittest.cc": [], "chrome/browser/ui/webui/a.cc": ["webui_gates"], "chrome/browser/resources/s/router.ts": [], "chrome/browser/resources/s/route.ts": ["webui_routes"], "x/ash/a_switches.cc": ["constants"], "a/b_fieldtrial.cc": ["base_features"]}
    rows = spark.createDataFrame([(p,) for p in read], "path string").select("path", coverage.extractors_of(F.col("path")).alias("r"))
    assert {r[0]: r[1] for r in rows.collect()} == read
    scope = spark.createDataFrame([("v1", "a/", True, [".cc"]), ("v1", "a/b/", True, None), ("v1", "f.txt", False, None)], "snapshot_id string, path string, is_tree boolean, suffixes array<string>")
    some = spark.createDataFrame([("v1", p) for p in ("a/x.cc", "a/x.h", "a/b/x.h", "f.txt", "f.txt2")], "snapshot_id string, path string")
    assert {r["path"] for r in coverage.reaches(some, scope).collect()} == {"a/x.cc", "a/b/x.h", "f.txt"}


def test_parsing():
    assert parsing.arity_range("m(long a, optional Foo<a, b> c, any... d)") == (1, None)
    assert parsing.normalize_params(" int32  a ,map<string, b>  c ") == "int32 a, map<string, b> c"
    assert parsing.parse_ext_attrs("A=(b,c), D") == {"A": "(b,c)", "D": True}
    assert parsing.evaluate_guard("BUILDFLAG(IS_WIN) && !BUILDFLAG(IS_MAC)") is True
    assert parsing.evaluate_guard("BUILDFLAG(USE_X) || BUILDFLAG(IS_WIN)") is True and parsing.evaluate_guard("BUILDFLAG(USE_X) && 1") is None
    assert parsing.evaluate_guard("not is_macosx", "template") is True and parsing.evaluate_guard("_google_chrome or is_win", "template") is True
    assert parsing.evaluate_guard("defined(IS_CHROMEOS_ASH)") is False and parsing.evaluate_guard("IS_WIN") is None and parsing.evaluate_guard("BUILDFLAG(IS_POSIX)") is None
    assert parsing.evaluate_guard("EnableIf=is_ios_iphoneos|enable_pdf", "attribute") is None and parsing.evaluate_guard("Stable", "attribute") is None
    assert parsing.normalize_signature("Promise<X>  f( long a ,DOMString b = 'x,y' )") == "Promise<X> f(long a, DOMString b = 'x,y')"
    assert parsing.parts_at("a<b,c>, (d, \"e,\") ,f < g, h") == [(0, "a<b,c>"), (8, '(d, "e,")'), (19, "f < g"), (26, "h")]
    assert parsing.evaluate_guard("not is_win", "template") is False and parsing.evaluate_guard("EnableIfNot=is_win", "attribute") is False


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i % 10 != 9] + [("z", "z"), (None, "a")]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert len(got) == 40 and all(got[f"n{i:03}"] == f"n{i // 10 * 10:03}" for i in range(40))


def test_components_of_hubs(spark):
    """Stars whose edges are not gathered by their centres: the same components, and rows stay spread over the tasks."""
    star = spark.range(0, 4000, 1, 8).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    other = spark.range(6000, 9000, 1, 8).select("id", F.lit(9000).cast("long")).union(spark.createDataFrame([(9000, 9500), (9500, 9400), (9700, 9600)], "a long, b long"))
    want = {i: 0 for i in [*range(4000), 5000]} | {i: 6000 for i in [*range(6000, 9001), 9400, 9500]} | {9700: 9600, 9600: 9600}
    for hub in (20, 1000, 1 << 20):
        rows = graph.connected_components(star.union(other), hub=hub).collect()
        assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want
    rows = star.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = graph._with_least(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), 100)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) == 500


def test_links(spark):
    rows = [fact(2, "webui_route", "s/R", guards=["show"]), fact(2, "webui_gate", "h/show", data_key="show", features=["F1"]), fact(2, "base_feature", "F1", var="kF1"), fact(2, "pref", "alone", var="kA")]
    changes = diff.compare(spark.createDataFrame(rows, FACT), None, fixtures.pairs(spark)).withColumns({"score": F.col("severity"), "bucket": signals.bucket_of()})
    out = graph.cluster_summary(changes, graph.build_clusters(graph.link_findings(changes))).collect()
    assert [(r["size"], sorted(r["members"])) for r in out] == [(3, ["base_feature:F1", "webui_gate:h/show", "webui_route:s/R"])]
    table = spark.createDataFrame(rows, FACT)
    assert graph.unresolved_references(table).count() == 0


def test_arity_of_nested_lists(spark):
    texts = ["m()", "m(long a)", "m((a or (b<c, d>)) x, optional map<k, v> y)", "m(sequence<(a or b)>... z)", "m(a, (b, (c, (d, (e, (f, (g, (h, i))))))) x)"]
    got = spark.createDataFrame([(texts,)], "s array<string>").select(parsing.arity_ranges(F.col("s"))).first()[0]
    assert [tuple(x) for x in got] == [parsing.arity_range(t) for t in texts] == [(0, 0), (1, 1), (1, 2), (0, None), (2, 2)]


def test_share_is_unknown_without_reading(spark):
    rows = spark.createDataFrame([(0, 0), (4, None), (4, 9), (4, 1)], "c long, r long")
    assert [r[0] for r in rows.select(columns.share(F.col("c"), F.col("r"))).collect()] == [None, None, 1.0, 0.25]


def test_places_across_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2000).alias("x"))
    got = placed(rows, ["g"], [F.desc("x")]).collect()
    want = {g: sorted((i * 7919 % 2000 for i in range(2000) if i % 3 == g), reverse=True) for g in range(3)}
    assert len(got) == 2000 and all(want[r["g"]][r["place"] - 1] == r["x"] for r in got)
    assert {(r["g"], r["x"]) for r in placed(rows, ["g"], [F.desc("x")], 2).collect()} == {(g, x) for g in range(3) for x in want[g][:2]}


def test_scopes(spark):
    parts = fixtures.partitions(spark)
    got = {r["path"]: r["suffixes"] for r in coverage.complete_scope(parts, ["ui"]).collect()}
    assert got["chrome/common/chrome_features.cc"] is None and ".cc" in got["chrome/browser/ui/webui/"] and ".cc" not in got["chrome/browser/"]
    with pytest.raises(ValueError, match="engine"):
        coverage.complete_scope(parts, ["engine"])


def test_a_file_that_is_listed_twice_counts_once_for_its_surface(spark):
    rows = spark.createDataFrame([("v1", "a/route.ts", True, ["routes"])] * 3 + [("v1", "a/x.mojom", False, ["messages"])], "snapshot_id string, path string, read boolean, surfaces array<string>")
    assert {tuple(r) for r in coverage.coverage(rows).select("surface", "candidates", "read").collect()} == {("routes", 1, 1), ("messages", 1, 0), (None, 4, 3)}


def test_scope_lookup_is_what_walking_the_scope_gives(spark):
    paths = ["a/b/c.cc", "a/b.cc", "a", "b/x.mojom", "b/x.cc", "bb/x.cc", "", "a/b/c/d.idl", "c/x.h", "a/b/c.cc"]
    scope = [("a/b", True, [".cc"]), ("a/b/", True, [".idl"]), ("a", False, None), ("b/", True, [".mojom", ".h"]), ("b", True, [".h"]), ("c", True, None), ("c/x", False, None)]
    ids = [("v1", p) for p in paths] + [("v2", p) for p in paths]
    listed = spark.createDataFrame(ids, "snapshot_id string, path string").withColumn("hit", F.lit("mine"))
    rows = spark.createDataFrame([("v1", *s) for s in scope] + [("v2", "", True, [".h"])], "snapshot_id string, path string, is_tree boolean, suffixes array<string>")

    def reached(v, p):
        mine = scope if v == "v1" else [("", True, [".h"])]
        over = lambda t: p.startswith(t.rstrip("/") + "/" if t else "")
        return any((over(t) and (s is None or p.endswith(tuple(s)))) if tree else p == t for t, tree, s in mine)

    want = sorted(x for x in ids if reached(*x))
    assert sorted((r[0], r[1]) for r in coverage.reaches(listed, rows).collect()) == want
    assert sorted((r[0], r[1]) for r in coverage.reaches(listed, rows, "left_anti").collect()) == sorted(x for x in ids if not reached(*x))
    assert coverage.reaches(listed, rows).columns == listed.columns and coverage.reaches(listed, rows.limit(0)).count() == 0
    absent = coverage.absent_targets(rows, listed)
    assert [(r["snapshot_id"], r["path"]) for r in absent.collect()] == [("v1", "c/x")]


def test_six_summaries_read_the_findings_once(spark, tmp_path):
    rows = [(f"p{i % 2}", "pref" if i % 3 else "webui_route", f"k{i}", "added" if i % 2 else "removed", {}, {"surface": '"s"'}, [], i, i, rules.BUCKETS[i % 4], "native", "", "pref_left_scan" if i % 5 else "", i % 7 == 0) for i in range(50)]
    schema = "pair_id string, kind string, key string, change_type string, before map<string,string>, after map<string,string>, deltas array<struct<attr:string,old:string,new:string>>, severity int, score int, bucket string, owner string, `group` string, lead string, outside boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "f"))
    found = spark.read.parquet(str(tmp_path / "f"))
    counts = summaries.condensed(found)
    for make in (summaries.finding_summary, summaries.owner_bucket_matrix, summaries.measured_figures, summaries.stories, summaries.screens, summaries.screen_totals):
        assert sorted(map(str, make(counts).collect())) == sorted(map(str, make(found).collect()))
        assert make(found)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["pair_id"], r["what"], r["value"]): r["n"] for r in summaries.finding_summary(found).collect()}
    assert got["p0", "total", ""] == 25 and got["p0", "owner", "ipc"] == 0 and got["p0", "bucket", rules.BUCKETS[0]] == 13 and got["p1", "not_in_build", ""] == 4
    assert summaries.finding_summary(found.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["count_by_kind", "score_changes", "describe", "coverage", "missed_paths", "closure_summary", "extract_facts", "build_guards", "signatures", "path_functions", "partition_scope", "briefs_round_trip"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    mine, theirs = library.QUERIES[name](spark, SF).toPandas(), con.sql(oracles.SQL[name]).df()
    names = sorted(mine.columns)
    assert len(mine) and names == sorted(theirs.columns)
    assert sorted(map(tuple, mine[names].astype(str).values)) == sorted(map(tuple, theirs[names].astype(str).values))


def test_entry(spark):
    assert entry.entry(spark).count() > 5
    assert set(oracles.SQL) == set(library.QUERIES)


def test_absent_targets_broadcasts_the_scope_not_the_paths(spark):
    """A small table whose rows become many paths is no small side of a join: its places are cut down to the scope's first (F2)."""
    scope = spark.createDataFrame([("v1", "a/", True), ("v1", "b", True), ("v1", "a/x7.cc", False), ("v1", "a/none.cc", False), ("v2", "a/", True), ("v1", "", True)], "snapshot_id string, path string, is_tree boolean")
    paths = spark.range(1).select(F.lit("v1").alias("snapshot_id"), F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("n")).select("snapshot_id", F.concat(F.lit("a/x"), "n", F.lit(".cc")).alias("path"))
    absent = coverage.absent_targets(scope, paths)
    assert sorted((r["snapshot_id"], r["path"]) for r in absent.collect()) == [("v1", "a/none.cc"), ("v1", "b"), ("v2", "a/")]
    plan = absent._jdf.queryExecution().optimizedPlan()
    assert "LeftSemi" in plan.toString() and "rightHint=(strategy=broadcast)" in plan.toString()


def test_raw_declarations_are_sent_without_maps(spark):
    """Raw facts have their attributes as one text, equal to that of their map, and operators send it as it is."""
    raw = fixtures.raw_facts(spark, SF)
    assert raw.where(~F.col("packed").eqNullSafe(columns.packed("attrs"))).count() == 0
    first = facts.keep_lowest(raw.where("kind = 'base_feature'")).select("key", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in first for f in ("map_filter(", "map_entries(", "str_to_map("))
    # Equal overloads are still made one before they are read: Spark leaves a plain distinct out below a set.
    said = lambda rows: facts._overloads(rows)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert said(raw) == 2 and said(raw.drop("packed")) == 2
    one, two = (sorted(map(str, facts.dedupe_facts(rows).select("snapshot_id", "kind", "key", "name", "path", "line", F.to_json("attrs")).collect())) for rows in (raw, raw.drop("packed")))
    assert one == two


def test_overload_sets_are_joined_without_another_shuffle(spark):
    """Where overload sets are too many to broadcast, the facts stay where their aggregation put them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = fixtures.raw_facts(spark, SF).where("kind in ('idl_member', 'mojo_field')")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (facts.dedupe_facts(raw), facts.versions_of(raw, {"v1": "a", "v2": "b"}))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [re.findall(r"SortMergeJoin \[([^\]]*)\]", re.sub(r"#\d+", "", p)) for p in plans]
    assert keys == [["snapshot_id, kind, key"], ["kind, key"]]
