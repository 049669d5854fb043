"""Extractors, snapshot files and enrichment."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from surfacelens.common import stored
from surfacelens.functions import lexer
from surfacelens.operators import diff, enrich, facts
from surfacelens.plans import corpus as made
from surfacelens.sources import extractors, fixtures, snapshots, store

FILES = {
    "chrome/common/pref_names.cc": '// char kNo[] = "no";\nconst char kA[] = "a.b";\n#if BUILDFLAG(IS_MAC)\ninline constexpr char kM[] = "m";\n#else\nconst char kW[] = "w";\n#endif\n',
    "x/y_switches.cc": '#if BUILDFLAG(USE_X)\nconst char kS[] =\n    "s";\n#endif\n',
    "base/runtime_enabled_features.json5": "{ data: [ // c\n {name: 'One', status: {'Win': 'stable', 'default': 'test',},},\n {name: \"Two\", status: 'experimental', base_feature: 'none'},] }",
    "chrome/flag-metadata.json": '[ {"name": "f1", "expiry_milestone": 150, "owners": ["o"]}, ]',
    "chrome/browser/resources/settings/route.ts": "r.BASIC = new Route('/');\nif (loadTimeData.getBoolean('showP')) {\n  r.P = r.BASIC.createSection('/p', 'p');\n}\nr.Q = r.P.createChild('/q');",
    "chrome/browser/resources/settings/a_page.html": '<!-- <x-y id="no"> --><cr-toggle id="t" pref="{{prefs.a.b}}" label="$i18n{lab}"></cr-toggle><cr-line></cr-line><cr-line></cr-line><div id="d">',
    "chrome/browser/ui/webui/b_handler.cc": 'source->AddBoolean("showP", base::FeatureList::IsEnabled(features::kFoo) && (IsThingEnabled(p) ||\n  x::features::kBar.Get()));',
    "chrome/bad/flag-metadata.json": "[ {",
}


def test_extractors(spark):
    corpus = spark.createDataFrame([("v1", p, t) for p, t in FILES.items()], "snapshot_id string, path string, text string")
    rows = extractors.extract(corpus).collect()
    got = {(r["kind"], r["key"]): (r["line"], {k: json.loads(v) for k, v in r["attrs"].items()}) for r in rows if r["kind"]}
    assert got["pref", "a.b"] == (2, {"var": "kA"}) and got["pref", "m"][1]["platform_state"] == {"windows": "not_compiled"} and "platform_state" not in got["pref", "w"][1] and ("pref", "no") not in got
    assert got["switch", "s"][1]["platform_state"] == {"windows": "conditional"}
    assert got["blink_runtime_feature", "One"][1]["windows_status"] == "stable" and got["blink_runtime_feature", "Two"][0] == 3
    assert got["flag_entry", "f1"][1] == {"expiry_milestone": 150, "owners": ["o"]}
    assert got["webui_route", "settings/P"][1]["guards"] == ["showP"] and got["webui_route", "settings/Q"][1] == {"surface": "settings", "route": "/q", "parent": "P", "route_kind": "child", "guards": []}
    assert {k for t, k in got if t == "webui_control"} == {"settings/a_page/a_page/pref:a.b#t"}
    gate = got["webui_gate", "b_handler/showP"][1]
    assert gate["features"] == ["kFoo", "kBar"] and gate["enabled_checks"] == ["kFoo"]
    status = extractors.file_status(extractors.extract(corpus))
    stats = {r["extractor"]: (r["n_facts"], r["n_files"], r["n_errors"]) for r in extractors.extract_stats(status).collect()}
    assert stats["flags_metadata"] == (1, 2, 1) and stats["mojom"] == (0, 0, 0) and len(stats) == len(extractors.EXTRACTORS)


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"snapshot_id": "v1", "ref": "r", "milestone": 3, "schema": 40, "meta": {"target_set": "t"}, "facts": [{"kind": "pref", "key": "k", "attrs": {"var": "kK"}}]}))
    headers, facts = snapshots.read_snapshots(spark, str(tmp_path / "s.json"))
    assert facts.first()[:6] == ("v1", "pref", "k", "k", "", 0)
    good, again = snapshots.fresh_snapshots(headers, 41)
    assert good.count() == 0 and again.count() == 1
    (tmp_path / "l.txt").write_text("a/b\n\nc\n")
    assert snapshots.read_listing(spark, str(tmp_path / "l.txt"), "v1").count() == 2
    (tmp_path / "b.json").write_text(")]}'\n" + json.dumps({"Enabled": [{"name": "New Thing", "id": 1, "summary": "word " * 100}]}))
    briefs = snapshots.read_feature_briefs(spark, str(tmp_path / "b.json"), 151)
    findings = spark.createDataFrame([("NewThing", "k", "new"), ("x", "new-thing", "new"), ("NewThing", "q", "housekeeping")], "name string, key string, bucket string")
    out = enrich.enrich(findings, briefs).collect()
    assert [r["brief"] is not None for r in sorted(out, key=lambda r: r["key"])] == [True, True, False]
    assert all(r["brief"]["summary"] == ("word " * 100).strip() for r in out if r["brief"])
    newest = enrich.newest_feature_per_name(briefs).first()
    assert newest["milestone"] == 151 and newest["summary"] == ("word " * 44).strip() + "..."


def test_versions(spark):
    v = spark.createDataFrame([("151.0.9.1",), ("151.0.10.0",), ("152.1.1.1",), ("x",)], "version string")
    assert {r[0]: r[1] for r in enrich.latest_version_per_milestone(v).collect()} == {151: "151.0.10.0", 152: "152.1.1.1"}
    s = spark.createDataFrame([(1, 3), (None, 5), (3, 3), (1, 20), (1, None)], "start int, end int")
    assert [r[0] for r in enrich.milestone_span(s).select("milestones").collect()] == [[2, 3], [5], [3], list(range(13, 21)), []]


FACT = "snapshot_id string, kind string, key string, name string, path string, line int, attrs map<string,string>"
WANTED = "snapshot_id string, ref string, target_set string, partitions array<string>, complete boolean"


def test_every_file_is_a_row(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "b_features.cc").write_bytes(b"x\xff")
    (root / "a" / ".hidden_features.cc").write_text("x")
    odd = made.spoil(spark, str(root))
    rows = {r["path"]: r for r in snapshots.read_corpus(spark, str(root), "v1").collect()}
    assert set(rows) == {"a/b_features.cc", "a/.hidden_features.cc", *odd[:2]}
    assert rows["a/b_features.cc"][2:] == ("x\ufffd", 2, None) and rows["odd/empty.cc"][2:] == ("", 0, None)
    assert rows["odd/broken.cc"]["text"] is None and rows["odd/broken.cc"]["error"] == "not readable" and rows["odd/broken.cc"]["size"] == 22
    listing = spark.createDataFrame([(p,) for p in ["a/b_features.cc", *odd, odd[0]]], "path string")
    got = {r["path"]: r["error"] for r in snapshots.read_corpus(spark, str(root), "v1", listing).collect()}
    assert got == {"a/b_features.cc": None, "odd/broken.cc": "not readable", "odd/empty.cc": None, "odd/gone.cc": "missing"}


def test_status_and_header(spark):
    rows = [
        ("v1", "a/x_features.cc", 'BASE_FEATURE(kA, "A", base::FEATURE_ENABLED_BY_DEFAULT);', 55, None), ("v1", "a/empty_features.cc", "", 0, None),
        ("v1", "a/y_features.cc", None, 7, "not readable"), ("v1", "a/z_switches.cc", None, None, "missing"), ("v1", "a/flag-metadata.json", "[ {", 3, None), ("v1", "a/plain.txt", None, 1, "not readable"),
    ]
    corpus = spark.createDataFrame(rows, "snapshot_id string, path string, text string, size long, error string")
    scope = spark.createDataFrame([("v1", "a", True, None), ("v1", "b/", True, None), ("v1", "a/x_features.cc", False, None), ("v1", "a/z_switches.cc", False, None)], "snapshot_id string, path string, is_tree boolean, suffixes array<string>")
    wanted = spark.createDataFrame([("v1", "151.0.1.2", "t", ["b", "a"], True), ("v2", "r", "t", None, None)], WANTED)
    built = extractors.build_snapshot(corpus, wanted, scope)
    status = {(r["extractor"], r["path"]): r for r in built.status.collect()}
    assert status["base_features", "a/x_features.cc"][3:] == (1, 55, None) and status["base_features", "a/empty_features.cc"][3:] == (0, 0, None)
    assert status["base_features", "a/y_features.cc"][3:] == (None, 7, "not readable") and status["flags_metadata", "a/flag-metadata.json"]["n_facts"] == 0
    # The unreadable switches file is read by two extractors and counts once; the text file by none.
    assert [tuple(r) for r in extractors.file_totals(built.status).collect()] == [("v1", 3, 3)]
    header = {r["snapshot_id"]: r for r in built.header.collect()}
    assert header["v1"]["milestone"] == 151 and header["v1"]["parse_errors"] == 3 and header["v1"]["missing_targets"] == ["a/z_switches.cc", "b/"] and header["v1"]["partitions"] == ["a", "b"]
    assert header["v2"]["parse_errors"] == 0 and header["v2"]["complete"] is False and header["v2"]["missing_targets"] == []
    stats = {(r["snapshot_id"], r["extractor"]): r[2:] for r in built.stats.collect()}
    assert stats["v1", "base_features"] == (1, 2, 2) and stats["v2", "mojom"] == (0, 0, 0)
    none = extractors.build_snapshot(corpus.limit(0), wanted, scope)
    assert none.facts.count() == 0 and none.header.count() == 2


def some_facts(spark, v, n, value="x"):
    return spark.createDataFrame([(v, "pref", f"k{i}", f"k{i}", "a/b.cc", i, {"var": f'"{value}"'}) for i in range(n)], FACT)


def headers_of(spark, v, partitions=()):
    return spark.createDataFrame([(v, "r", "t", list(partitions), True)], WANTED)


def test_store(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.write_snapshot(some_facts(spark, "v1", 5), headers_of(spark, "v1"), path, 3) == 1
    old = store.read_facts(spark, path)
    store.write_snapshot(some_facts(spark, "v2", 4).unionByName(some_facts(spark, "v9", 9)), headers_of(spark, "v2"), path)
    store.write_snapshot(some_facts(spark, "v1", 3), headers_of(spark, "v1", ["ui"]), path)  # a part never stands in for the whole
    assert store.read_facts(spark, path).groupBy("snapshot_id").count().orderBy("snapshot_id").collect() == [("v1", 8), ("v2", 4)]
    assert store.read_facts(spark, path, headers_of(spark, "v1")).count() == 5 and store.read_facts(spark, path, headers_of(spark, "v8")).count() == 0
    store.write_snapshot(some_facts(spark, "v1", 2), headers_of(spark, "v1"), path)
    store.write_snapshot(some_facts(spark, "v3", 0), headers_of(spark, "v3"), path)
    assert old.count() == 5 and store.read_facts(spark, path, headers_of(spark, "v1")).count() == 2 and store.read_headers(spark, path).count() == 4
    assert store.read_facts(spark, path, headers_of(spark, "v3")).count() == 0
    assert len(store.vacuum(spark, path)) == 1 and store.read_facts(spark, path).count() == 9
    assert store.read_facts(spark, str(tmp_path / "none")).count() == 0


def test_readers_see_one_commit(spark, tmp_path):
    path, seen, done = str(tmp_path / "s"), [], threading.Event()
    store.write_snapshot(some_facts(spark, "v1", 40, "c0"), headers_of(spark, "v1"), path)

    def write():
        for k in (1, 2, 3):
            store.write_snapshot(some_facts(spark, "v1", 40 + k, f"c{k}"), headers_of(spark, "v1"), path)
        done.set()

    writer = threading.Thread(target=write)
    writer.start()
    while not done.is_set() or not seen:
        seen.append([tuple(r) for r in store.read_facts(spark, path).groupBy(F.col("attrs")["var"]).count().collect()])
    writer.join()
    assert all(s in [[(f'"c{k}"', 40 + k)] for k in range(4)] for s in seen), seen


def test_lost_race_is_tried_again(spark, tmp_path, monkeypatch):
    path, known = str(tmp_path / "s"), store._current
    store.write_snapshot(some_facts(spark, "v1", 1), headers_of(spark, "v1"), path)
    stale = iter([known(store._Folder(spark, path))] * 2)
    store.write_snapshot(some_facts(spark, "v2", 2), headers_of(spark, "v2"), path)
    monkeypatch.setattr(store, "_current", lambda folder: next(stale, None) or known(folder))
    assert store.write_snapshot(some_facts(spark, "v3", 3), headers_of(spark, "v3"), path) == 3
    assert store.read_facts(spark, path).count() == 6


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_one_shuffle_for_many_pairs_and_none_on_buckets(spark, tmp_path):
    rows = facts.dedupe_facts(fixtures.raw_facts(spark, "/root/testdata/sf0.001", True))
    rows.write.parquet(str(tmp_path / "facts"))
    rows, pairs = spark.read.parquet(str(tmp_path / "facts")), fixtures.chain_pairs(spark)
    joined = diff.join_pair(rows, pairs)
    assert exchanges(joined) == 1
    wanted = spark.createDataFrame([(f"v{k}", f"15{k}.0.0.1", "t", None, True) for k in range(1, 5)], WANTED)
    store.write_snapshot(rows, wanted, str(tmp_path / "store"))
    bucketed = diff.join_pair(store.read_facts(spark, str(tmp_path / "store")), pairs)
    assert exchanges(bucketed) == 0 and bucketed.count() == joined.count()
    # All pairs at once are what each pair is by itself.
    text = F.to_json(F.struct("change_type", "kind", "key", "name", "deltas", "signals", "severity", "paths", "locations"))
    every = {(r[0], r[1]) for r in diff.compare(rows, None, pairs).select("pair_id", text).collect()}
    one = {(r[0], r[1]) for r in diff.compare(rows, None, pairs.where("pair_id = 'v4-v2'")).select("pair_id", text).collect()}
    assert one == {x for x in every if x[0] == "v4-v2"} and len({p for p, _ in every}) == 5 and len(one) > 1000


def test_registry_as_a_value_and_registered(spark, monkeypatch):
    def lines(text, path):
        for n, line in enumerate(text.splitlines(), 1):
            yield "note", line, line, n, {"size": len(line), "none": None}

    corpus = spark.createDataFrame([("v1", "a/b.note", "x\ny"), ("v1", "a/c.txt", "z")], "snapshot_id string, path string, text string")
    found = extractors.extract(corpus, {"notes": lines}, {"notes": ("notes", F.col("path").endswith(".note"))})
    assert sorted((r["key"], r["line"], r["attrs"]) for r in extractors.facts_of(found).collect()) == [("x", 1, {"size": "1"}), ("y", 2, {"size": "1"})]
    assert "notes" not in extractors.EXTRACTORS
    monkeypatch.setattr(extractors, "EXTRACTORS", dict(extractors.EXTRACTORS))
    monkeypatch.setattr(extractors.coverage, "ADDED_ROUTES", {})
    extractors.register_extractor("notes", F.col("path").endswith(".note"), "notes", lines)
    assert extractors.facts_of(extractors.extract(corpus)).count() == 2
    with pytest.raises(ValueError):
        extractors.register_extractor("notes", F.lit(True), "notes", lines)


def test_lexer():
    source = lexer.Source('a(b, "x)\\"", [c], d<e, f>) /* { */ {\r\n#if X // }\n  "é", \'}\' } ) (')
    assert [p.said for p in source.parts(2, source.close[1])] == ["b", '"x)\\""', "[c]", "d<e, f>"]
    brace = source.said.index("{")
    assert source.said[source.close[brace]] == "}" and "#if X" in [s.strip() for s in source.said] and source.line(source.close[brace]) == 3
    last = len(source) - 1
    assert source.said[last] == "(" and last not in source.close
    assert [p.said for p in lexer.Source("").parts(0, 0)] == [""]


def test_extractors_on_odd_texts():
    flags = lambda text: {f[1]: f[4] for f in extractors.feature_flags(text, "p")}
    nested = "#if BUILDFLAG(IS_WIN)\r\n#if defined(X)\r\nBASE_FEATURE(kA,\r\n  \"Ä\", base::FEATURE_ENABLED_BY_DEFAULT);\r\n#else\r\nBASE_FEATURE(kB, base::FEATURE_DISABLED_BY_DEFAULT);\r\n#endif\r\n#endif\r\nBASE_FEATURE(kOpen, \"O\""
    got = flags(nested)
    assert got["Ä"]["conditions"] == ["defined(X)", "BUILDFLAG(IS_WIN)"] and got["B"]["conditions"] == ["!(defined(X))", "BUILDFLAG(IS_WIN)"] and set(got) == {"Ä", "B"}
    assert flags("const base::FeatureParam<std::map<int, int>> kP{&ns::kF, \"p\", {1, 2}};")["kF/p".replace("kF", "F")]["type"] == "std::map<int, int>"
    calls = list(extractors.message_definitions("module a.b;\ninterface I { [Sync] Go(map<string, array<int32>> x) => (); enum E { kA = 1 }; };\nstruct Broken { int32 a", "p"))
    assert {f[1] for f in calls} == {"a.b.I", "a.b.I.Go", "a.b.I.E"}
    members = list(extractors.web_definitions("callback interface C { undefined f(); };\ninterface mixin M { static attribute long x; async iterable<long>; };\ninterface Open {", "p"))
    assert [(f[1], f[4].get("idl_kind", f[4].get("member_type"))) for f in members] == [("C", "callback interface"), ("C.f", "operation"), ("M", "interface mixin"), ("M.x", "field"), ("M.async iterable", "declarative")]
    controls = list(extractors.page_controls('<if expr="a > b"><cr-toggle id="x"></cr-toggle></if><if expr="open"><cr-toggle id="y"></cr-toggle><!-- <cr-toggle id="z">', "chrome/browser/resources/s/p.html"))
    assert [(f[1], f[4]["build_conditions"]) for f in controls] == [("s/p/p/id:x", ["a > b"]), ("s/p/p/id:y", []), ("s/p/p/id:z", [])]


@pytest.mark.parametrize(
    ("function", "piece"),
    [(extractors.feature_flags, '#if BUILDFLAG(IS_WIN)\nBASE_FEATURE(kF%d, "F%d", base::FEATURE_ENABLED_BY_DEFAULT);\n#endif\n'), (extractors.page_controls, '<if expr="is_win"><cr-toggle id="t%d" label="%d"></cr-toggle></if>\n'), (extractors.message_definitions, "struct S%d { int32 a%d; };\n"), (extractors.visibility_gates, 's->AddBoolean("k%d", features::kX%d);\n')],
)
def test_extractors_are_linear(function, piece):
    took = []
    for n in (2000, 16000):
        text, began = "".join(piece % (i, i) for i in range(n)), time.perf_counter()
        assert sum(1 for _ in function(text, "a/b.html")) >= n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0], took


def test_corpus_is_dealt_out(spark):
    """A small table of parts is one scan, and its files are parsed by four tasks a core."""
    rows = made._corpus(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert len(rows.inputFiles()) == 1 and rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_work_tables_are_compressed(spark):
    """Work tables are written with zstd and read back as they were."""
    rows = stored(spark.range(1000).withColumn("text", F.lit("a b c")), "test")
    assert rows.count() == 1000 and all(".zstd." in f for f in rows.inputFiles())


def _shuffle_files(spark):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {kept.apply(i).getName() for i in range(kept.size()) if kept.apply(i).getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_behind(spark, tmp_path):
    before, facts_ = _shuffle_files(spark), spark.range(2000).selectExpr("'v1' snapshot_id", "'pref' kind", "concat('k', id) key", "concat('k', id) name", "'p.cc' path", "cast(id as int) line", "map('var', concat('\"k', id, '\"'), 'none', null) attrs")
    made = facts_.groupBy("snapshot_id", "kind").agg(F.collect_list("key").alias("keys"))
    snapshots.write_table(made, str(tmp_path / "json"), "json")
    stored(facts_.groupBy("kind").count(), "counted")
    for _ in range(50):  # files are deleted in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "json").glob("part-*")) and len(spark.read.json(str(tmp_path / "json")).first()["keys"]) == 2000
    headers = spark.createDataFrame([("v1", "r", "t")], "snapshot_id string, ref string, target_set string")
    store.write_snapshot(facts_, headers.selectExpr("*", "cast(null as array<string>) partitions", "true complete"), f"file://{tmp_path}/store", 3)
    back = {r["key"]: r["attrs"] for r in store.read_facts(spark, f"file://{tmp_path}/store").collect()}
    assert len(back) == 2000 and back["k7"] == {"var": '"k7"', "none": None}


def test_canonical_values_and_tokens_of_long_comments():
    """Values are written as the encoder writes them, and lines without a token cost no more than their length."""
    for value in ("é \"\\\n\x01", True, False, 0, 1.5, [], ["b", "a\""], ["a", 1], {"b": ["x"], "a": None}, [True], None):
        assert extractors._canonical(value) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    took = []
    for n in (4000, 32000):
        text, began = "/*" + (" " * 60 + "\n") * n + "*/\n \t#if X\na #b\n", time.perf_counter()
        source = lexer.Source(text)
        took.append(time.perf_counter() - began)
        assert source.said == ["#if X", "a", "#", "b"] and source.sort == ["directive", "word", "mark", "word"] and source.line(0) == n + 2
    assert took[1] < 30 * took[0], took


def test_extraction_makes_no_encoder_a_value(monkeypatch):
    calls = []
    monkeypatch.setattr(extractors, "_json", lambda v, encode=extractors._json: calls.append(v) or encode(v))
    rows = extractors._kept(extractors.EXTRACTORS, {"snapshot_id": "v1", "extractor": "constants", "path": "a/pref_names.cc", "text": 'const char kA[] = "a.b";', "size": 1, "error": None})
    assert rows[0][7] == [("var", '"kA"')] and not calls
