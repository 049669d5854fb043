"""Source files made of the rows of ``part``, the facts that are in them, and the queries that read them.

Files and facts are templates: '@n' stands for the part's key, '@s' for its size, '~' for a line
feed. The facts are written down by hand beside each file, for the SQL that checks the extractors.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import dealt, stored, work_path
from ..functions import columns
from ..functions.parsing import arity_range, normalize_params, normalize_signature, parse_ext_attrs, resolve_guards, text_function
from ..operators import diff, scoring
from ..operators import facts as fact_operators
from ..sources import extractors, fixtures, snapshots, store

_IDL = "third_party/blink/renderer/m/i@n.idl"
_RES = "chrome/browser/resources/s@n"

#: (extractor, path, text) and its facts: (kind, key, name, line, attributes).
FILES: list[tuple[str, str, str, list[tuple]]] = [
    ("base_features", "chrome/common/f@n_features.cc",
     '// BASE_FEATURE(kNo, "No", base::FEATURE_ENABLED_BY_DEFAULT);~#if BUILDFLAG(IS_WIN)~BASE_FEATURE(kWin@n, "Win@n", base::FEATURE_ENABLED_BY_DEFAULT);~#else~BASE_FEATURE(kElse@n,~    base::FEATURE_DISABLED_BY_DEFAULT);~#endif~'
     'const base::Feature kOld@n{"Old@n", base::FEATURE_DISABLED_BY_DEFAULT};~BASE_FEATURE(kChain@n, "Chain@n",~#if BUILDFLAG(IS_ANDROID)~    base::FEATURE_ENABLED_BY_DEFAULT~#else~    base::FEATURE_DISABLED_BY_DEFAULT~#endif~);~'
     'const base::FeatureParam<int> kParam@n{&kWin@n, "size", @s};~BASE_FEATURE_PARAM(int, kTtl@n, &features::kWin@n,  @s );~#if defined(X) && !BUILDFLAG(IS_MAC)~#if BUILDFLAG(IS_WIN)~BASE_FEATURE(kMaybe@n, "Maybe@n", base::FEATURE_ENABLED_BY_DEFAULT);~#endif~#endif~',
     [("base_feature", "Win@n", "Win@n", 3, {"var": "kWin@n", "default_state": "enabled", "platform_state": {"windows": "enabled"}, "declared_form": "macro3", "conditions": ["BUILDFLAG(IS_WIN)"]}),
      ("base_feature", "Else@n", "Else@n", 5, {"var": "kElse@n", "default_state": "disabled", "platform_state": {"windows": "not_compiled"}, "declared_form": "macro2", "conditions": ["!(BUILDFLAG(IS_WIN))"]}),
      ("base_feature", "Old@n", "Old@n", 8, {"var": "kOld@n", "default_state": "disabled", "platform_state": {"windows": "disabled"}, "declared_form": "legacy", "conditions": []}),
      ("base_feature", "Chain@n", "Chain@n", 9, {"var": "kChain@n", "default_state": "enabled", "platform_state": {"windows": "disabled"}, "declared_form": "macro3", "conditions": []}),
      ("base_feature", "Maybe@n", "Maybe@n", 20, {"var": "kMaybe@n", "default_state": "enabled", "platform_state": {"windows": "conditional"}, "declared_form": "macro3", "conditions": ["BUILDFLAG(IS_WIN)", "defined(X) && !BUILDFLAG(IS_MAC)"]}),
      ("feature_param", "Win@n/size", "size", 16, {"feature": "Win@n", "type": "int", "var": "kParam@n", "default": "@s"}),
      ("feature_param", "Win@n/Ttl@n", "Ttl@n", 17, {"feature": "Win@n", "type": "int", "var": "kTtl@n", "default": "@s"})]),
    ("constants", "components/x/c@n_prefs.h",
     '#ifndef X_H~#define X_H~inline constexpr char kA@n[] = "a.b@n";~#if !BUILDFLAG(IS_WIN)~const std::string_view kB@n =~    "b.@n";~#endif~extern const char kC[];~#endif~',
     [("pref", "a.b@n", "a.b@n", 3, {"var": "kA@n"}), ("pref", "b.@n", "b.@n", 5, {"var": "kB@n", "conditions": ["!BUILDFLAG(IS_WIN)"], "platform_state": {"windows": "not_compiled"}})]),
    ("web_idl", _IDL,
     '[RuntimeEnabled=G@n, Exposed=(Window,Worker)]~interface I@n : Base {~  const long K = 1;~  readonly attribute DOMString margin-top;~  [SecureContext] Promise<long> go( long a ,optional sequence<long> b = "x,y");~  iterable<long>;~};~enum E@n { "a", "b@n" };~partial interface I@n { [RuntimeEnabled=P@n] getter long item(long i); };~',
     [("idl_interface", "I@n", "I@n", 2, {"idl_kind": "interface", "partial": False, "inherits": "Base", "ext": {"RuntimeEnabled": "G@n", "Exposed": "(Window,Worker)"}}),
      ("idl_interface", "E@n", "E@n", 8, {"idl_kind": "enum", "partial": False, "inherits": "", "ext": {}, "values": ["a", "b@n"]}),
      ("idl_member", "I@n.K", "K", 3, {"interface": "I@n", "member_type": "const", "signature": "const long K = 1", "ext": {}, "runtime_enabled": "", "from_partial": False}),
      ("idl_member", "I@n.margin-top", "margin-top", 4, {"interface": "I@n", "member_type": "attribute", "signature": "readonly attribute DOMString margin-top", "ext": {}, "runtime_enabled": "", "from_partial": False}),
      ("idl_member", "I@n.go", "go", 5, {"interface": "I@n", "member_type": "operation", "signature": 'Promise<long> go(long a, optional sequence<long> b = "x,y")', "ext": {"SecureContext": True}, "runtime_enabled": "", "from_partial": False}),
      ("idl_member", "I@n.iterable", "iterable", 6, {"interface": "I@n", "member_type": "declarative", "signature": "iterable<long>", "ext": {}, "runtime_enabled": "", "from_partial": False}),
      ("idl_member", "I@n.getter item", "getter item", 9, {"interface": "I@n", "member_type": "operation", "signature": "getter long item(long i)", "ext": {"RuntimeEnabled": "P@n"}, "runtime_enabled": "P@n", "from_partial": True})]),
    ("mojom", "services/m/m@n.mojom",
     "module m.p@n;~[Stable, EnableIf=is_win]~interface I {~  [Sync] Go@(3)(int32 a,  map<string, int32> b) => (bool ok);~  Stop();~};~struct S {~  enum Kind { kA = 1, kB };~  [MinVersion=2, EnableIf=is_android] string? name@(1);~  int32 count = @s;~};~union U { int32 a; };~",
     [("mojo_interface", "m.p@n.I", "I", 3, {"module": "m.p@n", "method_count": 2, "methods": ["Go", "Stop"], "stable": True, "conditions": ["EnableIf=is_win"], "platform_state": {"windows": "compiled"}}),
      ("mojo_method", "m.p@n.I.Go", "Go", 4, {"interface": "m.p@n.I", "module": "m.p@n", "signature": "Go(int32 a, map<string, int32> b) => (bool ok)", "params": "int32 a, map<string, int32> b", "response": "bool ok", "attrs": {"Sync": True}, "ordinal": "3", "conditions": ["EnableIf=is_win"], "inherited_conditions": ["EnableIf=is_win"], "platform_state": {"windows": "compiled"}, "position": 0, "stable": True}),
      ("mojo_method", "m.p@n.I.Stop", "Stop", 5, {"interface": "m.p@n.I", "module": "m.p@n", "signature": "Stop()", "params": "", "response": "", "attrs": {}, "conditions": ["EnableIf=is_win"], "inherited_conditions": ["EnableIf=is_win"], "platform_state": {"windows": "compiled"}, "position": 1, "stable": True}),
      ("mojo_struct", "m.p@n.S", "S", 7, {"module": "m.p@n", "mojo_kind": "struct", "field_count": 2, "fields": ["count", "name"]}),
      ("mojo_enum", "m.p@n.S.Kind", "Kind", 8, {"module": "m.p@n", "values": ["kA = 1", "kB"]}),
      ("mojo_field", "m.p@n.S.name", "name", 9, {"struct": "m.p@n.S", "module": "m.p@n", "type": "string?", "ordinal": "1", "attrs": "MinVersion=2, EnableIf=is_android", "min_version": "2", "conditions": ["EnableIf=is_android"], "platform_state": {"windows": "not_compiled"}}),
      ("mojo_field", "m.p@n.S.count", "count", 10, {"struct": "m.p@n.S", "module": "m.p@n", "type": "int32", "default": "@s"}),
      ("mojo_struct", "m.p@n.U", "U", 12, {"module": "m.p@n", "mojo_kind": "union", "field_count": 1, "fields": ["a"]}),
      ("mojo_field", "m.p@n.U.a", "a", 12, {"struct": "m.p@n.U", "module": "m.p@n", "type": "int32"})]),
    ("blink_runtime", "third_party/blink/renderer/d@n/runtime_enabled_features.json5",
     "{~  // flags~  data: [~    {~      name: \"R@n\",~      status: \"stable\",~      base_feature: \"none\",~      other: 1,~    },~    { name: \"Q@n\", status: { \"Win\": \"test\", \"default\": \"stable\" }, depends_on: [\"R@n\"], public: true },~    { name: \"P@n\", status: { \"Mac\": \"test\" } },~  ],~}~",
     [("blink_runtime_feature", "R@n", "R@n", 5, {"status": "stable", "platform_status": {"windows": "stable", "default": "stable"}, "windows_status": "stable", "base_feature": "none"}),
      ("blink_runtime_feature", "Q@n", "Q@n", 10, {"status": "per-platform", "platform_status": {"windows": "test", "default": "stable"}, "windows_status": "test", "depends_on": ["R@n"], "public": True}),
      ("blink_runtime_feature", "P@n", "P@n", 11, {"status": "per-platform", "platform_status": {"windows": "", "default": ""}, "windows_status": ""})]),
    ("flags_metadata", "chrome/browser/d@n/flag-metadata.json",
     '[~  // entries~  { "name": "flag-@n", "owners": [ "a@@b" ], "expiry_milestone": @s },~  {~    "name": "other-@n"~  }~]~',
     [("flag_entry", "flag-@n", "flag-@n", 3, {"expiry_milestone": "=@s", "owners": ["a@@b"]}), ("flag_entry", "other-@n", "other-@n", 5, {"owners": []})]),
    ("webui_routes", _RES + "/route.ts",
     "export function make(r: Routes) {~  r.BASIC = new Route('/');~  r.PEOPLE = r.BASIC.createSection('/people@n', 'people');~  if (loadTimeData.getBoolean('show@n')) {~    r.INNER = r.PEOPLE.createChild('/inner');~  }~  r.LAST = r.BASIC.createChild('/last');~}~",
     [("webui_route", "s@n/PEOPLE", "PEOPLE", 3, {"surface": "s@n", "route": "/people@n", "parent": "BASIC", "route_kind": "section", "guards": []}),
      ("webui_route", "s@n/INNER", "INNER", 5, {"surface": "s@n", "route": "/inner", "parent": "PEOPLE", "route_kind": "child", "guards": ["show@n"]}),
      ("webui_route", "s@n/LAST", "LAST", 7, {"surface": "s@n", "route": "/last", "parent": "BASIC", "route_kind": "child", "guards": []})]),
    ("webui_controls", _RES + "/a_page/x.html",
     '<!-- <cr-toggle id="no"></cr-toggle> -->~<cr-line id="line"></cr-line>~<settings-toggle-button id="t@n" pref="{{prefs.a.b@n}}" label="$i18n[title@n]">~</settings-toggle-button>~<if expr="not is_win"><cr-button id="b"></cr-button></if>~<downloads-item></downloads-item>~<x-card pref-key="k.@n"></x-card>~'.replace("$i18n[title@n]", "$i18n{title@n}"),
     [("webui_control", "s@n/a_page/x/pref:a.b@n#t@n", "pref:a.b@n#t@n", 3, {"surface": "s@n", "page": "a_page", "file": "x", "control": "settings-toggle-button", "pref": "a.b@n", "label": "title@n", "element_id": "t@n", "build_conditions": []}),
      ("webui_control", "s@n/a_page/x/id:b", "id:b", 5, {"surface": "s@n", "page": "a_page", "file": "x", "control": "cr-button", "pref": "", "label": "", "element_id": "b", "build_conditions": ["not is_win"], "platform_state": {"windows": "not_compiled"}}),
      ("webui_control", "s@n/a_page/x/downloads-item#0", "downloads-item#0", 6, {"surface": "s@n", "page": "a_page", "file": "x", "control": "downloads-item", "pref": "", "label": "", "element_id": "", "build_conditions": []}),
      ("webui_control", "s@n/a_page/x/pref:k.@n", "pref:k.@n", 7, {"surface": "s@n", "page": "a_page", "file": "x", "control": "x-card", "pref": "k.@n", "label": "", "element_id": "", "build_conditions": []})]),
    ("webui_controls", _RES + "/l.html.ts",
     "import {html} from '<cr-toggle id=\"no\">';~export function getHtml() {~  return html`~<cr-toggle .pref=\"${this.prefs.c.d@n.value}\"></cr-toggle>~<cr-input label=\"$i18nRaw{name}\"></cr-input>`;~}~",
     [("webui_control", "s@n/l/l/pref:c.d@n", "pref:c.d@n", 4, {"surface": "s@n", "page": "l", "file": "l", "control": "cr-toggle", "pref": "c.d@n", "label": "", "element_id": "", "build_conditions": []}),
      ("webui_control", "s@n/l/l/label:name", "label:name", 5, {"surface": "s@n", "page": "l", "file": "l", "control": "cr-input", "pref": "", "label": "name", "element_id": "", "build_conditions": []})]),
    ("webui_gates", "chrome/browser/ui/webui/h@n_ui.cc",
     'void Add() {~  source->AddBoolean("show@n", base::FeatureList::IsEnabled(features::kA@n) &&~      (x(1, 2) || blink::features::kB));~  source->AddInteger("size", @s);~  // source->AddBoolean("no", true);~}~',
     [("webui_gate", "h@n_ui/show@n", "show@n", 2, {"data_key": "show@n", "handler": "h@n_ui", "value_type": "boolean", "expression": "base::FeatureList::IsEnabled(features::kA@n) && (x(1, 2) || blink::features::kB)", "features": ["kA@n", "kB"], "enabled_checks": ["kA@n"]}),
      ("webui_gate", "h@n_ui/size", "size", 4, {"data_key": "size", "handler": "h@n_ui", "value_type": "integer", "expression": "@s", "features": [], "enabled_checks": []})]),
]
#: Files (path, text or null, condition on the part) that can't be parsed, test files, which are out of scope, empty files, and files that could not be read.
BROKEN: list[tuple[str, str | None, str]] = [
    ("chrome/browser/bad@n/flag-metadata.json", "[ { ", "p_partkey % 50 = 0"),
    ("chrome/test/t@n_features.cc", 'BASE_FEATURE(kT, "T", base::FEATURE_ENABLED_BY_DEFAULT);', "true"),
    ("chrome/browser/empty@n_features.cc", "", "p_partkey % 40 = 0"),
    ("chrome/browser/unread@n_features.cc", None, "p_partkey % 40 = 1"),
]


#: (snapshot, condition on the part, its size) of two versions of the corpus.
VERSIONS = (("v1", "p_partkey % 11 <> 0", "p_size"), ("v2", "p_partkey % 13 <> 0", "p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END"))


def filled(text: str, size: str = "p_size") -> str:
    """SQL for a template. '@(3)' is '@3', '@@' an at sign."""
    parts = re.split(r"(@n|@s|@\(|@@)", text)
    cells = {"@n": "p_partkey", "@s": size, "@(": "'@'", "@@": "'@'"}
    out, close = [], False
    for p in parts:
        if close:  # the bracket of '@(' goes
            p = p.replace(")", "", 1)
        close = p == "@("
        if p in cells:
            out.append(cells[p])
        elif p:
            # Braces around a bare word would be a table's name.
            for k, bit in enumerate(re.split(r"(?<=\{)(?=\w+\})", p)):
                out.append("'" + bit.replace("'", "''") + "'")
    return f"replace(concat('', {', '.join(out)}), '~', chr(10))"


def files_sql(size: str = "p_size") -> str:
    """SQL for all files of a part: an array of (path, text), null for those that it lacks."""
    one = lambda path, text: f"named_struct('path', {filled(path)}, 'text', {filled(text, size) if text else {None: 'NULL', '': "''"}[text]})"
    cells = [one(path, text) for _, path, text, _ in FILES] + [f"if({where}, {one(path, text)}, NULL)" for path, text, where in BROKEN]
    return f"array({', '.join(cells)})"


def written(attrs: dict) -> str:
    """Attributes as one template: name=JSON, by name."""
    number = lambda v: re.sub(r'"=(@s)"', r"\1", v)
    return ";".join(f"{k}={number(json.dumps(v, sort_keys=True, separators=(',', ':')))}" for k, v in sorted(attrs.items()))


def expected_sql(where: str = "true", size: str = "p_size") -> str:
    """SQL for the facts in the files of some parts: extractor, path, kind, key, name, line, attrs."""
    rows = [
        f"SELECT '{e}' AS extractor, {filled(path)} AS path, '{kind}' AS kind, {filled(key)} AS key, {filled(name)} AS name, {line} AS line, {filled(written(attrs), f'({size})')} AS attrs FROM part WHERE {where}"
        for e, path, _, some in FILES for kind, key, name, line, attrs in some
    ]
    return " UNION ALL ".join(rows)


def _corpus(spark: SparkSession, sf: str, snapshot_id: str = "v1", where: str = "true", size: str = "p_size") -> DataFrame:
    """The files of some parts. A part's row is small and its files take long to parse: parts are dealt out before their files are made, in one scan."""
    parts = dealt(fixtures.read_sql(spark, sf, f"SELECT p_partkey, p_size FROM {{part}} WHERE {where}"), "p_partkey")
    rows = parts.select(F.explode(F.array_compact(F.expr(files_sql(f"({size})")))).alias("f"))
    return rows.select(F.lit(snapshot_id).alias("snapshot_id"), "f.path", "f.text", F.octet_length("f.text").cast("long").alias("size"))


def _flat_attrs() -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attrs")


def extract_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All facts of the corpus."""
    found = extractors.extract(_corpus(spark, sf))
    return found.where("kind is not null").select("extractor", "path", "kind", "key", "name", "line", _flat_attrs())


def _unused(text: str, path: str) -> list:
    return []


def extract_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Facts, files and failures by extractor, with one that reads no file."""
    known = extractors.EXTRACTORS | {"unused": _unused}
    return extractors.extract_stats(extractors.file_status(extractors.extract(_corpus(spark, sf), known)), known).drop("snapshot_id")


def _wanted(spark: SparkSession, *snapshots_: str) -> DataFrame:
    rows = [(v, f"15{v[1:]}.0.1.2", "default", ["ui"], True) for v in snapshots_]
    return spark.createDataFrame(rows, "snapshot_id string, ref string, target_set string, partitions array<string>, complete boolean")


def build_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus twice, once below a folder of another platform too, as one snapshot."""
    rows = _corpus(spark, sf)
    copies = rows.where("path like 'components/%'").withColumn("path", F.regexp_replace("path", "^components/x/", "components/x/android/"))
    lone = rows.where("path like 'services/%'").withColumn("path", F.regexp_replace("path", "^services/m/m", "services/mac/n")).withColumn("text", F.regexp_replace("text", "module m", "module n"))
    built = extractors.build_snapshot(rows.unionByName(copies).unionByName(lone), _wanted(spark, "v1"))
    return built.facts.select("kind", "key", "path", columns.platform_value("attrs", "platform_state").alias("state"))


#: What both versions of the corpus should have: one target is absent.
TARGETS = (("chrome", True, None), ("components/", True, None), ("services/", True, [".mojom"]), ("third_party/blink/", True, None), ("media/absent/", True, None))


def snapshot_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """E12, S2, Z1, Z2 from end to end: two versions of a corpus become committed snapshots, which are read back, compared and ranked.

    Headers come from what was read: unreadable files, files that can't be parsed, and a target that isn't there.
    """
    path = work_path(spark, "snapshots")
    scope = spark.createDataFrame([(v, *row) for v, _, _ in VERSIONS for row in TARGETS], "snapshot_id string, path string, is_tree boolean, suffixes array<string>")
    for v, where, size in VERSIONS:
        built = extractors.build_snapshot(_corpus(spark, sf, v, where, size), _wanted(spark, v), scope)
        store.write_snapshot(built.facts, built.header, path)
    facts, headers, pairs = store.read_facts(spark, path), store.read_headers(spark, path), fixtures.pairs(spark)
    changes = diff.compare(facts, headers, pairs, 200)
    found = scoring.rank(changes, spark.createDataFrame([], "snapshot_id string, surface string, candidates long, read long"), headers, pairs)
    gap = scoring.incomplete_reason(headers).where("snapshot_id = 'v2'").select("gap")  # one row
    return found.select("kind", "key", "change_type", F.exists("reasons", lambda r: r.contains("unconfirmed")).alias("unconfirmed")).join(F.broadcast(gap))


def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    """X8, X18 of all listed paths."""
    p = F.col("path")
    long = F.concat(F.lit("some/far/away/folder/"), p)
    return fixtures.listing(spark, sf).select("snapshot_id", "path", columns.surface_of(p).alias("surface"), columns.page_of(p).alias("page"), columns.stem_of(p).alias("stem"), columns.trim_location(long).alias("trimmed"))


NAMES = "SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'k' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS name, concat('refs/', CASE WHEN p_partkey % 4 = 0 THEN 'tags/' ELSE 'heads/M' END, 100 + p_partkey % 60, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('.', p_size, '.1.2') END) AS ref, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'test' WHEN 2 THEN 'experimental' WHEN 3 THEN 'stable' ELSE 'other' END AS status FROM {part}"


def name_functions(spark: SparkSession, sf: str) -> DataFrame:
    """X1 to X4, X10, X16 of part names."""
    n = F.col("name")
    rows = fixtures.read_sql(spark, sf, NAMES)
    version = columns.parse_version(F.substring_index("ref", "/", -1))
    return rows.select("id", columns.feature_name_from_var(n).alias("bare"), columns.norm_identifier(n).alias("identifier"), columns.norm_ascii(n).alias("ascii"), columns.collapse_ws(F.concat(F.lit("  "), F.regexp_replace("name", " ", " \t\n "))).alias("line"), F.coalesce(F.array_join(F.transform(version, lambda x: x.cast("string")), "-"), F.lit("")).alias("version"), columns.milestone_from_ref(F.col("ref")).alias("milestone"), columns.status_rank(F.col("status")).alias("rank"))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """X17, R7, A13's percentage: of order lines."""
    rows = fixtures.read_sql(spark, sf, "SELECT DISTINCT l_suppkey AS id, CAST(l_partkey % 50 AS BIGINT) AS candidates, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_suppkey % 60 AS BIGINT) END AS n_read FROM {lineitem}")
    c, r = F.col("candidates"), F.col("n_read")
    return rows.select("id", "candidates", "n_read", columns.share(c, r).alias("share"), columns.read_percent(columns.share(c, r)).alias("words"), columns.coverage_percent(c, F.coalesce(r, F.lit(0))).alias("percent"))


#: Conditions and what they are for us: the left one is known where p_size is even, the right one where it is a multiple of three.
_LEFT = "CASE WHEN p_size % 2 = 0 THEN '{0}' WHEN p_size % 5 = 0 THEN '{1}' ELSE '{2}' END"
_RIGHT = "CASE WHEN p_size % 3 = 0 THEN '{0}' WHEN p_size % 7 = 0 THEN '{1}' ELSE '{2}' END"
_CPP = ("BUILDFLAG(IS_WIN)", "defined(IS_ANDROID)", "BUILDFLAG(ENABLE_X)")
_TEMPLATE = ("is_win", "is_macosx", "_branded")
_ATTRIBUTE = ("is_win", "is_ios_iphoneos", "enable_pdf")
GUARDS = (
    f"SELECT p_partkey AS id, 'cpp' AS dialect, concat({_LEFT.format(*_CPP)}, ' && !(', {_RIGHT.format(*_CPP)}, ')') AS condition FROM {{part}}"
    f" UNION ALL SELECT p_partkey, 'template', concat('not ', {_LEFT.format(*_TEMPLATE)}, ' or ', {_RIGHT.format(*_TEMPLATE)}) FROM {{part}}"
    f" UNION ALL SELECT p_partkey, 'attribute', concat('EnableIfNot=', {_LEFT.format(*_ATTRIBUTE)}, '|', {_RIGHT.format(*_ATTRIBUTE)}) FROM {{part}}"
)


def build_guards(spark: SparkSession, sf: str) -> DataFrame:
    """X11, X12 of conditions of parts, and X13 of each part's three."""
    held = stored(resolve_guards(fixtures.read_sql(spark, sf, GUARDS)), "guards")
    state = held.groupBy("id").agg(columns.guard_platform_state(F.transform(F.collect_list(F.struct("holds")), lambda x: x["holds"])).alias("state"))
    return held.join(state, "id").select("id", "dialect", F.coalesce(F.col("holds").cast("string"), F.lit("unknown")).alias("holds"), "state")


#: Signatures: any white space at '·', any number of nested types.
SIGNATURES = "SELECT p_partkey AS id, concat('Promise<long> m', p_partkey, '(· long a ·,·optional sequence<', p_size, '·> b = \"x, ,(y\"', CASE WHEN p_partkey % 3 = 0 THEN ',(long or map<K, V>)... rest' ELSE '' END, '·)') AS raw, concat('[A', p_partkey, '=(x,y), B·=·', p_size, ' , C]') AS ext FROM {part}"


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """X5 to X7, C6 of signatures of parts, with white space put in."""
    blank = F.when(F.col("id") % 2 == 0, " ").otherwise("\n  ")
    rows = fixtures.read_sql(spark, sf, SIGNATURES).select("id", F.replace("raw", F.lit("·"), blank).alias("raw"), F.replace("ext", F.lit("·"), blank).alias("ext"))
    inner = F.regexp_extract("raw", r"(?s)\((.*)\)", 1)
    one = text_function(normalize_signature)(F.col("raw"))
    params = text_function(normalize_params)(inner)
    ext = text_function(lambda t: ";".join(f"{k}={v}" for k, v in sorted(parse_ext_attrs(t[1:-1]).items())))(F.col("ext"))
    arity = text_function(lambda t: str(arity_range(t)))(F.regexp_replace("raw", "\"[^\"]*\"", "1"))
    return rows.select("id", one.alias("signature"), params.alias("params"), ext.alias("ext"), arity.alias("arity"))


def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written as snapshot files and tables, and read back."""
    rows = fact_operators.dedupe_facts(fixtures.raw_facts(spark, sf))
    path, table = work_path(spark, "snapshot-json"), work_path(spark, "snapshot-table")
    # One document of a snapshot is a row: grouped by a part of its keys, as real ones are by target set.
    parts = rows.withColumn("part", F.pmod(F.xxhash64("kind", "key"), F.lit(64)))
    made = parts.groupBy("snapshot_id", "part").agg(F.collect_list(F.struct("kind", "key", "name", "path", "line", columns.packed("attrs").alias("attrs"))).alias("facts"))
    made = made.withColumn("facts", F.transform("facts", lambda f: f.withField("attrs", columns.unpacked(f["attrs"]))))
    made = made.select("snapshot_id", F.concat(F.lit("15"), F.substring("snapshot_id", 2, 1), F.lit(".0.1.2")).alias("ref"), F.lit(151).alias("milestone"), F.lit("2026-01-01T00:00:00").alias("created"), F.when(F.col("part") < 60, 40).otherwise(39).alias("schema"), F.struct(F.lit("default").alias("target_set"), F.lit(True).alias("complete")).alias("meta"), "facts")
    snapshots.write_table(made, path, "json")
    headers, read = snapshots.read_snapshots(spark, path)
    store.write_snapshot(read, headers.select("snapshot_id", "ref", "target_set", "partitions", "complete").distinct(), table)
    back = store.read_facts(spark, table)
    fresh, stale = snapshots.fresh_snapshots(headers)
    sizes = back.groupBy("snapshot_id", "kind").agg(F.count("*").alias("n_facts"), F.sum("line").alias("lines"), F.sum(F.size("attrs")).cast("long").alias("n_attrs"))
    kept = fresh.groupBy("snapshot_id").agg(F.count("*").alias("n_fresh"))
    old = headers.where(F.col("schema") != 40).groupBy("snapshot_id").agg(F.count("*").alias("n_old"))
    return sizes.join(kept, "snapshot_id").join(old, "snapshot_id").select("snapshot_id", "kind", "n_facts", "lines", "n_attrs", (F.col("n_fresh") + F.col("n_old")).alias("n_documents"))


def listing_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Both versions' listings written as texts and read back."""
    path, out = work_path(spark, "listing"), []
    rows = fixtures.listing(spark, sf).select("snapshot_id", F.concat("path", F.when(F.xxhash64("path") % 5 == 0, "\n").otherwise("")).alias("value"))
    for v in ("v1", "v2"):
        rows.where(F.col("snapshot_id") == v).select("value").write.text(f"{path}/{v}")
        out.append(snapshots.read_listing(spark, f"{path}/{v}", v))
    return out[0].unionByName(out[1])


def briefs_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Briefs written as upstream texts of both shapes, and read back."""
    path = work_path(spark, "briefs")
    rows = fixtures.briefs(spark, sf).withColumn("part", F.col("id") % 40)
    body = F.struct("name", "feature_name", "shortname", "id", "summary", "category", "standards", "browsers")
    flat = rows.where("part % 2 = 0").groupBy("part").agg(F.to_json(F.collect_list(body)).alias("t"))
    nested = rows.where("part % 2 = 1").groupBy("part", "shipping_type").agg(F.collect_list(body).alias("some")).groupBy("part").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("shipping_type", "some"))).alias("features_by_type"))).alias("t"))
    flat.unionByName(nested).select(F.concat(F.lit(")]}'\n"), "t").alias("value")).repartition(8).write.option("lineSep", "\u0001").text(path)
    read = snapshots.read_feature_briefs(spark, path, 150, "\u0001")
    return read.select("id", "name", F.coalesce("feature_name", F.lit("")).alias("feature_name"), "category", "shipping_type", "standards.spec", F.coalesce("browsers.chrome.desktop", F.lit("")).alias("desktop"), F.length("summary").cast("long").alias("n_chars"))


def spoil(spark: SparkSession, path: str) -> list[str]:
    """Put three odd files below a folder and return their names: one whose checksum is wrong, an empty one, and one that is gone.

    Checksums are the local file system's, where tests run; on another one the first is emptied and stays readable.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/odd")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("broken.cc", "empty.cc"):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
        out.write(b"const char kA[] = 'x';" if name == "broken.cc" else b"")
        out.close()
    raw = fs.getRawFileSystem() if hasattr(fs, "getRawFileSystem") else fs
    out = raw.create(spark._jvm.org.apache.hadoop.fs.Path(root, "broken.cc"), True)
    out.write(b"const char kB[] = 'y';")
    out.close()
    return ["odd/broken.cc", "odd/empty.cc", "odd/gone.cc"]


def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files and read back by a listing, with a broken, an empty and a missing file."""
    path = work_path(spark, "corpus")
    docs = fixtures.read_sql(spark, sf, "SELECT doc_id, text, source FROM {documents}")
    docs.select("source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value")).write.partitionBy("source").text(path)
    odd = spark.createDataFrame([(n,) for n in spoil(spark, path)], "path string")
    listing = snapshots.list_files(spark, path, "v1").where("path like 'source=%'").select("path").unionByName(odd).distinct()
    read = snapshots.read_corpus(spark, path, "v1", listing)
    place = F.when(F.col("path").startswith("odd/"), F.col("path")).otherwise(F.regexp_extract("path", "^source=([^/]+)/", 1))
    return read.groupBy(place.alias("place")).agg(F.sum(F.length("text").cast("long")).alias("n_chars"), F.coalesce(F.max("error"), F.lit("")).alias("error"))


QUERIES = {f.__name__: f for f in (extract_facts, extract_stats, build_snapshot, snapshot_pipeline, path_functions, name_functions, shares, build_guards, signatures, snapshot_round_trip, listing_round_trip, briefs_round_trip, corpus_round_trip)}
