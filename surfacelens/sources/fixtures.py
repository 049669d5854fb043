"""Two versions of a surface, derived from the given tables by integer arithmetic.

Every kind is written as expressions that Spark and DuckDB both run: a row per raw declaration. For DuckDB the
attributes lie in flat columns (null: missing), a SELECT a version; for Spark they are the attribute map, and one SELECT has all versions. Version 1
lacks ids divisible by 11, version 2 those divisible by 13; version 2 changes states, paths,
keys and identifiers at other divisors. Versions 3 and 4 go on in the same way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import unpacked

#: Flat attribute columns whose value is a JSON string of the same name; a JSON number or truth value; and a list or object around it.
PLAIN = (
    "var", "default_state", "status", "windows_status", "base_feature", "origin_trial_feature_name", "depends_on", "runtime_enabled", "interface", "struct", "signature", "member_type",
    "idl_kind", "inherits", "type", "route", "parent", "control", "pref", "label", "surface", "page", "data_key", "handler", "expression", "feature", "default", "mojo_kind", "attrs", "min_version",
)
NUMBERS = ("ordinal", "expiry_milestone", "position", "stable", "field_count", "method_count")
WRAPPED = {
    "windows": ("platform_state", '{"windows":"', '"}'), "status_windows": ("platform_status", '{"windows":"', '"}'), "ext_gate": ("ext", '{"RuntimeEnabled":"', '"}'),
    "guard": ("guards", '["', '"]'), "gate_feature": ("features", '["', '"]'), "condition": ("conditions", '["', '"]'), "build_condition": ("build_conditions", '["', '"]'),
    "check": ("enabled_checks", '["', '"]'), "value": ("values", '["kNone","', '"]'),
}
COLUMNS = (*PLAIN, *NUMBERS, *WRAPPED)


def attribute(column: str) -> str:
    """The attribute that a flat column holds."""
    return WRAPPED[column][0] if column in WRAPPED else column


def json_text(column: str, value: str) -> str:
    """SQL for the attribute's JSON text; null where the value is."""
    before, after = WRAPPED[column][1:] if column in WRAPPED else ('"', '"') if column in PLAIN else ("", "")
    return f"('{before}' || {value} || '{after}')"


_DIR = "CASE ({0}) % 6 WHEN 0 THEN 'chrome/browser/ui' WHEN 1 THEN 'components/prefs/android' WHEN 2 THEN 'content/public' WHEN 3 THEN 'ash/system' WHEN 4 THEN 'third_party/blink/common' ELSE 'chrome/browser/resources/settings' END"


#: A version lacks the ids divisible by its number.
LACKS = {1: 11, 2: 13, 3: 17, 4: 19}


@dataclass
class Kind:
    """One kind's rows of one version."""

    version: int
    kind: str
    source: str
    id: str
    key: str
    name: str
    file: str
    line: str
    attrs: dict[str, str]
    where: str = ""

    def cells(self) -> tuple[str, str]:
        """(path, condition) of a row."""
        v = self.version
        moved = f"({self.id}) + (CASE WHEN {v} % 2 = 0 AND ({self.id}) % 17 = 0 THEN 1 ELSE 0 END)"
        path = f"concat({_DIR.format(moved)}, '/', {self.file})"
        kept = f"({self.id}) % {LACKS[v]} <> 0" + (f" AND {self.where}" if self.where else "")
        return path, kept

    def sql(self) -> str:
        """One SELECT with the attributes as flat columns, for DuckDB."""
        path, kept = self.cells()
        cells = ", ".join(f"{self.attrs.get(c, 'CAST(NULL AS STRING)')} AS a_{c}" for c in COLUMNS)
        return f"SELECT 'v{self.version}' AS snapshot_id, '{self.kind}' AS kind, {self.key} AS key, {self.name} AS name, {path} AS path, CAST({self.line} AS INT) AS line, {cells} FROM {{{self.source}}} WHERE {kept}"

    def columns(self) -> dict[str, str]:
        """A row's condition, columns and attributes, as SQL."""
        path, kept = self.cells()
        attrs = {attribute(c): json_text(c, f"({x})") for c, x in self.attrs.items()}
        return {"kept": kept, "key": self.key, "name": self.name, "path": path, "line": f"CAST({self.line} AS INT)"} | {f"attrs.{n}": attrs[n] for n in sorted(attrs)}


def every_version(some: tuple[Kind, ...]) -> str:
    """One SELECT with a kind's rows of all versions and the attributes as one text (see ``columns.packed``), for Spark: a scan of the source, a row a version.

    What all versions say alike is written once. Columns are plain expressions over the source's row, which Spark compiles; a generator's or a lambda's would be interpreted.
    """
    each = {k.version: k.columns() for k in some}
    first = each[some[0].version]
    of = {c: x if all(e[c] == x for e in each.values()) else "CASE __v " + " ".join(f"WHEN {v} THEN {e[c]}" for v, e in each.items()) + " END" for c, x in first.items()}
    entries = ", ".join(f"coalesce(concat('\\u0000{c.removeprefix('attrs.')}\\u0001', {x}), '')" for c, x in of.items() if c.startswith("attrs."))
    cells = ", ".join(f"{of[c]} AS {c}" for c in ("key", "name", "path", "line"))
    return f"SELECT concat('v', __v) AS snapshot_id, '{some[0].kind}' AS kind, {cells}, substring(concat({entries}), 2) AS packed FROM (SELECT *, explode(array({', '.join(map(str, each))})) AS __v FROM {{{some[0].source}}}) WHERE {of['kept']}"


def _text(number: str) -> str:
    return f"concat('', {number})"


def _version(v: int) -> list[Kind]:
    new = v % 2 == 0
    part, flag, member = "p_partkey", "s_suppkey", "(l_suppkey % 25 * 300 + l_partkey % 300)"
    renamed = lambda id_, by, a, b: f"CASE WHEN {id_} % {by} = 0 THEN {b} ELSE {a} END" if new else a
    step = lambda id_, by: f"CASE WHEN {id_} % {by} = 0 THEN {v} ELSE 0 END"
    flip = f"(p_size + CASE WHEN {part} % 7 = 0 THEN {int(new)} ELSE 0 END)"
    windows = f"CASE {part} % 10 WHEN 0 THEN 'not_compiled' WHEN 1 THEN 'enabled' WHEN 2 THEN '{'conditional' if new else 'disabled'}' WHEN 3 THEN 'compiled' END"
    symbol = f"concat('k{'G' if new else 'F'}', {part})"
    status = f"CASE ({flag} + {step(flag, 3)}) % 4 WHEN 0 THEN '' WHEN 1 THEN 'test' WHEN 2 THEN 'experimental' ELSE 'stable' END"
    stable = lambda id_, by: f"CASE WHEN ({id_} + {step(id_, by)}) % 4 = 1 THEN 'true' END"
    rows = [
        ("base_feature", "part", part, renamed(part, 19, f"concat('F', {part})", f"concat('F', {part}, 'R')"), f"concat('F', {part})", f"concat('f', {part} % 50, '_features.cc')", f"{part} % 900", {"var": f"CASE WHEN {part} % 23 = 0 THEN {symbol} ELSE concat('kF', {part}) END", "default_state": f"CASE WHEN {flip} % 2 = 0 THEN 'enabled' ELSE 'disabled' END", "windows": windows, "condition": f"CASE WHEN {part} % 12 = 5 THEN concat('BUILDFLAG(B', {part} % 5 + {step(part, 5)}, ')') END"}, ""),
        ("feature_param", "part", part, f"concat('F', {part}, '/p')", "'p'", f"concat('f', {part} % 50, '_features.cc')", f"{part} % 900 + 1", {"feature": f"concat('F', {part} - {part} % 3 + {step(part, 31)})", "type": f"CASE WHEN {part} % 27 = 1 THEN 'int{v}' ELSE 'int' END", "default": f"concat('', p_size + CASE WHEN {part} % 9 = 1 THEN {v} ELSE 0 END)", "var": f"CASE WHEN {part} % 35 = 5 THEN 'kQ{v}' ELSE concat('kP', {part}) END"}, f"{part} % 4 = 1"),
        ("flag_entry", "part", part, f"concat('flag-', {part})", f"concat('flag-', {part})", "'flag-metadata.json'", f"{part} % 500", {"expiry_milestone": _text(f"{part} % 60 + {v} * ({part} % 3)")}, f"{part} % 5 = 0"),
        ("webui_control", "part", part, renamed(part, 5, f"concat('settings/page', {part} % 20, '/c', {part})", f"concat('settings/page', {part} % 20, '/d', {part})"), f"concat('c', {part})", f"concat('page', {part} % 20, '.html')", f"{part} % 300", {"surface": f"CASE WHEN {part} % 41 <> 0 THEN 'settings' END", "page": f"concat('page', {part} % 20)", "control": f"CASE WHEN {part} % 29 = 0 THEN 'settings-dropdown{v}' WHEN {part} % 15 = 5 THEN 'cr-link-row{v}' ELSE 'cr-toggle' END", "pref": f"concat('pref.s', ({part} + {int(new)} * CASE WHEN {part} % 5 = 0 OR {part} % 33 = 1 THEN 1 ELSE 0 END) % 120)", "label": f"CASE WHEN {part} % 8 = 0 THEN concat('Route', {part} % 25) WHEN {part} % 37 = 1 THEN concat('label', {part}, 'v{v}') ELSE concat('label', {part}) END", "build_condition": f"CASE WHEN {part} % 6 = 1 THEN concat('not is_x', {step(part, 7)}) END"}, ""),
        ("pref", "supplier", flag, renamed(flag, 19, f"concat('pref.s', {flag})", f"concat('pref.s', {flag}, 'r')"), f"concat('pref.s', {flag})", "'pref_names.cc'", flag, {"var": f"concat('kPrefS', {flag} + 1000 * {step(flag, 29)})", "windows": f"CASE WHEN ({flag} + {step(flag, 9)}) % 5 = 0 THEN 'not_compiled' END"}, ""),
        ("switch", "customer", "c_custkey", renamed("c_custkey", 19, "concat('switch-', c_custkey)", "concat('switch-', c_custkey, '-r')"), "concat('switch-', c_custkey)", "concat('s', c_custkey % 9, '_switches.cc')", "c_custkey % 2000", {"var": f"CASE WHEN c_custkey % 23 = 0 THEN concat('kS{v}x', c_custkey) ELSE concat('kS', c_custkey) END"}, ""),
        ("mojo_method", "orders", "o_orderkey", "concat('m.I', o_orderkey % 97, '.M', o_orderkey)", "concat('M', o_orderkey)", "concat('m', o_orderkey % 97, '.mojom')", "o_orderkey % 700", {"interface": "concat('m.I', o_orderkey % 97)", "signature": f"concat('M(int a', o_custkey % 3 + {step('o_orderkey', 7)}, ')')", "ordinal": f"CASE WHEN o_orderkey % 5 = 0 THEN concat('', o_orderkey % 50 + {step('o_orderkey', 25)}) END", "position": f"CASE WHEN o_orderkey % 6 = 0 THEN concat('', o_orderkey % 9 + {step('o_orderkey', 12)}) WHEN {v} = 1 AND o_orderkey % 6 = 1 THEN '3' END", "attrs": f"CASE WHEN o_orderkey % 8 = 1 THEN concat('Sync', {step('o_orderkey', 3)}) END", "windows": f"CASE WHEN o_orderkey % 40 = {v} THEN 'not_compiled' END"}, ""),
        ("mojo_interface", "supplier", flag, f"concat('m.I', {flag})", f"concat('I', {flag})", f"concat('m', {flag}, '.mojom')", flag, {"stable": stable(flag, 5), "method_count": _text(f"{flag} % 4"), "windows": f"CASE WHEN ({flag} + {step(flag, 7)}) % 9 = 0 THEN 'not_compiled' END"}, ""),
        ("mojo_struct", "customer", "c_custkey", "concat('m.S', c_custkey)", "concat('S', c_custkey)", "concat('d', c_custkey % 40, '.mojom')", "c_custkey % 800", {"mojo_kind": f"CASE WHEN (c_custkey + {step('c_custkey', 16)}) % 3 = 0 THEN 'union' ELSE 'struct' END", "stable": stable("c_custkey", 10), "field_count": _text("c_custkey % 5"), "windows": f"CASE WHEN (c_custkey + {step('c_custkey', 14)}) % 20 = 0 THEN 'conditional' END"}, ""),
        ("mojo_enum", "customer", "c_custkey", "concat('m.E', c_custkey)", "concat('E', c_custkey)", "concat('d', c_custkey % 40, '.mojom')", "c_custkey % 800", {"value": f"concat('kV', c_custkey % 7 + {step('c_custkey', 6)})", "stable": stable("c_custkey", 15)}, "c_custkey % 2 = 0"),
        ("mojo_field", "lineitem", "l_orderkey", "concat('m.S', l_orderkey, '.f', l_linenumber)", "concat('f', l_linenumber)", "concat('d', l_suppkey % 40, '.mojom')", "l_partkey", {"struct": "concat('m.S', l_orderkey)", "type": f"concat('t', l_partkey % 4 + {step('l_orderkey', 7)})", "default": f"CASE WHEN l_partkey % 6 = 0 THEN concat('', l_suppkey % 3 + {step('l_orderkey', 10)}) END", "attrs": f"CASE WHEN l_partkey % 9 = 1 THEN concat('MinVersion=', {step('l_orderkey', 4)}) END", "min_version": f"CASE WHEN l_partkey % 9 = 1 THEN concat('', {step('l_orderkey', 4)}) END", "position": f"CASE WHEN l_orderkey % 15 = 0 THEN concat('', l_linenumber + {step('l_orderkey', 30)}) END"}, ""),
        ("idl_member", "lineitem", member, "concat('I', l_suppkey % 25, '.m', l_partkey % 300)", "concat('m', l_partkey % 300)", "concat('i', l_suppkey % 25, '.idl')", f"l_linenumber + {v}", {"interface": "concat('I', l_suppkey % 25)", "signature": f"CASE l_linenumber + {step('l_partkey', 7)} WHEN 1 THEN 'void m()' WHEN 2 THEN 'void m(long a)' WHEN 3 THEN 'void m(long a, optional long b)' WHEN 4 THEN 'void m(long... c)' WHEN 5 THEN 'void m((long or D) a, optional sequence<long> b = [1, 2])' ELSE 'void m(DOMString d)' END", "runtime_enabled": f"CASE WHEN l_partkey % 5 = 0 THEN concat('Gate', (l_partkey + {step('l_partkey', 6)}) % 7) END", "member_type": f"CASE WHEN {member} % 21 = 0 THEN 'attribute{v}' ELSE 'operation' END"}, "l_partkey % 3 = 0"),
        ("idl_interface", "supplier", flag, f"concat('I', {flag})", f"concat('I', {flag})", f"concat('i', {flag}, '.idl')", flag, {"ext_gate": f"CASE WHEN {flag} % 4 = 0 THEN concat('Gate', {flag} % 5 + {v} - 1) END", "idl_kind": f"CASE WHEN {flag} % 10 = 3 THEN 'dictionary{v}' ELSE 'interface' END", "inherits": f"concat('J', {step(flag, 8)})", "value": f"CASE WHEN {flag} % 9 = 2 THEN concat('x', {step(flag, 2)}) END"}, ""),
        ("blink_runtime_feature", "region", "r_regionkey + 1", "concat('Gate', r_regionkey)", "r_name", "'runtime_enabled_features.json5'", "r_regionkey", {"windows_status": f"CASE (r_regionkey + {v}) % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'experimental' ELSE 'test' END", "base_feature": "CASE WHEN r_regionkey % 2 = 0 THEN concat('kF', r_regionkey * 7 + 1) ELSE 'none' END"}, ""),
        ("blink_runtime_feature", "supplier", flag, f"concat('Flag', {flag})", f"concat('Flag', {flag})", "'runtime_enabled_features.json5'", flag, {"windows_status": status, "status": f"CASE WHEN {flag} % 10 = 5 THEN 'per-platform{v}' WHEN {flag} % 10 = 6 THEN 'per-platform' END", "status_windows": f"CASE WHEN {flag} % 10 = 6 THEN CASE WHEN {flag} % 4 = {v} THEN 'stable' ELSE 'test' END END", "base_feature": f"CASE WHEN {flag} % 2 = 0 THEN concat('kF', {flag} * 7 + {step(flag, 14)}) ELSE 'none' END", "origin_trial_feature_name": f"CASE WHEN {flag} % 16 = 1 THEN 'Trial{v}' END", "depends_on": f"CASE WHEN {flag} % 18 = 1 THEN 'Flag{v}' END"}, ""),
        ("webui_route", "nation", "n_nationkey + 1", "concat('settings/ROUTE', n_nationkey)", "concat('Route', n_nationkey)", "'route.ts'", "n_nationkey", {"surface": "'settings'", "route": f"concat('/', n_name, CASE WHEN n_nationkey % 7 = 0 THEN '{v}' ELSE '' END)", "parent": f"CASE WHEN n_nationkey % 5 = 0 THEN 'BASIC{v}' ELSE 'BASIC' END", "guard": f"concat('show', n_nationkey + {step('n_nationkey', 6)})"}, ""),
        ("webui_gate", "nation", "n_nationkey + 1", "concat('settings_ui/show', n_nationkey)", "concat('show', n_nationkey)", "'settings_ui.cc'", "n_nationkey", {"data_key": "concat('show', n_nationkey)", "handler": "CASE WHEN n_nationkey % 2 = 0 THEN 'settings_ui' ELSE 'history_util' END", "expression": f"concat('IsEnabled(', n_regionkey + {step('n_nationkey', 5)}, ')')", "gate_feature": f"concat('kF', n_nationkey * 3 + 1 + {step('n_nationkey', 4)})", "check": f"CASE WHEN n_nationkey % 3 = 0 THEN 'kX{v}' END"}, "n_nationkey % 9 <> 4"),
    ]
    return [Kind(v, *r) for r in rows]


KINDS = [*_version(1), *_version(2)]
FLAT = " UNION ALL ".join(k.sql() for k in KINDS)
#: Four versions in a chain, and the pairs of them that are compared.
CHAIN = [k for v in LACKS for k in _version(v)]
CHAIN_FLAT = " UNION ALL ".join(k.sql() for k in CHAIN)
CHAIN_PAIRS = [(f"v{a}-v{b}", f"v{a}", f"v{b}") for a, b in ((1, 2), (2, 3), (3, 4), (1, 4), (4, 2))]


def duckdb_sql(text: str) -> str:
    """The same SQL for DuckDB, over the tables' views."""
    out = re.sub(r"\{(\w+)\}", r"\1", text)
    return out.replace("AS STRING)", "AS VARCHAR)")


def read_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the given tables, named in braces."""
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def raw_facts(spark: SparkSession, sf_dir: str, chain: bool = False) -> DataFrame:
    """Raw declarations of both versions, or of all four of the chain, in the fact schema: one scan a kind gives those of all versions.

    The attributes are there as a text too (``packed``), from which the map is made where it is asked for.
    """
    each = zip(*(_version(v) for v in (LACKS if chain else (1, 2))), strict=True)
    # Methods that are longer than the JVM compiles would be interpreted: Spark then takes operators one by one.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    rows = read_sql(spark, sf_dir, " UNION ALL ".join(map(every_version, each)))
    return rows.select("snapshot_id", "kind", "key", "name", "path", "line", unpacked(F.col("packed")).alias("attrs"), "packed")


def chain_pairs(spark: SparkSession) -> DataFrame:
    """The pairs of the chain."""
    return spark.createDataFrame(CHAIN_PAIRS, "pair_id string, from_id string, to_id string")


def headers(spark: SparkSession) -> DataFrame:
    """Snapshot headers of both versions and of ones that can't be compared."""
    rows = [("v1", "151.0.1.1", 151, "default", ["a"], True, [], 0), ("v2", "152.0.2.9", 152, "default", ["a"], True, ["x"], 2), ("v3", "153.0.0.1", 153, "wide", ["a", "b"], True, [], 0), ("v4", "154.0.0.1", 154, "default", ["a"], True, ["x", "y"], 0)]
    return spark.createDataFrame(rows, "snapshot_id string, ref string, milestone int, target_set string, partitions array<string>, complete boolean, missing_targets array<string>, parse_errors int")


def pairs(spark: SparkSession, every: bool = False) -> DataFrame:
    """The pair that is compared; with ``every`` also pairs that can't be."""
    rows = [("v1-v2", "v1", "v2")] + [(f"v1-{x}", "v1", x) for x in ("v3", "v4", "v9")] * every
    return spark.createDataFrame(rows, "pair_id string, from_id string, to_id string")


#: Paths of both versions' listings: made of document ids and sources, in product and other folders.
LISTING = " UNION ALL ".join(
    f"SELECT 'v{v}' AS snapshot_id, concat(CASE doc_id % 14 WHEN 0 THEN 'chrome/browser/ui/' WHEN 1 THEN 'components/prefs/android/' WHEN 2 THEN 'content/test/' WHEN 3 THEN 'third_party/zlib/' WHEN 4 THEN 'third_party/blink/renderer/' WHEN 5 THEN 'tools/gen/' WHEN 6 THEN 'ash/system/' WHEN 7 THEN 'chrome/browser/resources/settings/' WHEN 8 THEN 'chrome/browser/ui/webui/' WHEN 9 THEN 'components/chromeos/' WHEN 10 THEN 'base/third_party/opus/' WHEN 11 THEN 'android/' WHEN 12 THEN 'chrome/browser/resources/settings/a_page/' ELSE 'services/network/' END, source, '/', CASE doc_id % 11 WHEN 0 THEN concat('a', doc_id, '_features.cc') WHEN 1 THEN concat('a', doc_id, '.mojom') WHEN 2 THEN concat('a', doc_id, '.idl') WHEN 3 THEN concat('a', doc_id, '_unittest.cc') WHEN 4 THEN concat('a', doc_id, '_switches.cc') WHEN 5 THEN concat('page', doc_id, '.html.ts') WHEN 6 THEN concat('a', doc_id, '_util.cc') WHEN 7 THEN 'route.ts' WHEN 8 THEN concat('a', doc_id, '_prefs.h') WHEN 9 THEN concat('a', doc_id, '_test_util.cc') ELSE concat('a', doc_id, '_switches_and_features.h') END) AS path FROM {{documents}} WHERE doc_id % {11 if v == 1 else 13} <> 0"
    for v in (1, 2)
)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions' path listings."""
    return read_sql(spark, sf_dir, LISTING)


SCOPE = (("chrome/browser/", True, None), ("services/", True, [".mojom"]), ("third_party/blink/", True, [".idl", ".cc"]), ("components/prefs/android/pref_names.cc", False, None), ("content/public/", True, None))


def scope(spark: SparkSession) -> DataFrame:
    """What both versions read."""
    return spark.createDataFrame([(f"v{v}", *row) for v in (1, 2) for row in SCOPE], "snapshot_id string, path string, is_tree boolean, suffixes array<string>")


PARTITIONS = (("core", "chrome/common/pref_names.h", True), ("core", "services/network/", True), ("ui", "chrome/browser/", True), ("ui", "chrome/browser/ui/webui", True), ("ui", "chrome/common/chrome_features.cc", True), ("engine", "third_party/blink/", False))


def partitions(spark: SparkSession) -> DataFrame:
    """Named parts of a tree, and whether they can be read whole."""
    return spark.createDataFrame(PARTITIONS, "name string, prefix string, closable boolean")


#: Feature briefs, made of parts: some names are those of features, some summaries are long.
BRIEFS = "SELECT CAST(140 + p_partkey % 9 AS INT) AS milestone, CASE WHEN p_partkey % 4 = 0 THEN concat('F-', p_partkey) WHEN p_partkey % 50 = 1 THEN '' ELSE concat('flag ', p_partkey % 300) END AS name, CASE WHEN p_partkey % 3 = 0 THEN concat('Flag', p_partkey) END AS feature_name, CAST(p_partkey AS BIGINT) AS id, concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN repeat(concat('  some\n words ', p_partkey), 60) ELSE '' END) AS summary, p_brand AS category, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Enabled by default' END AS shipping_type, concat('https://spec/', p_partkey) AS spec, CASE WHEN p_partkey % 3 = 1 THEN concat('', 100 + p_partkey % 60) END AS desktop FROM {part}"


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature briefs in the upstream shape."""
    rows = read_sql(spark, sf_dir, BRIEFS)
    return rows.selectExpr("milestone", "name", "feature_name", "cast(null as string) shortname", "id", "summary", "category", "shipping_type", "struct(spec) standards", "struct(struct(desktop, cast(null as string) windows) chrome, struct(struct('Neutral' text) view) ff, struct(struct(cast(null as string) text) view) safari) browsers")
