"""DuckDB SQL of the registered queries, built from shared common table expressions.

What it checks is written out here a second time: rules of paths, attributes and words are not taken
from the library's tables.
"""

from __future__ import annotations

from ..functions import rules
from ..sources.fixtures import BRIEFS, CHAIN_FLAT, CHAIN_PAIRS, COLUMNS, FLAT, LISTING, attribute, duckdb_sql, json_text
from . import corpus

_ELSEWHERE = r"regexp_matches(path, '^(ash|chromeos|ios|android_webview|fuchsia|fuchsia_web|chromecast)/|/(ash|chromeos|ios|android|mac|linux)/')"
_KEY = "snapshot_id, kind, key"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


FACTS = f"""WITH raw AS ({duckdb_sql(FLAT)}),
stamped AS (SELECT * REPLACE (CASE WHEN bool_and({_ELSEWHERE}) OVER (PARTITION BY {_KEY}) THEN 'not_compiled' ELSE a_windows END AS a_windows) FROM raw),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY path, line, name, a_attrs NULLS LAST, a_default NULLS LAST, a_runtime_enabled NULLS LAST, a_signature) AS n FROM stamped) WHERE n = 1),
entries AS (SELECT DISTINCT {_KEY}, a_signature AS sig, coalesce(a_runtime_enabled, '') AS gate, path || CASE WHEN line = 0 THEN '' ELSE ':' || line END AS place FROM stamped WHERE kind = 'idl_member' AND coalesce(a_signature, '') <> ''),
overloads AS (SELECT {_KEY},
  CASE WHEN count(DISTINCT sig) > 1 THEN CAST(to_json(list_sort(list_distinct(list(sig)))) AS VARCHAR) END AS signatures,
  CASE WHEN count(DISTINCT gate) > 1 THEN CAST(to_json(list_sort(list(sig || ' [' || CASE WHEN gate = '' THEN 'ungated' ELSE gate END || ']'))) AS VARCHAR) END AS traits,
  CASE WHEN count(DISTINCT sig) > 1 THEN CAST(to_json(list_sort(list(sig || ' @ ' || place))) AS VARCHAR) END AS places
  FROM entries GROUP BY ALL),
facts AS MATERIALIZED (SELECT b.*, o.signatures, o.traits, o.places FROM best b LEFT JOIN overloads o USING ({_KEY}))"""


#: Which attributes each kind is compared by, as far as the derived facts have them. Written out here, apart from the library's own table.
COMPARED = {
    "base_feature": ("default_state", "windows", "condition", "var"),
    "feature_param": ("default", "type", "feature", "var", "windows"),
    "blink_runtime_feature": ("status", "status_windows", "windows_status", "base_feature", "origin_trial_feature_name", "depends_on"),
    "idl_interface": ("idl_kind", "inherits", "ext_gate", "value"),
    "idl_member": ("signature", "signatures", "traits", "member_type", "runtime_enabled"),
    "mojo_interface": ("stable", "windows"),
    "mojo_method": ("signature", "attrs", "ordinal", "position", "windows"),
    "mojo_struct": ("mojo_kind", "stable", "windows"),
    "mojo_field": ("type", "default", "attrs", "position", "min_version", "windows"),
    "mojo_enum": ("value", "stable", "windows"),
    "switch": ("var", "windows"),
    "pref": ("var", "windows"),
    "flag_entry": ("expiry_milestone",),
    "webui_route": ("route", "parent", "guard"),
    "webui_control": ("control", "pref", "label", "build_condition", "windows"),
    "webui_gate": ("expression", "gate_feature", "check"),
}
_SET_COLUMNS = {"signatures": "signatures", "traits": "overload_traits"}
_compared = sorted({c for cs in COMPARED.values() for c in cs})
_column = lambda side, c: f"{side}_{c}" if c in _SET_COLUMNS else f"{side}_a_{c}"
_held = lambda side, c: f"nullif({_column(side, c)}, 'compiled')" if c == "windows" else _column(side, c)
_attr = lambda c: _SET_COLUMNS.get(c, attribute(c))
_as_json = lambda side, c: _column(side, c) if c in _SET_COLUMNS else json_text(c, _held(side, c))


def _delta(c: str, value: str) -> str:
    """``value`` where a column moved between the sides, for the kinds it is compared for."""
    kinds = ", ".join(repr(k) for k, cs in COMPARED.items() if c in cs)
    both = f" AND {_column('o', c)} IS NOT NULL AND {_column('n', c)} IS NOT NULL" if c == "position" else ""
    return f"CASE WHEN kind IN ({kinds}) AND {_held('o', c)} IS DISTINCT FROM {_held('n', c)}{both} THEN {value} END"


_PATH_MOVED = "CASE WHEN o_path <> '' AND n_path <> '' AND o_path <> n_path THEN {0} END"
_DELTAS = [_delta(c, f"'{_attr(c)}'") for c in _compared] + [_PATH_MOVED.format("'path'")]
_VALUES = [_delta(c, f"'{_attr(c)}: ' || coalesce({_as_json('o', c)}, '-') || ' > ' || coalesce({_as_json('n', c)}, '-')") for c in _compared] + [_PATH_MOVED.format("'path: ' || o_path || ' > ' || n_path")]
_SIDES = ["name", "path", "line", "signatures", "traits", "places", *(f"a_{c}" for c in COLUMNS)]


def _has(*names: str) -> str:
    return f"list_has_any(deltas, [{', '.join(repr(n) for n in names)}])"


_S = {t: f"change_type = '{t}'" for t in ("added", "removed", "modified")}
_state = lambda s: f"coalesce(nullif({s}_a_windows, ''), {s}_a_default_state, '')"
#: Argument counts of the signatures that the derived facts have: [required, most (-1: no end)].
_ARITY = "(CASE {0} WHEN 'void m()' THEN [0, 0] WHEN 'void m(long a)' THEN [1, 1] WHEN 'void m(long a, optional long b)' THEN [1, 2] WHEN 'void m(long... c)' THEN [0, -1] WHEN 'void m((long or D) a, optional sequence<long> b = [1, 2])' THEN [1, 2] ELSE [1, 1] END)"
_list = lambda s: f"CASE WHEN {s}_signatures IS NULL THEN [coalesce({s}_a_signature, '')] ELSE from_json({s}_signatures, '[\"VARCHAR\"]') END"
_top = lambda x: f"(CASE WHEN {_ARITY.format(x)}[2] < 0 THEN {_ARITY.format(x)}[1] ELSE {_ARITY.format(x)}[2] END)"
_ceiling = f"(CASE WHEN len(list_filter(olds, lambda x: {_ARITY.format('x')}[2] < 0)) > 0 THEN NULL ELSE list_max(list_transform(olds, lambda x: {_ARITY.format('x')}[2])) END)"
_shadow = f"len(list_filter(gained, lambda g: len(list_filter(olds, lambda x: {_ARITY.format('x')}[1] <= {_top('g')} AND {_ARITY.format('g')}[1] <= {_top('x')})) > 0 OR coalesce({_ARITY.format('g')}[2] < 0 AND {_ceiling} IS NOT NULL, false) OR coalesce({_ARITY.format('g')}[2] > {_ceiling}, false))) > 0"

_ours = lambda s: f"coalesce(nullif({s}_a_status_windows, ''), {s}_a_windows_status, '')"
_rank = lambda s: f"coalesce(list_position(['test', 'experimental', 'stable'], {_ours(s)}), 0)"
_gone, _come, _both_there = _S["removed"], _S["added"], _S["modified"]
_case = lambda when, then: f"CASE WHEN {when} THEN {then} END"
_wired = _case(f"{_both_there} AND {_has('base_feature', 'depends_on')}", "'runtime_flag_rewired'")
_FLAG_SIGNALS = f"""list_filter([
  {_case(_gone, f"CASE {_ours('o')} WHEN 'stable' THEN 'killswitch_retired' ELSE 'experimental_dropped' END")},
  {_case(_come, f"CASE {_ours('n')} WHEN 'stable' THEN 'web_api_shipped' ELSE 'web_api_added' END")},
  {_case(f"{_both_there} AND {_rank('o')} <> {_rank('n')}", f"CASE WHEN {_rank('n')} = 3 THEN 'web_api_shipped' WHEN {_rank('o')} = 3 THEN 'web_api_unshipped' ELSE 'web_api_status_moved' END")},
  {_case(f"{_both_there} AND {_has('origin_trial_feature_name')}", "'origin_trial_change'")}, {_wired}], lambda x: x IS NOT NULL)"""
_SIGNALS = f"""CASE
 WHEN kind = 'base_feature' THEN [
  CASE WHEN {_gone} THEN CASE {_state('o')} WHEN 'enabled' THEN 'flag_retired_on' WHEN 'disabled' THEN 'flag_retired_off' ELSE 'feature_deleted' END END,
  CASE WHEN {_come} AND {_state('n')} = 'enabled' THEN 'new_feature_on_by_default' END,
  CASE WHEN {_both_there} AND {_state('o')} <> {_state('n')} THEN CASE {_state('n')} WHEN 'enabled' THEN 'enabled_by_default' WHEN 'disabled' THEN 'disabled_by_default' ELSE 'build_gate_changed' END END,
  CASE WHEN {_both_there} AND {_has('conditions')} THEN 'build_gate_changed' END,
  CASE WHEN {_both_there} AND o_a_var IS DISTINCT FROM n_a_var THEN 'feature_symbol_renamed' END,
  CASE WHEN {_both_there} AND o_a_default_state IS DISTINCT FROM n_a_default_state THEN CASE n_a_default_state WHEN 'enabled' THEN 'default_flip_on' WHEN 'disabled' THEN 'default_flip_off' END END]
 WHEN kind = 'blink_runtime_feature' THEN CASE WHEN len({_FLAG_SIGNALS}) = 0 AND {_has('status')} THEN ['runtime_flag_rewired'] ELSE {_FLAG_SIGNALS} END
 WHEN kind IN ('idl_member', 'idl_interface') THEN [
  CASE WHEN {_gone} THEN CASE WHEN reach = 'closed' THEN 'web_api_removed_gated' ELSE 'web_api_removed' END END,
  CASE WHEN {_come} THEN CASE reach WHEN 'closed' THEN 'web_api_added_gated' WHEN 'open' THEN 'web_api_added_live' ELSE 'web_api_added' END END,
  CASE WHEN {_both_there} AND NOT {_has('signatures')} AND {_has('signature', 'idl_kind', 'member_type')} THEN 'web_api_signature_change' END,
  CASE WHEN {_both_there} AND {_has('signatures')} AND len(list_filter(olds, lambda x: NOT list_contains(news, x))) > 0 THEN 'web_api_overload_removed' END,
  CASE WHEN {_both_there} AND {_has('signatures')} AND len(gained) > 0 THEN CASE WHEN {_shadow} THEN 'web_api_overload_shadowed' ELSE 'web_api_overload_added' END END,
  CASE WHEN {_both_there} AND {_has('inherits', 'values')} THEN 'web_api_shape_changed' END,
  CASE WHEN {_both_there} AND {_has('overload_traits', 'ext', 'runtime_enabled')} THEN 'web_api_exposure_changed' END]
 WHEN kind IN ('mojo_field', 'mojo_struct', 'mojo_enum') THEN [CASE WHEN {_gone} THEN 'ipc_removed' END, CASE WHEN {_has('values')} THEN 'ipc_enum_changed' END, CASE WHEN {_has('type', 'mojo_kind', 'position')} THEN 'ipc_shape_changed' WHEN {_has('default', 'attrs', 'min_version')} THEN 'ipc_field_annotated' END]
 WHEN kind IN ('mojo_method', 'mojo_interface') THEN [CASE WHEN {_gone} THEN 'ipc_removed' END, CASE WHEN {_has('signature')} THEN 'ipc_signature_change' WHEN {_has('ordinal', 'position')} THEN 'ipc_ordinal_changed' WHEN {_has('attrs')} THEN 'build_gate_changed' END]
 WHEN kind = 'feature_param' THEN [CASE WHEN {_gone} THEN 'param_removed' END, CASE WHEN {_has('default')} THEN 'param_default_changed' END, CASE WHEN {_has('var')} THEN 'feature_symbol_renamed' END, CASE WHEN {_has('type', 'feature')} THEN 'param_rewired' END]
 WHEN kind = 'webui_route' THEN [CASE WHEN {_gone} THEN 'ui_page_removed' END, CASE WHEN {_come} THEN 'ui_page_added' END, CASE WHEN {_has('guards')} THEN 'ui_page_regated' END, CASE WHEN {_has('route', 'parent')} THEN 'ui_page_moved' END]
 WHEN kind = 'webui_control' THEN [CASE WHEN {_gone} THEN 'ui_control_removed' END, CASE WHEN {_come} THEN 'ui_control_added' END, CASE WHEN {_has('control')} THEN 'ui_control_type_changed' END, CASE WHEN {_has('pref')} THEN 'ui_control_repointed' END, CASE WHEN {_has('build_conditions')} THEN 'build_gate_changed' END, CASE WHEN {_has('label')} THEN 'ui_control_relabelled' END]
 WHEN kind = 'webui_gate' THEN [CASE WHEN {_gone} THEN 'ui_gate_removed' END, CASE WHEN {_come} THEN 'ui_gate_added' END, CASE WHEN {_has('expression', 'features', 'enabled_checks')} THEN 'ui_gate_changed' END]
 WHEN kind IN ('pref', 'switch') THEN [CASE WHEN {_gone} THEN kind || '_left_scan' WHEN {_has('platform_state')} THEN 'build_gate_changed' WHEN {_has('var')} THEN kind || '_symbol_renamed' END]
 WHEN kind = 'flag_entry' THEN [CASE WHEN {_gone} THEN NULL WHEN CAST(n_a_expiry_milestone AS INT) > 0 AND CAST(n_a_expiry_milestone AS INT) <= 42 THEN 'flag_expiring' WHEN {_has('expiry_milestone')} THEN 'flag_expiry_moved' END]
 ELSE [] END"""

_place = lambda side: f"(CASE WHEN coalesce({side}_path, '') = '' THEN NULL WHEN {side}_line = 0 THEN {side}_path ELSE {side}_path || ':' || {side}_line END)"
_overload_places = lambda side: f"list_transform(coalesce(from_json({side}_places, '[\"VARCHAR\"]'), []), lambda x: string_split(x, ' @ ')[2])"
_NEW_SIDE = ", ".join(f"a.n_{c} AS n_{c}" for c in _SIDES if c != "name") + ", list_concat(p.both_paths, a.both_paths) AS both_paths, list_concat(p.spots, a.spots) AS spots"
_table = lambda m, names: _values(list(m.items()), names)
_PRIOR = [(k, t, n) for k, some in rules.PRIOR.items() for t, n in zip(("removed", "added", "modified"), some, strict=True)]
_LABEL = [(s, n, rules.SIGNAL_BUCKET[s]) for s, n in rules.SEVERITY.items()]

CHANGES = f"""{FACTS},
old_side AS (SELECT kind, key, {', '.join(f'{c} AS o_{c}' for c in _SIDES)} FROM facts WHERE snapshot_id = 'v1'),
new_side AS (SELECT kind, key, {', '.join(f'{c} AS n_{c}' for c in _SIDES)} FROM facts WHERE snapshot_id = 'v2'),
joined AS (SELECT *, CASE WHEN o_path IS NULL THEN 'added' WHEN n_path IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM old_side FULL OUTER JOIN new_side USING (kind, key)),
moved AS (SELECT *, CASE WHEN change_type = 'modified' THEN list_sort(list_filter([{', '.join(_DELTAS)}], lambda x: x IS NOT NULL)) ELSE [] END AS deltas, CASE WHEN change_type = 'modified' THEN list_sort(list_filter([{', '.join(_VALUES)}], lambda x: x IS NOT NULL)) ELSE [] END AS moves FROM joined),
gated AS (SELECT m.*, CASE change_type WHEN 'added' THEN 'v2' ELSE 'v1' END AS side, CASE WHEN kind = 'idl_interface' THEN coalesce(n_a_ext_gate, CASE WHEN n_path IS NULL THEN o_a_ext_gate END) ELSE coalesce(n_a_runtime_enabled, CASE WHEN n_path IS NULL THEN o_a_runtime_enabled END) END AS gate1, CASE WHEN kind = 'idl_member' THEN coalesce(n_a_interface, o_a_interface) END AS iface FROM moved m WHERE change_type <> 'modified' OR len(deltas) > 0),
flags AS (SELECT snapshot_id, key, coalesce(nullif(a_status_windows, ''), a_windows_status, '') AS st FROM facts WHERE kind = 'blink_runtime_feature'),
walls AS (SELECT snapshot_id, key, a_ext_gate AS g FROM facts WHERE kind = 'idl_interface' AND a_ext_gate IS NOT NULL),
reached AS (SELECT g.*, w.g AS gate2, CASE WHEN gate1 IS NOT NULL AND f1.st IS NULL THEN 'unknown' WHEN gate1 IS NOT NULL AND f1.st <> 'stable' THEN 'closed' WHEN w.g IS NOT NULL AND f2.st IS NULL THEN 'unknown' WHEN w.g IS NOT NULL AND f2.st <> 'stable' THEN 'closed' ELSE 'open' END AS reach, {_list('o')} AS olds, {_list('n')} AS news
 FROM gated g LEFT JOIN walls w ON w.snapshot_id = g.side AND w.key = g.iface LEFT JOIN flags f1 ON f1.snapshot_id = g.side AND f1.key = g.gate1 LEFT JOIN flags f2 ON f2.snapshot_id = g.side AND f2.key = w.g),
gains AS (SELECT *, list_filter(news, lambda x: NOT list_contains(olds, x)) AS gained FROM reached),
first AS (SELECT *, list_filter(list_concat({_SIGNALS}, [CASE WHEN {_has('path')} THEN 'declaration_moved' END]), lambda x: x IS NOT NULL) AS s1 FROM gains),
plain AS MATERIALIZED (SELECT * EXCLUDE (s1), CASE WHEN len(s1) = 0 AND {_has('platform_state')} THEN ['build_gate_changed'] WHEN len(s1) = 0 AND {_has('stable')} THEN ['ipc_stability_changed'] ELSE s1 END AS signals FROM first),
vars AS (SELECT kind, key, change_type, CASE change_type WHEN 'added' THEN n_a_var ELSE o_a_var END AS anchor FROM plain WHERE kind IN ('pref', 'switch', 'base_feature') AND change_type <> 'modified'),
renames AS (SELECT r.kind, r.key, a.key AS new_key FROM vars r JOIN vars a ON r.kind = a.kind AND r.anchor = a.anchor AND r.change_type = 'removed' AND a.change_type = 'added'
 WHERE (r.kind, r.anchor) IN (SELECT (kind, anchor) FROM vars GROUP BY kind, anchor HAVING count(*) FILTER (change_type = 'added') = 1 AND count(*) FILTER (change_type = 'removed') = 1)),
spots AS (SELECT kind, key, change_type, CASE change_type WHEN 'added' THEN concat(n_a_surface, '|', n_a_page, '|', n_a_label) ELSE concat(o_a_surface, '|', o_a_page, '|', o_a_label) END AS anchor, coalesce(n_a_pref, o_a_pref) AS pref, coalesce(n_a_control, o_a_control) AS control FROM plain WHERE kind = 'webui_control' AND change_type <> 'modified'),
repoints AS (SELECT r.kind, r.key, a.key AS new_key, r.control <> a.control AS retyped FROM spots r JOIN spots a ON r.anchor = a.anchor AND r.change_type = 'removed' AND a.change_type = 'added' AND r.pref <> a.pref
 WHERE r.anchor IN (SELECT anchor FROM spots GROUP BY anchor HAVING count(*) FILTER (change_type = 'added') = 1 AND count(*) FILTER (change_type = 'removed') = 1)),
pairs_found AS (SELECT kind, key, new_key FROM renames UNION ALL SELECT kind, key, new_key FROM repoints),
used AS (SELECT kind, key FROM pairs_found UNION ALL SELECT kind, new_key FROM pairs_found),
placed AS MATERIALIZED (SELECT *, list_filter([o_path, n_path], lambda x: coalesce(x, '') <> '') AS both_paths, list_filter(list_concat([{_place('o')}, {_place('n')}], {_overload_places('n')}, {_overload_places('o')}), lambda x: x IS NOT NULL) AS spots FROM plain),
merged AS (SELECT p.* REPLACE ('modified' AS change_type, ['value'] AS deltas, ['value: ' || p.key || ' > ' || a.key] AS moves, [CASE p.kind WHEN 'pref' THEN 'pref_renamed' WHEN 'switch' THEN 'switch_renamed' ELSE 'feature_string_renamed' END] AS signals, {_NEW_SIDE}, p.key || ' -> ' || a.key AS n_name) FROM placed p JOIN renames r ON r.kind = p.kind AND r.key = p.key AND p.change_type = 'removed' JOIN placed a ON a.kind = r.kind AND a.key = r.new_key
 UNION ALL SELECT p.* REPLACE ('modified' AS change_type, CASE WHEN retyped THEN ['control', 'pref'] ELSE ['pref'] END AS deltas, list_filter([CASE WHEN retyped THEN 'control: ' || {json_text('control', 'p.o_a_control')} || ' > ' || {json_text('control', 'a.n_a_control')} END, 'pref: ' || {json_text('pref', 'p.o_a_pref')} || ' > ' || {json_text('pref', 'a.n_a_pref')}], lambda x: x IS NOT NULL) AS moves, CASE WHEN retyped THEN ['ui_control_repointed', 'ui_control_type_changed'] ELSE ['ui_control_repointed'] END AS signals, {_NEW_SIDE}, p.o_name || ' -> ' || a.n_name AS n_name) FROM placed p JOIN repoints r ON r.kind = p.kind AND r.key = p.key AND p.change_type = 'removed' JOIN placed a ON a.kind = r.kind AND a.key = r.new_key),
every_change AS MATERIALIZED (SELECT * FROM placed p WHERE (kind, key) NOT IN (SELECT (kind, key) FROM used) UNION ALL SELECT * FROM merged),
ranked AS (SELECT c.*, l.s, l.n AS lead_n, l.b FROM every_change c LEFT JOIN LATERAL (SELECT t.s, t.n, t.b FROM {_values(_LABEL, 's, n, b')} t WHERE list_contains(c.signals, t.s) ORDER BY t.n DESC, t.s DESC LIMIT 1) l ON true),
changes AS MATERIALIZED (SELECT 'v1-v2' AS pair_id, r.*, coalesce(n_name, o_name) AS name, coalesce(r.s, '') AS lead, coalesce(r.lead_n, p.n, 20) AS severity, coalesce(r.b, CASE r.change_type WHEN 'added' THEN 'new' WHEN 'removed' THEN 'housekeeping' ELSE 'behaviour' END) AS bucket0,
 CASE WHEN r.s IN ({', '.join(repr(s) for s in rules.CONFIG_SIGNALS)}) THEN 'config' ELSE coalesce(w.o, 'native') END AS owner, coalesce(g.g, '') AS grp,
 (o_path IS NULL OR coalesce(o_a_windows, '') = 'not_compiled') AND (n_path IS NULL OR coalesce(n_a_windows, '') = 'not_compiled') AS outside
 FROM ranked r LEFT JOIN {_values(_PRIOR, 'k, t, n')} p ON p.k = r.kind AND p.t = r.change_type LEFT JOIN {_table(rules.by_member(rules.KIND_OWNER), 'k, o')} w ON w.k = r.kind LEFT JOIN {_table(rules.by_member(rules.GROUPS), 'k, g')} g ON g.k = r.kind)"""

_FOLDERS = "(testing|test|tests|out|\\.git|__pycache__|fuzzers|fuzzer|web_test|web_tests|mock)"
_SKIP = (
    f"CASE WHEN regexp_matches(path, '(^|/){_FOLDERS}/') THEN 'folder ' || regexp_extract(path, '(?:^|/){_FOLDERS}/', 1)"
    " WHEN regexp_matches(path, '(_test|_tests|_unittest|_browsertest|_perftest|_test_api|_test_service|_test_util|_test_utils|_fuzzer|_mock)\\.[A-Za-z0-9]+$|(^|/)(fuzz|mock)\\.[A-Za-z0-9]+$') THEN 'test file'"
    " WHEN regexp_matches(path, '^(content/shell/|chrome/test/|tools/|headless/|remoting/|chrome/(updater|enterprise_companion|windows_services)/)') THEN 'other program'"
    " WHEN (starts_with(path, 'third_party/') AND NOT starts_with(path, 'third_party/blink/')) OR regexp_matches(path, '/third_party/(abseil|grpc|ipcz|libxml|opus|tflite|zlib|webrtc_overrides)/') THEN 'vendored' ELSE '' END"
)
#: Surface, extractor and file rule, written out apart from the library's own. ``base`` is the file's name.
_ROUTES = (
    ("feature flags", "base_features", r"regexp_matches(base, '\.(cc|h)$') AND regexp_matches(base, '(features|switches|fieldtrial|field_trial|flags|feature_list)\.(cc|h)|_(util|handler|manager)\.cc') AND NOT regexp_matches(base, '_(unittest|browsertest|test|testing|test_util|test_helper)\.|test_util\.')"),
    ("web platform flags", "blink_runtime", "base = 'runtime_enabled_features.json5'"),
    ("web API definitions", "web_idl", "path LIKE 'third\\_party/blink/renderer/%.idl' ESCAPE '\\'"),
    ("process-boundary interfaces", "mojom", "path LIKE '%.mojom'"),
    ("preference keys and switches", "constants", r"regexp_matches(base, '\.(cc|h)$') AND regexp_matches(base, 'switches\.|pref_names[._]|prefs\.')"),
    ("chrome://flags entries", "flags_metadata", "base = 'flag-metadata.json'"),
    ("chrome:// routes", "webui_routes", "path LIKE 'chrome/browser/resources/%' AND base IN ('route.ts', 'routes.ts')"),
    ("chrome:// controls", "webui_controls", "path LIKE 'chrome/browser/resources/%' AND (path LIKE '%.html' OR path LIKE '%.html.ts')"),
    ("chrome:// visibility gates", "webui_gates", "path LIKE 'chrome/browser/ui/webui/%.cc'"),
)


def _listing() -> str:
    cases = [f"CASE WHEN {rule} THEN '{name}' END" for _, name, rule in _ROUTES]
    surfaces = _values([(name, surface) for surface, name, _ in _ROUTES], "x, surface")
    return f"""WITH listing AS ({duckdb_sql(LISTING)}),
based AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM listing),
named AS (SELECT * EXCLUDE (base), list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS found FROM based),
routed AS (SELECT * EXCLUDE (found), CASE WHEN regexp_matches(path, '(^|/)(chromeos|ash|ios|fuchsia)(/|$)') THEN list_filter(found, lambda x: x = 'constants') ELSE found END AS extractors FROM named),
candidates AS MATERIALIZED (SELECT *, (path LIKE 'chrome/browser/%') OR (path LIKE 'services/%' AND path LIKE '%.mojom') OR (path LIKE 'third\\_party/blink/%' ESCAPE '\\' AND (path LIKE '%.idl' OR path LIKE '%.cc')) OR path = 'components/prefs/android/pref_names.cc' OR path LIKE 'content/public/%' AS read FROM routed WHERE {_SKIP} = '' AND len(extractors) > 0 AND NOT {_ELSEWHERE}),
by_surface AS MATERIALIZED (SELECT DISTINCT c.snapshot_id, c.path, c.read, s.surface FROM (SELECT *, unnest(extractors) AS x FROM candidates) c JOIN {surfaces} s USING (x)),
coverage AS MATERIALIZED (SELECT snapshot_id, surface, count(*) AS candidates, count(*) FILTER (read) AS read FROM by_surface GROUP BY ALL UNION ALL SELECT snapshot_id, NULL, count(*), count(*) FILTER (read) FROM candidates GROUP BY ALL)"""


LISTED = _listing()
FINDINGS = f"""{CHANGES}, {LISTED.removeprefix('WITH ')},
held AS (SELECT c.*, CASE WHEN list_contains(c.deltas, 'signatures') THEN CASE WHEN len(list_filter(CASE WHEN o_signatures IS NULL THEN [] ELSE olds END, lambda x: NOT list_contains(CASE WHEN n_signatures IS NULL THEN [] ELSE news END, x))) > 0 THEN 'removed' ELSE 'added' END ELSE change_type END AS direction, s.u AS surface FROM changes c LEFT JOIN {_table(rules.by_member(rules.SURFACES), 'k, u')} s ON s.k = c.kind),
shared AS (SELECT h.*, CASE WHEN v.snapshot_id IS NOT NULL THEN least(1.0, CAST(v.read AS DOUBLE) / v.candidates) ELSE CAST(a.read AS DOUBLE) / a.candidates END AS part FROM held h
 LEFT JOIN coverage v ON v.snapshot_id = CASE WHEN h.direction = 'added' THEN 'v1' ELSE 'v2' END AND v.surface = h.surface LEFT JOIN coverage a ON a.snapshot_id = CASE WHEN h.direction = 'added' THEN 'v1' ELSE 'v2' END AND a.surface IS NULL),
doubted AS (SELECT *, direction = 'removed' AND NOT outside AS doubtful FROM shared),
findings AS MATERIALIZED (SELECT *, CASE WHEN outside THEN 0 ELSE greatest(0, least(100, severity - CASE WHEN doubtful THEN {rules.PENALTY} ELSE 0 END)) END AS score, CASE WHEN outside OR (doubtful AND lead IN ('pref_left_scan', 'switch_left_scan')) THEN 'housekeeping' ELSE bucket0 END AS bucket FROM doubted)"""
_DIRECTIONS = ", ".join(f"count(*) FILTER (change_type = '{t}') AS n_{t}" for t in ("added", "removed", "modified"))

_text = lambda c: f"coalesce(nullif(n_a_{c}, ''), '')"
_side = lambda c: f"coalesce(CASE WHEN n_path IS NOT NULL THEN n_a_{c} ELSE o_a_{c} END, '')"
_STATE_ROWS = (("enabled", "on"), ("disabled", "off"), ("not_compiled", "not in our build"), ("conditional", "conditional"), ("", "not enabled"))
_word = lambda x: f"(CASE coalesce({x}, '') {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _STATE_ROWS)} ELSE {x} END)"
_plain_move = lambda c: f"CASE WHEN {_has(attribute(c))} THEN {_word('o_a_' + c)} || ' → ' || {_word('n_a_' + c)} END"
_here_move = lambda c: f"CASE WHEN {_has(attribute(c))} AND {_held('o', c)} IS NOT NULL AND {_held('n', c)} IS NOT NULL AND o_a_{c} IS DISTINCT FROM n_a_{c} THEN {_word('o_a_' + c)} || ' → ' || {_word('n_a_' + c)} || ' for Windows' END"
_CONTROL = lambda x: f"(CASE WHEN {x} LIKE '%toggle%' THEN 'toggle' WHEN {x} LIKE '%dropdown%' THEN 'dropdown' WHEN {x} LIKE '%link-row%' THEN 'link row' ELSE {x} END)"
_paren = lambda before, x, after=")": f"CASE WHEN {x} <> '' THEN '{before}' || {x} || '{after}' ELSE '' END"
_WORDS = f"""CASE kind
 WHEN 'webui_control' THEN CASE WHEN {_has('control')} THEN {_CONTROL('o_a_control')} || ' → ' || {_CONTROL('n_a_control')} ELSE {_CONTROL(_side('control'))} END || {_paren(' — ', f"coalesce(nullif({_side('label')}, ''), name)", '')} || {_paren(' (writes ', _side('pref'))}
 WHEN 'webui_route' THEN 'page ' || {_side('route')} || {_paren(' (shown when ', _side('guard'))}
 WHEN 'webui_gate' THEN 'visibility switch ' || name || {_paren(' (from ', _side('gate_feature'))}
 WHEN 'base_feature' THEN 'feature flag ' || name || coalesce(' — ' || coalesce({_here_move('windows')}, {_plain_move('default_state')}), CASE WHEN change_type = 'added' AND n_a_windows IS NOT NULL THEN ' — arrives ' || {_word('n_a_windows')} || ' for Windows' END, '')
 WHEN 'feature_param' THEN 'flag setting ' || name || {_paren(' of ', _side('feature'), '')} || coalesce(' — ' || {_plain_move('default')}, '')
 WHEN 'blink_runtime_feature' THEN 'web API flag ' || name || coalesce(' — ' || coalesce({_here_move('status_windows')}, {_plain_move('status')}), CASE WHEN change_type = 'added' AND coalesce(nullif(n_a_windows_status, ''), n_a_status, '') <> '' THEN ' — arrives ' || {_word("coalesce(nullif(n_a_windows_status, ''), n_a_status)")} END, '')
 WHEN 'idl_interface' THEN 'web API ' || coalesce(nullif({_side('idl_kind')}, ''), 'interface') || ' ' || name
 WHEN 'idl_member' THEN 'web API ' || coalesce(nullif({_side('member_type')}, ''), 'member') || ' ' || key || {_paren(' (behind ', _side('runtime_enabled'))}
 WHEN 'mojo_interface' THEN 'process interface ' || key || CASE WHEN {_side('method_count')} NOT IN ('', '0') THEN ' (' || {_side('method_count')} || ' calls)' ELSE '' END
 WHEN 'mojo_method' THEN 'process call ' || key || '()'
 WHEN 'mojo_struct' THEN 'process message ' || key || coalesce(' — ' || {_plain_move('mojo_kind')}, CASE WHEN {_side('field_count')} NOT IN ('', '0') THEN ' (' || {_side('field_count')} || ' fields)' END, '')
 WHEN 'mojo_field' THEN 'message field ' || key || coalesce(' — ' || {_plain_move('type')}, {_paren(' (', _side('type'))})
 WHEN 'mojo_enum' THEN 'message enum ' || key || CASE WHEN {_side('value')} <> '' THEN ' (2 values)' ELSE '' END
 WHEN 'switch' THEN 'command-line switch --' || name
 WHEN 'pref' THEN 'user setting ' || name
 WHEN 'flag_entry' THEN 'chrome://flags entry #' || name || coalesce(' — removal ' || {_plain_move('expiry_milestone')}, CASE WHEN {_side('expiry_milestone')} NOT IN ('', '0') THEN ' (removal M' || {_side('expiry_milestone')} || ')' END, '')
 ELSE name END"""
_one_of = lambda c: f"coalesce(nullif(o_a_{c}, ''), nullif(n_a_{c}, ''))"
_SCREEN = f"""CASE kind WHEN 'webui_control' THEN CASE WHEN {_one_of('surface')} IS NULL THEN string_split(key, '/')[1] || ' › ' || string_split(key, '/')[2] ELSE {_one_of('surface')} || ' › ' || CASE WHEN o_a_surface IS NOT NULL THEN o_a_page ELSE n_a_page END END
 WHEN 'webui_route' THEN coalesce({_one_of('surface')}, 'settings') WHEN 'webui_gate' THEN regexp_replace({_one_of('handler')}, '(_ui|_util|_handler|_manager|_localized_strings_provider)$', '') END"""
_PATHS = "list_sort(list_distinct(both_paths))"
_SPOTS = "list_filter(spots, lambda x, i: list_position(spots, x) = i)"
_WHERE = f"CASE WHEN kind LIKE 'webui%' THEN ({_SCREEN}) ELSE regexp_replace(coalesce({_PATHS}[1], ''), '/[^/]*$', '') END"
_HEADLINE = "CASE WHEN lead <> '' THEN replace(lead, '_', ' ') ELSE change_type || ' ' || replace(kind, '_', ' ') END"
_REASONS = f"""list_filter(['severity ' || severity || ': ' || {_HEADLINE}, CASE WHEN outside THEN '0: not compiled for our platform on either side' END,
 CASE WHEN doubtful THEN '-15 unconfirmed: 1 absent target(s) and 2 unreadable file(s)' || CASE WHEN lead IN ('pref_left_scan', 'switch_left_scan') THEN '; filed as housekeeping' ELSE '' END END], lambda x: x IS NOT NULL)"""
_TOLD = f"told AS MATERIALIZED (SELECT *, {_WORDS} AS what, {_WHERE} AS spot, {_SCREEN} AS screen, {_REASONS} AS reasons FROM findings)"
TOLD = f"{FINDINGS}, {_TOLD}"
_UP = "CASE change_type WHEN 'added' THEN 0 WHEN 'modified' THEN 1 ELSE 2 END"
_SCREENS = f"screens AS (SELECT screen, count(*) AS n, {_DIRECTIONS}, CAST(max(score) AS INT) AS score FROM told WHERE screen IS NOT NULL GROUP BY screen)"
_STORIES = f"stories AS (SELECT grp AS consequence, CASE WHEN lead <> '' THEN lead ELSE change_type || ':' || kind END AS story, count(*) AS n, {_DIRECTIONS}, CAST(max(severity) AS INT) AS severity, CAST(max(score) AS INT) AS score FROM findings GROUP BY ALL)"
_cut = lambda x: f"(CASE WHEN length({x}) > 90 THEN substr({x}, 1, 89) || '…' ELSE coalesce({x}, '-') END)"
_trimmed = lambda x: f"(CASE WHEN length({x}) <= 52 THEN {x} ELSE '…/' || (SELECT list_aggregate(list_slice(string_split({x}, '/'), k, -1), 'string_agg', '/') FROM range(1, 30) t(k) WHERE k <= len(string_split({x}, '/')) AND (k = len(string_split({x}, '/')) OR length(list_aggregate(list_slice(string_split({x}, '/'), k, -1), 'string_agg', '/')) + 2 <= 52) ORDER BY k LIMIT 1) END)"
_flat_value = lambda c: _delta(c, (f"'{_attr(c)}'" if c not in ("windows", "status_windows") else f"'{_attr(c)} [windows]'") + f" || ': ' || " + (f"coalesce({_held('o', c)}, '?') || ' -> ' || coalesce({_held('n', c)}, '?')" if c in ("windows", "status_windows") else f"{_cut(_as_json('o', c))} || ' -> ' || {_cut(_as_json('n', c))}"))
_EDGES = """keys AS (SELECT kind, key, kind || ':' || key AS node, coalesce(n_name, o_name) AS name, score, o_a_data_key, n_a_data_key, o_a_guard, n_a_guard, o_a_gate_feature, n_a_gate_feature, o_a_base_feature, n_a_base_feature, o_a_feature, n_a_feature, o_a_label, n_a_label FROM findings),
routes AS (SELECT node, t FROM (SELECT node, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS t, row_number() OVER (PARTITION BY lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) ORDER BY score DESC, kind, key) AS n FROM keys WHERE kind = 'webui_route') WHERE n = 1),
both_sides AS (SELECT node, kind, key, unnest([o_a_guard, n_a_guard]) AS guard, unnest([o_a_gate_feature, n_a_gate_feature]) AS gate_feature, unnest([o_a_base_feature, n_a_base_feature]) AS base_feature, unnest([o_a_feature, n_a_feature]) AS feature, unnest([o_a_label, n_a_label]) AS label FROM keys),
edges AS MATERIALIZED (SELECT DISTINCT a, b FROM (
 SELECT s.node AS a, k.node AS b FROM both_sides s JOIN keys k ON k.kind = 'webui_gate' AND coalesce(k.o_a_data_key, k.n_a_data_key) = s.guard WHERE s.kind = 'webui_route'
 UNION ALL SELECT s.node, k.node FROM both_sides s JOIN keys k ON k.kind = 'base_feature' AND k.key = regexp_replace(s.gate_feature, '^k', '') WHERE s.kind = 'webui_gate'
 UNION ALL SELECT s.node, k.node FROM both_sides s JOIN keys k ON k.kind = 'base_feature' AND (k.key = regexp_replace(s.base_feature, '^kF', 'F') OR k.key = s.key) WHERE s.kind = 'blink_runtime_feature'
 UNION ALL SELECT s.node, k.node FROM both_sides s JOIN keys k ON k.kind = 'base_feature' AND k.key = s.feature WHERE s.kind = 'feature_param'
 UNION ALL SELECT s.node, r.node FROM both_sides s JOIN routes r ON r.t = lower(regexp_replace(s.label, '[^A-Za-z0-9]', '', 'g')) WHERE s.kind = 'webui_control') WHERE a <> b)"""
_GROUPED = f"""{_EDGES},
ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT DISTINCT a AS node, a AS seen FROM ways UNION SELECT w.node, e.b FROM walk w JOIN ways e ON e.a = w.seen),
members AS MATERIALIZED (SELECT node, min(seen) AS cluster FROM walk GROUP BY node),
clustered AS MATERIALIZED (SELECT m.cluster, m.node, f.kind, f.key, f.score, f.bucket, coalesce(f.n_name, f.o_name) AS name FROM members m JOIN findings f ON f.kind || ':' || f.key = m.node),
clusters AS MATERIALIZED (SELECT cluster, first(name ORDER BY score DESC, kind, key) AS label, count(*) AS size, CAST(max(score) AS INT) AS top_score, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, array_to_string(list_sort(list_distinct(list(bucket))), ',') AS buckets, string_agg(node, ',' ORDER BY score DESC, kind, key) AS members FROM clustered GROUP BY cluster)"""
_recursive = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)
_line = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_short = lambda x, n: f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, {n}), '\\s+\\S*$', '') || '...' END)"
_BRIEFED = f"briefs AS MATERIALIZED (SELECT *, {_short(_line('summary'), 600)} AS short FROM ({duckdb_sql(BRIEFS)}))"
_norm = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_REFS = "refs AS (SELECT f.snapshot_id, 'page guard' AS link, f.key AS source_key, f.a_guard AS target FROM facts f WHERE kind = 'webui_route' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.snapshot_id = f.snapshot_id AND g.kind = 'webui_gate' AND g.a_data_key = f.a_guard) UNION SELECT f.snapshot_id, 'gate feature', f.key, substr(f.a_gate_feature, 2) FROM facts f WHERE kind = 'webui_gate' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.snapshot_id = f.snapshot_id AND g.kind = 'base_feature' AND g.key = substr(f.a_gate_feature, 2)) UNION SELECT f.snapshot_id, 'control preference', f.key, f.a_pref FROM facts f WHERE kind = 'webui_control' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.snapshot_id = f.snapshot_id AND g.kind = 'pref' AND g.key = f.a_pref) UNION SELECT f.snapshot_id, 'runtime flag feature', f.key, substr(f.a_base_feature, 2) FROM facts f WHERE kind = 'blink_runtime_feature' AND a_base_feature <> 'none' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.snapshot_id = f.snapshot_id AND g.kind = 'base_feature' AND g.key = substr(f.a_base_feature, 2)) UNION SELECT f.snapshot_id, 'parameter feature', f.key, f.a_feature FROM facts f WHERE kind = 'feature_param' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.snapshot_id = f.snapshot_id AND g.kind = 'base_feature' AND g.key = f.a_feature))"
_CLOSURE = "closure AS (SELECT snapshot_id, link, count(*) AS n_references, array_to_string(list_slice(list_sort(list_distinct(list(target))), 1, 8), ', ') AS names, greatest(count(DISTINCT target) - 8, 0) AS more FROM refs GROUP BY ALL)"
_IN_SCOPE = "(path LIKE 'chrome/browser/%' OR (path LIKE 'services/%' AND path LIKE '%.mojom') OR (path LIKE 'third\\_party/blink/%' ESCAPE '\\' AND (path LIKE '%.idl' OR path LIKE '%.cc')) OR path = 'components/prefs/android/pref_names.cc' OR path LIKE 'content/public/%')"
_VIOLATIONS = f"violations AS (SELECT snapshot_id, CASE WHEN regexp_extract(path, '[^/]*$') LIKE '%.%' THEN regexp_extract(regexp_extract(path, '[^/]*$'), '^[^.]*(\\..*)$', 1) ELSE '(none)' END AS suffix, count(*) AS n_files FROM (SELECT DISTINCT snapshot_id, path FROM facts WHERE NOT {_IN_SCOPE}) GROUP BY ALL)"
_BY_DIRECTORY = "by_directory AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY missed DESC, p) AS place FROM (SELECT snapshot_id, array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS directory, count(*) AS missed, min(path) AS p FROM candidates WHERE NOT read GROUP BY ALL))"
_MISSED = "missed AS (SELECT snapshot_id, path, row_number() OVER (PARTITION BY snapshot_id ORDER BY path) AS place, count(*) OVER (PARTITION BY snapshot_id) AS n_missed FROM candidates WHERE NOT read)"
_SHARED = "shared_files AS (SELECT snapshot_id, count(*) AS n_files FROM (SELECT snapshot_id, path FROM by_surface GROUP BY ALL HAVING count(*) > 1) GROUP BY snapshot_id)"
_SUMMARY = f"""summary AS (SELECT what, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'bucket' AS what, bucket AS value, count(*) AS n FROM findings GROUP BY bucket UNION ALL SELECT 'owner', owner, count(*) FROM findings GROUP BY owner UNION ALL SELECT 'group', grp, count(*) FROM findings GROUP BY grp UNION ALL SELECT 'signal', lead, count(*) FROM findings WHERE lead <> '' GROUP BY lead UNION ALL SELECT 'total', '', count(*) FROM findings UNION ALL SELECT 'not_in_build', '', count(*) FILTER (outside) FROM findings
 UNION ALL SELECT * FROM {_values([('bucket', b, 0) for b in ('breaking', 'behaviour', 'new', 'housekeeping')] + [('owner', o, 0) for o in ('ipc', 'webplatform', 'native', 'webui', 'config')], 'what, value, n')}) GROUP BY what, value)"""
_top = lambda by, n, where="true": f"SELECT '{by}' AS by, * FROM (SELECT {by} AS value, kind, key, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, kind, key) AS place, greatest(count(*) OVER (PARTITION BY {by}) - {n}, 0) AS remaining FROM findings WHERE {where}) WHERE place <= {n}"
_TOPS = f"by_owner AS ({_top('owner', 8, chr(98) + 'ucket <> ' + repr('housekeeping'))}), by_bucket AS ({_top('bucket', 40)})"
_rows = lambda *names: " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {t}" for n, t in names)

SQL: dict[str, str] = {
    "dedupe_facts": f"{FACTS} SELECT snapshot_id, kind, key, name, path, line, coalesce(a_windows, '') AS state, coalesce(signatures, '') AS signatures, coalesce(traits, '') AS traits, coalesce(places, '') AS places FROM facts",
    "keep_lowest": f"{FACTS} SELECT snapshot_id, kind, key, path, line FROM best",
    "overload_sets": f"{FACTS} SELECT snapshot_id, key, signatures, coalesce(traits, '') AS traits FROM facts WHERE signatures IS NOT NULL",
    "count_by_kind": f"{FACTS} SELECT snapshot_id, kind, count(*) AS n_facts FROM facts GROUP BY ALL",
    "stamp_platform_dirs": f"{FACTS} SELECT snapshot_id, kind, coalesce(a_windows, '') AS state, count(*) AS n_rows FROM stamped GROUP BY ALL",
    "interface_shape": f"{FACTS} SELECT snapshot_id, kind, CASE kind WHEN 'mojo_method' THEN a_interface ELSE a_struct END AS owner, count(*) AS n_members, array_to_string(list_sort(list(name)), ',') AS members FROM facts WHERE kind IN ('mojo_method', 'mojo_field') GROUP BY ALL",
    "meaningful_attrs": f"{FACTS} SELECT snapshot_id, kind, key, array_to_string(list_sort(list_filter([{', '.join('CASE WHEN kind IN (' + ', '.join(repr(k) for k, cs in COMPARED.items() if c in cs) + ') AND ' + (c if c in _SET_COLUMNS else 'nullif(a_windows, ' + repr('compiled') + ')' if c == 'windows' else 'a_' + c) + ' IS NOT NULL THEN ' + repr(_attr(c)) + ' END' for c in _compared)}], lambda x: x IS NOT NULL)), ',') AS names FROM facts",
    "member_position": "SELECT declaration, member, CASE WHEN stable THEN place END AS position FROM (SELECT *, row_number() OVER (PARTITION BY declaration ORDER BY l_partkey) - 1 AS place FROM (SELECT DISTINCT l_orderkey AS declaration, l_partkey, 'f' || l_partkey AS member, l_orderkey % 3 = 0 AS stable FROM lineitem))",
    "occurrence_index": "SELECT path, \"offset\", tag || '#' || (row_number() OVER (PARTITION BY path, tag ORDER BY \"offset\") - 1) AS identity FROM (SELECT DISTINCT 'p' || l_orderkey % 500 AS path, 'tag-' || l_suppkey % 7 AS tag, l_orderkey * 100000 + l_partkey AS \"offset\" FROM lineitem WHERE l_partkey % 5 <> 0)",
    "diff_snapshots": f"{CHANGES} SELECT kind, key, change_type, array_to_string(moves, '; ') AS deltas FROM plain",
    "change_places": f"{CHANGES} SELECT kind, key, name, array_to_string({_PATHS}, ',') AS paths, array_to_string({_SPOTS}, ',') AS places FROM changes",
    "change_signals": f"{CHANGES} SELECT kind, key, change_type, array_to_string(list_sort(list_distinct(signals)), ',') AS signals, lead, CAST(severity AS INT) AS severity, bucket0 AS bucket, owner, grp AS consequence FROM changes",
    "detect_renames": f"{CHANGES} SELECT kind, key, key || ' -> ' || new_key AS name FROM renames",
    "detect_repoints": f"{CHANGES} SELECT kind, key, list_contains(signals, 'ui_control_type_changed') AS retyped, array_to_string(moves, '; ') AS deltas FROM changes WHERE kind = 'webui_control' AND name LIKE '% -> %'",
    "change_summary": f"{CHANGES} SELECT kind, {_DIRECTIONS} FROM changes GROUP BY kind",
    "rank_changes": f"{CHANGES} SELECT kind, key, row_number() OVER (ORDER BY severity DESC, kind, key) AS place FROM changes",
    "resolve_gates": f"{CHANGES} SELECT kind, key, change_type, CASE reach WHEN 'open' THEN 'true' WHEN 'closed' THEN 'false' ELSE 'unknown' END AS reachable FROM reached WHERE kind IN ('idl_member', 'idl_interface') AND change_type <> 'modified'",
    "comparable_pairs": f"{FACTS}, n AS (SELECT count(*) FILTER (snapshot_id = 'v1') AS a, count(*) FILTER (snapshot_id = 'v2') AS b, count(*) FILTER (snapshot_id = 'v2' AND kind IN ('mojo_enum', 'pref')) AS c FROM facts), p AS (SELECT 'v1-v2' AS pair_id, '' AS reason, a AS from_facts, b AS to_facts, '1 absent target(s) and 2 unreadable file(s)' AS gap FROM n UNION ALL SELECT 'v1-v3', 'built from different target sets', a, 0, '' FROM n UNION ALL SELECT 'v1-v4', '', a, c, '2 absent target(s)' FROM n UNION ALL SELECT 'v1-v9', 'built from different target sets', a, 0, '' FROM n) SELECT pair_id, reason, CASE WHEN greatest(from_facts, to_facts) < 500 THEN '' WHEN least(from_facts, to_facts) = 0 THEN 'one side is empty' WHEN least(from_facts, to_facts) < 0.5 * greatest(from_facts, to_facts) THEN 'one side is less than half of the other' ELSE '' END AS lopsided, from_facts, to_facts, gap FROM p",
    "score_changes": f"{TOLD} SELECT kind, key, CAST(score AS INT) AS score, bucket, owner, outside, array_to_string(reasons, '; ') AS reasons FROM told",
    "rank_findings": f"{FINDINGS} SELECT kind, key, row_number() OVER (ORDER BY score DESC, kind, key) AS place FROM findings",
    "finding_summary": f"{FINDINGS}, {_SUMMARY} SELECT * FROM summary",
    "owner_bucket_matrix": f"{FINDINGS} SELECT owner, {', '.join(f'count(*) FILTER (bucket = {b!r}) AS {b}' for b in ('breaking', 'behaviour', 'new', 'housekeeping'))}, count(*) AS total FROM findings GROUP BY owner",
    "measured_figures": f"{FINDINGS} SELECT owner, count(*) FILTER (bucket = 'breaking') AS breaking, count(*) FILTER (lead = '') AS no_signal FROM findings GROUP BY owner",
    "stories": f"{FINDINGS}, {_STORIES} SELECT *, row_number() OVER (ORDER BY severity DESC, n DESC, story, consequence) AS place FROM stories",
    "screens": f"{TOLD}, {_SCREENS} SELECT *, row_number() OVER (ORDER BY n DESC, score DESC, screen) AS place FROM screens",
    "screen_totals": f"{TOLD}, {_SCREENS} SELECT count(*) AS n_screens, CAST(sum(n_added) AS BIGINT) AS n_added, CAST(sum(n_removed) AS BIGINT) AS n_removed, CAST(sum(n_modified) AS BIGINT) AS n_modified FROM screens",
    "screen_items": f"{TOLD} SELECT screen, kind, key, place FROM (SELECT *, row_number() OVER (PARTITION BY screen ORDER BY {_UP}, score DESC, key, kind) AS place FROM told WHERE screen IS NOT NULL) WHERE place <= 12",
    "describe": f"{TOLD} SELECT kind, key, what, spot AS place FROM told",
    "top_n_per_group": f"{FINDINGS}, {_TOPS} SELECT * FROM by_owner UNION ALL SELECT * FROM by_bucket",
    "filter_findings": f"{TOLD} SELECT 'fields' AS by, kind, key FROM told WHERE bucket = 'breaking' AND owner = 'native' UNION ALL SELECT 'text', kind, key FROM told WHERE lower(concat_ws(' ', name, kind, key, spot, what, array_to_string(signals, ' '), array_to_string(reasons, ' '), array_to_string({_PATHS}, ' '))) LIKE '%page7%' UNION ALL SELECT 'both', kind, key FROM told WHERE kind = 'base_feature' AND lower(what) LIKE '%off → on%'",
    "flatten_findings": f"{TOLD} SELECT kind || ':' || key AS id, CASE WHEN kind IN ('idl_member', 'mojo_method', 'mojo_field') THEN key ELSE name END AS name, kind, owner, bucket, CAST(score AS INT) AS score, change_type, spot, what, CASE WHEN lead <> '' THEN lead ELSE change_type || ':' || kind END AS why, array_to_string(list_slice(CASE WHEN change_type <> 'modified' THEN [] WHEN list_contains(deltas, 'value') OR name LIKE '% -> %' THEN list_transform(moves, lambda m: replace(replace(m, ' > ', ' -> '), 'value: ', 'value: ')) ELSE list_sort(list_filter([{', '.join(_flat_value(c) for c in _compared)}, {_PATH_MOVED.format(chr(39) + 'path: ' + chr(39) + ' || o_path || ' + chr(39) + ' -> ' + chr(39) + ' || n_path')}], lambda x: x IS NOT NULL)) END, 1, 6), '; ') AS deltas, array_to_string(reasons, '; ') AS reasons FROM told",
    "enrich_findings": f"{FINDINGS}, {_BRIEFED}, named_briefs AS (SELECT DISTINCT {_norm('x')} AS t, id, milestone FROM (SELECT unnest([name, feature_name]) AS x, * FROM briefs) WHERE coalesce({_norm('x')}, '') <> ''), chosen AS MATERIALIZED (SELECT t, first(id ORDER BY milestone DESC, id) AS id FROM named_briefs GROUP BY t), asked AS (SELECT kind, key, coalesce(c1.id, c2.id) AS id FROM findings f LEFT JOIN chosen c1 ON c1.t = {_norm('coalesce(f.n_name, f.o_name)')} LEFT JOIN chosen c2 ON c2.t = {_norm('f.key')} WHERE f.bucket <> 'housekeeping') SELECT kind, key, b.id AS brief_id, nullif(b.name, '') AS name, length(b.short) AS n_chars, b.spec, b.shipping_type AS shipping, coalesce(b.desktop, '') AS shipped, 'Neutral' AS ff_position, '' AS safari_position FROM asked a JOIN briefs b ON b.id = a.id",
    "newest_briefs": f"WITH {_BRIEFED} SELECT name, id, milestone, {_short('short', 220)} AS summary FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY milestone DESC, id) AS n FROM briefs WHERE name <> '') WHERE n = 1",
    "versions": "WITH v AS (SELECT concat(100 + o_orderkey % 40, '.0.', o_custkey % 300, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('.', o_orderkey % 120) END) AS version FROM orders), p AS (SELECT version, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v FROM v) SELECT v[1] AS milestone, max_by(version, v) AS version FROM p WHERE len(v) = 4 GROUP BY v[1]",
    "milestone_span": "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 + 100 END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 30 + 100 END AS e FROM orders) SELECT id, CASE WHEN e IS NULL THEN '' WHEN s IS NULL OR s >= e THEN CAST(e AS VARCHAR) ELSE array_to_string(range(greatest(s + 1, e - 7), e + 1), ',') END AS milestones FROM r",
    "skip_reason": f"{LISTED} SELECT snapshot_id, path, {_SKIP} AS reason FROM listing",
    "route_files": f"{LISTED} SELECT snapshot_id, path, unnest(extractors) AS extractor FROM routed",
    "could_declare": f"{LISTED} SELECT c.snapshot_id, c.path, s.surface FROM candidates c JOIN {_values([(n, s) for s, n, _ in _ROUTES], 'x, surface')} s ON s.x = c.extractors[1]",
    "candidates_all": f"{LISTED} SELECT snapshot_id, path, array_to_string(list_sort(list(surface)), ',') AS surfaces FROM by_surface GROUP BY ALL",
    "coverage": f"{LISTED} SELECT snapshot_id, coalesce(surface, '') AS surface, candidates, read AS n_read FROM coverage",
    "reaches": f"{LISTED} SELECT snapshot_id, path FROM listing WHERE {_IN_SCOPE}",
    "partition_scope": f"{LISTED} SELECT 'cut' AS scope, snapshot_id, path FROM listing WHERE path LIKE 'chrome/browser/%' UNION ALL SELECT 'whole', snapshot_id, path FROM listing WHERE path = 'services/network' OR ((path LIKE 'chrome/browser/%') AND regexp_matches(path, '\\.(html|html\\.ts|ts|mojom|idl|json5)$')) OR (path LIKE 'chrome/browser/ui/webui/%' AND path LIKE '%.cc') OR path IN ('chrome/common/pref_names.h', 'chrome/common/chrome_features.cc')",
    "missed_by_directory": f"{LISTED}, {_BY_DIRECTORY} SELECT snapshot_id, directory, missed, place FROM by_directory WHERE place <= 12",
    "missed_by_area": f"{LISTED} SELECT snapshot_id, string_split(path, '/')[1] AS area, count(*) AS candidates, count(*) FILTER (NOT read) AS missed, CAST(floor(count(*) FILTER (read) * 100 / count(*)) AS INT) AS percent FROM candidates GROUP BY ALL",
    "multi_surface_files": f"{LISTED}, {_SHARED} SELECT * FROM shared_files",
    "missed_paths": f"{LISTED}, {_MISSED} SELECT 'all' AS listed, * FROM missed UNION ALL SELECT 'first', * FROM missed WHERE place <= 40",
    "catalog_order": f"{LISTED} SELECT snapshot_id, path, row_number() OVER (PARTITION BY snapshot_id ORDER BY read, path) AS place FROM candidates",
    "scope_violations": f"{FACTS}, {_VIOLATIONS} SELECT * FROM violations",
    "unresolved_references": f"{FACTS}, {_REFS} SELECT * FROM refs",
    "closure_summary": f"{FACTS}, {_REFS}, {_CLOSURE} SELECT * FROM closure",
    "link_findings": f"{FINDINGS}, {_EDGES} SELECT a, b FROM edges",
    "clusters": _recursive(f"{FINDINGS}, {_GROUPED} SELECT * FROM clusters"),
    "order_clusters": _recursive(f"{FINDINGS}, {_GROUPED} SELECT cluster, size, place FROM (SELECT *, row_number() OVER (ORDER BY top_score DESC, size DESC, cluster) AS place FROM clusters) WHERE place <= 25"),
    "annotate": _recursive(f"{FINDINGS}, {_GROUPED} SELECT m.kind, m.key, m.cluster, c.label, c.size, c.kinds, c.top_score FROM clustered m JOIN clusters c USING (cluster)"),
}

_found = f"found AS MATERIALIZED ({corpus.expected_sql()})"
_count = lambda d, r: f"(SELECT count(*) FROM part WHERE p_partkey % {d} = {r})"
#: Files by extractor: a file a part and template; those that can't be parsed, can't be read, or are empty; and an extractor that reads none.
_files = "files AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS extractor, {len([1 for x, *_ in corpus.FILES if x == e])} * (SELECT count(*) FROM part)" + {"flags_metadata": f" + {_count(50, 0)}", "base_features": f" + {_count(40, 0)}"}.get(e, "") + f" AS n_files, {dict(flags_metadata=_count(50, 0), base_features=_count(40, 1)).get(e, '0')} AS n_errors"
    for e in (*dict.fromkeys(x for x, *_ in corpus.FILES), "unused")
) + ")"
_three = lambda dialect, l, r: {"cpp": f"({l}) AND NOT ({r})", "template": f"NOT ({l}) OR ({r})", "attribute": f"NOT (({l}) OR ({r}))"}[dialect]
_L, _R = "CASE WHEN p_size % 2 = 0 THEN true WHEN p_size % 5 = 0 THEN false END", "CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 7 = 0 THEN false END"
_HELD = "held AS (" + " UNION ALL ".join(f"SELECT p_partkey AS id, '{d}' AS dialect, {_three(d, _L, _R)} AS holds FROM part" for d in ("cpp", "template", "attribute")) + ")"
SQL |= {
    "extract_facts": f"WITH {_found} SELECT * FROM found",
    "extract_stats": f"WITH {_found}, {_files}, n AS (SELECT extractor, count(*) AS n_facts FROM found GROUP BY 1) SELECT f.extractor, CAST(coalesce(n_facts, 0) AS BIGINT) AS n_facts, CAST(n_files AS BIGINT) AS n_files, CAST(n_errors AS BIGINT) AS n_errors FROM files f LEFT JOIN n USING (extractor)",
    "build_snapshot": f"WITH {_found}, stated AS (SELECT kind, key, path, coalesce(nullif(regexp_extract(attrs, 'platform_state=.\"windows\":\"([a-z_]+)\"', 1), ''), nullif(regexp_extract(attrs, 'platform_status=.*\"windows\":\"zzz', 0), ''), '') AS state FROM found), every_one AS (SELECT kind, key, CASE WHEN path LIKE 'components/x/%' THEN replace(path, 'components/x/', 'components/x/android/') ELSE path END AS path, state FROM stated UNION ALL SELECT kind, regexp_replace(key, '^m\\.', 'n.'), replace(path, 'services/m/m', 'services/mac/n'), 'not_compiled' FROM stated WHERE path LIKE 'services/%') SELECT kind, key, path, state FROM every_one",
    "path_functions": f"{LISTED}, r AS (SELECT *, regexp_replace(path, '^chrome/browser/resources/', '') AS below, regexp_extract(path, '[^/]*$') AS name, 'some/far/away/folder/' || path AS far FROM listing), s AS (SELECT *, CASE WHEN regexp_matches(name, '\\.html(\\.ts)?$') THEN regexp_replace(name, '\\.html(\\.ts)?$', '') ELSE regexp_replace(name, '\\.[^.]*$', '') END AS stem FROM r) SELECT snapshot_id, path, string_split(below, '/')[1] AS surface, CASE WHEN len(string_split(below, '/')) >= 3 THEN string_split(below, '/')[2] ELSE stem END AS page, stem, {_trimmed('far')} AS trimmed FROM s",
    "name_functions": f"WITH r AS ({duckdb_sql(corpus.NAMES)}) SELECT id, CASE WHEN regexp_matches(name, '^k[A-Z]') THEN substr(name, 2) ELSE name END AS bare, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS identifier, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS ascii, name AS line, CASE WHEN regexp_matches(regexp_extract(ref, '[^/]*$'), '^\\d+(\\.\\d+){{3}}$') THEN replace(regexp_extract(ref, '[^/]*$'), '.', '-') ELSE '' END AS version, CAST(100 + id % 60 AS INT) AS milestone, CASE status WHEN 'test' THEN 1 WHEN 'experimental' THEN 2 WHEN 'stable' THEN 3 ELSE 0 END AS rank FROM r",
    "shares": "WITH r AS (SELECT DISTINCT l_suppkey AS id, CAST(l_partkey % 50 AS BIGINT) AS candidates, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_suppkey % 60 AS BIGINT) END AS n_read FROM lineitem), s AS (SELECT *, CASE WHEN candidates > 0 THEN greatest(0.0, least(1.0, CAST(n_read AS DOUBLE) / candidates)) END AS share FROM r) SELECT id, candidates, n_read, CASE WHEN n_read IS NULL THEN NULL ELSE share END AS share, CASE WHEN n_read IS NULL OR share IS NULL THEN '?' ELSE CAST(CAST(round_even(share * 100, 0) AS INT) AS VARCHAR) || '%' END AS words, CAST(CASE WHEN candidates > 0 THEN coalesce(n_read, 0) * 100 // candidates ELSE 0 END AS INT) AS percent FROM s",
    "build_guards": f"WITH {_HELD}, states AS (SELECT id, CASE WHEN count(*) FILTER (holds = false) > 0 THEN 'not_compiled' WHEN count(*) FILTER (holds IS NULL) > 0 THEN 'conditional' ELSE 'compiled' END AS state FROM held GROUP BY id) SELECT id, dialect, coalesce(CAST(holds AS VARCHAR), 'unknown') AS holds, state FROM held JOIN states USING (id)",
    "signatures": "SELECT p_partkey AS id, concat('Promise<long> m', p_partkey, '(long a, optional sequence<', p_size, '> b = \"x, ,(y\"', CASE WHEN p_partkey % 3 = 0 THEN ', (long or map<K, V>)... rest' ELSE '' END, ')') AS signature, concat('long a, optional sequence<', p_size, CASE WHEN true THEN ' > b = \"x, ,(y\"' END, CASE WHEN p_partkey % 3 = 0 THEN ', (long or map<K, V>)... rest' ELSE '' END) AS params, concat('A', p_partkey, '=(x,y);B=', p_size, ';C=True') AS ext, CASE WHEN p_partkey % 3 = 0 THEN '(1, None)' ELSE '(1, 2)' END AS arity FROM part",
    "snapshot_round_trip": f"{FACTS}, n AS (SELECT snapshot_id, kind, count(*) AS n_facts, CAST(sum(line) AS BIGINT) AS lines, CAST(sum({' + '.join(f'(a_{c} IS NOT NULL)::INT' for c in COLUMNS)} + (signatures IS NOT NULL)::INT + (traits IS NOT NULL)::INT + (places IS NOT NULL)::INT) AS BIGINT) AS n_attrs FROM facts GROUP BY ALL) SELECT *, CAST(64 AS BIGINT) AS n_documents FROM n",
    "listing_round_trip": f"{LISTED} SELECT snapshot_id, path FROM listing",
    "briefs_round_trip": f"WITH b AS ({duckdb_sql(BRIEFS)}) SELECT id, name, coalesce(feature_name, '') AS feature_name, category, CASE WHEN id % 2 = 0 THEN '' ELSE shipping_type END AS shipping_type, spec, coalesce(desktop, '') AS desktop, length(summary) AS n_chars FROM b",
    "corpus_round_trip": "SELECT source AS place, CAST(sum(length(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')) + 1) AS BIGINT) AS n_chars, '' AS error FROM documents GROUP BY source UNION ALL VALUES ('odd/broken.cc', NULL, 'not readable'), ('odd/empty.cc', 0, ''), ('odd/gone.cc', NULL, 'missing')",
    "snapshot_pipeline": f"""WITH o AS (SELECT * FROM ({corpus.expected_sql(*corpus.VERSIONS[0][1:])})), n AS (SELECT * FROM ({corpus.expected_sql(*corpus.VERSIONS[1][1:])})),
j AS (SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.key, n.key) AS key, CASE WHEN o.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
  coalesce(regexp_matches(o.attrs, 'platform_state=.{{1,3}}windows":"not_compiled'), true) AND coalesce(regexp_matches(n.attrs, 'platform_state=.{{1,3}}windows":"not_compiled'), true) AS outside FROM o FULL JOIN n USING (kind, key) WHERE o.attrs IS DISTINCT FROM n.attrs)
SELECT kind, key, change_type, change_type <> 'modified' AND NOT outside AS unconfirmed, '1 absent target(s) and ' || (SELECT count(*) FILTER (p_partkey % 50 = 0) + count(*) FILTER (p_partkey % 40 = 1) FROM part WHERE p_partkey % 13 <> 0) || ' unreadable file(s)' AS gap FROM j""",
}

_pair_columns = ["kind", "key", "path", "signatures", "traits", *(f"a_{c}" for c in COLUMNS)]
_CHAINED = f"""{FACTS.replace(duckdb_sql(FLAT), duckdb_sql(CHAIN_FLAT))},
joined AS ({" UNION ALL ".join(f"SELECT '{p}' AS pair_id, coalesce(o.kind, n.kind) AS kind, coalesce(o.key, n.key) AS key, o.kind AS was, n.kind AS now, " + ", ".join(f"{s}.{c} AS {s}_{c}" for s in ("o", "n") for c in _pair_columns[2:]) + f" FROM (SELECT * FROM facts WHERE snapshot_id = '{a}') o FULL JOIN (SELECT * FROM facts WHERE snapshot_id = '{b}') n ON o.kind = n.kind AND o.key = n.key" for p, a, b in CHAIN_PAIRS)}),
moved AS (SELECT pair_id, kind, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'modified' END AS change_type, CASE WHEN was IS NULL OR now IS NULL THEN [] ELSE list_filter([{", ".join(_VALUES)}], lambda x: x IS NOT NULL) END AS moves FROM joined)"""
SQL["compare_versions"] = f"{_CHAINED} SELECT pair_id, kind, change_type, count(*) AS n, CAST(sum(len(moves)) AS BIGINT) AS n_moves, CAST(sum(length(array_to_string(moves, '; '))) AS BIGINT) AS n_chars FROM moved WHERE change_type <> 'modified' OR len(moves) > 0 GROUP BY ALL"


def _rest(query: str, common: str) -> str:
    """A query's SQL behind the tables that it has in common with others."""
    whole, first = SQL[query].replace("WITH RECURSIVE ", "WITH ", 1), common.replace("WITH RECURSIVE ", "WITH ", 1)
    assert whole.startswith(first), query
    return whole[len(first) :]


def _lines(**tables: tuple[str, str]) -> str:
    """All rows of some tables, each as a line of its columns."""
    return " UNION ALL ".join(f"SELECT '{name}' AS name, concat_ws('|', {columns}) AS line FROM ({sql})" for name, (sql, columns) in tables.items())


_N = "n_added, n_removed, n_modified"
SQL["report_tables"] = _recursive(f"{TOLD}, {_GROUPED}, {_SCREENS}, {_STORIES}, {_SUMMARY}, {_TOPS} ") + _lines(
    changes=(_rest("change_summary", CHANGES), f"kind, {_N}"),
    findings=("SELECT * FROM summary", "what, value, n"),
    owners=(_rest("owner_bucket_matrix", FINDINGS), "owner, breaking, behaviour, new, housekeeping, total"),
    figures=(_rest("measured_figures", FINDINGS), "owner, breaking, no_signal"),
    stories=(_rest("stories", f"{FINDINGS}, {_STORIES}"), f"consequence, story, n, {_N}, severity, score, place"),
    screens=(_rest("screens", f"{TOLD}, {_SCREENS}"), f"screen, n, {_N}, score, place"),
    screen_totals=(_rest("screen_totals", f"{TOLD}, {_SCREENS}"), f"n_screens, {_N}"),
    screen_items=(_rest("screen_items", TOLD), "screen, kind, key, place"),
    clusters=(_rest("order_clusters", f"{FINDINGS}, {_GROUPED}"), "cluster, size, place"),
    by_owner=("SELECT * FROM by_owner", "value, kind, key, place, remaining"),
    by_bucket=("SELECT * FROM by_bucket", "value, kind, key, place, remaining"),
    flat=(_rest("flatten_findings", TOLD), "id, name, kind, owner, bucket, score, change_type, spot, what, why, deltas, reasons"),
)
SQL["audit_tables"] = f"{FACTS}, {LISTED.removeprefix('WITH ')}, {_REFS}, {_CLOSURE}, {_VIOLATIONS}, {_BY_DIRECTORY}, {_MISSED}, {_SHARED} " + _lines(
    coverage=(_rest("coverage", LISTED), "snapshot_id, nullif(surface, ''), candidates, n_read"),
    directories=(_rest("missed_by_directory", f"{LISTED}, {_BY_DIRECTORY}"), "snapshot_id, directory, missed, place"),
    areas=(_rest("missed_by_area", LISTED), "snapshot_id, area, candidates, missed, percent"),
    shared=("SELECT * FROM shared_files", "snapshot_id, n_files"),
    missed=("SELECT * FROM missed WHERE place <= 400", "snapshot_id, path, place, n_missed"),
    unresolved=("SELECT * FROM refs", "snapshot_id, link, source_key, target"),
    closure=("SELECT * FROM closure", "snapshot_id, link, n_references, names, more"),
    violations=("SELECT * FROM violations", "snapshot_id, suffix, n_files"),
)
