"""What happened, in labels: signals of changes, and what the leading one decides.

Rules are columns over a change's kind, direction, sides and deltas; each gives a label or
nothing. Only the overload rule needs to read argument lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import attr, attr_list, attr_text, lookup, our_state, our_status, platform_value, status_rank
from ..functions.parsing import arity_ranges

ORIGIN_TRIAL = ("origin_trial_feature_name", "origin_trial_allows_third_party", "origin_trial_os", "origin_trial_type", "origin_trial_allows_insecure")
WIRING = ("base_feature", "base_feature_status", "depends_on", "implied_by", "public", "copied_from_base_feature_if", "settable_from_internals", "browser_process_read_access", "browser_process_read_write_access", "is_protected_feature")


def has(*names: str) -> Column:
    """Whether any of the attributes moved, by the row's ``__names``."""
    return F.arrays_overlap("__names", F.array(*map(F.lit, names)))


def _labels(*rules_: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*rules_)))


def _when(condition: Column, label: str | Column) -> Column:
    return F.when(condition, F.lit(label) if isinstance(label, str) else label)


def _is(*types: str) -> Column:
    return F.col("change_type").isin(*types)


def base_feature_signals() -> Column:
    """C1."""
    old, new = our_state("before"), our_state("after")
    default_old, default_new = attr("before", "default_state"), attr_text("after", "default_state")
    moved = _is(rules.MODIFIED)
    return _labels(
        _when(_is(rules.REMOVED), F.when(old == "enabled", "flag_retired_on").when(old == "disabled", "flag_retired_off").otherwise("feature_deleted")),
        _when(_is(rules.ADDED) & (new == "enabled"), "new_feature_on_by_default"),
        _when(moved & (old != new), F.when(new == "enabled", "enabled_by_default").when(new == "disabled", "disabled_by_default").otherwise("build_gate_changed")),
        _when(moved & has("conditions"), "build_gate_changed"),
        _when(moved & ~attr("before", "var").eqNullSafe(attr("after", "var")), "feature_symbol_renamed"),
        _when(moved & ~default_old.eqNullSafe(attr("after", "default_state")), F.when(default_new == "enabled", "default_flip_on").when(default_new == "disabled", "default_flip_off")),
    )


def runtime_flag_signals() -> Column:
    """C3."""
    old, new = our_status("before"), our_status("after")
    up, down = status_rank(new) > status_rank(old), status_rank(new) < status_rank(old)
    moved = _is(rules.MODIFIED)
    some = _labels(
        _when(_is(rules.REMOVED), F.when(old == "stable", "killswitch_retired").otherwise("experimental_dropped")),
        _when(_is(rules.ADDED), F.when(new == "stable", "web_api_shipped").otherwise("web_api_added")),
        _when(moved & (up | down), F.when(up & (new == "stable"), "web_api_shipped").when(down & (old == "stable"), "web_api_unshipped").otherwise("web_api_status_moved")),
        _when(moved & has(*ORIGIN_TRIAL), "origin_trial_change"),
        _when(moved & has(*WIRING), "runtime_flag_rewired"),
    )
    return F.when((F.size(some) == 0) & has("status"), F.array(F.lit("runtime_flag_rewired"))).otherwise(some)


def overload_signals() -> Column:
    """Lost and gained argument lists; a gained one shadows if a served argument count meets an old one or rises above the old ceiling."""
    side = lambda m: F.when(F.size(attr_list(m, "signatures")) > 0, attr_list(m, "signatures")).otherwise(F.array(attr_text(m, "signature")))
    before, after = side("before"), side("after")
    lost, gained = F.array_except(before, after), F.array_except(after, before)
    old, new = arity_ranges(before), arity_ranges(gained)
    meets = lambda a, b: (a["low"] <= F.coalesce(b["high"], b["low"])) & (b["low"] <= F.coalesce(a["high"], a["low"]))
    ceiling = F.when(~F.exists(old, lambda o: o["high"].isNull()), F.coalesce(F.array_max(F.transform(old, lambda o: o["high"])), F.lit(0)))
    shadows = F.exists(new, lambda n: F.exists(old, lambda o: meets(o, n)) | F.coalesce(n["high"].isNull() & ceiling.isNotNull(), F.lit(False)) | F.coalesce(n["high"] > ceiling, F.lit(False)))
    return _labels(_when(F.size(lost) > 0, "web_api_overload_removed"), _when(F.size(gained) > 0, F.when(shadows, "web_api_overload_shadowed").otherwise("web_api_overload_added")))


def web_api_signals() -> Column:
    """C4; ``reachable`` comes from the gates."""
    moved = _is(rules.MODIFIED)
    first = _labels(
        _when(_is(rules.REMOVED), F.when(F.coalesce(F.col("reachable"), F.lit(True)), "web_api_removed").otherwise("web_api_removed_gated")),
        _when(_is(rules.ADDED), F.when(F.col("reachable").isNull(), "web_api_added").when(F.col("reachable"), "web_api_added_live").otherwise("web_api_added_gated")),
        _when(moved & ~has("signatures") & has("signature", "idl_kind", "member_type"), "web_api_signature_change"),
    )
    rest = _labels(_when(moved & has("overload_traits"), "web_api_exposure_changed"), _when(moved & has("inherits", "values"), "web_api_shape_changed"), _when(moved & has("ext", "runtime_enabled"), "web_api_exposure_changed"))
    overloads = F.when(moved & has("signatures"), overload_signals()).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, overloads, rest))


def _moved_position() -> Column:
    return F.exists("deltas", lambda d: (d["attr"] == "position") & d["old"].isNotNull() & d["new"].isNotNull())


def message_data_signals() -> Column:
    """C7."""
    moved = _is(rules.MODIFIED)
    shape = has("type", "ordinal", "mojo_kind") | _moved_position()
    return _labels(
        _when(_is(rules.REMOVED), "ipc_removed"),
        _when(moved & has("values"), "ipc_enum_changed"),
        _when(moved, F.when(shape, "ipc_shape_changed").when(has("default", "attrs", "min_version"), "ipc_field_annotated")),
    )


def message_call_signals() -> Column:
    """C8."""
    call = F.when(has("signature", "params", "response"), "ipc_signature_change").when(has("ordinal") | _moved_position(), "ipc_ordinal_changed").when(has("attrs"), "build_gate_changed")
    return _labels(_when(_is(rules.REMOVED), "ipc_removed"), _when(_is(rules.MODIFIED), call))


def small_signals(target_milestone: int | None) -> dict[tuple[str, ...], Column]:
    """C9 to C14, by kinds."""
    moved = _is(rules.MODIFIED)
    param = _labels(_when(_is(rules.REMOVED), "param_removed"), _when(has("default"), "param_default_changed"), _when(has("var"), "feature_symbol_renamed"), _when(has("type", "feature"), "param_rewired"))
    route = _labels(_when(_is(rules.REMOVED), "ui_page_removed"), _when(_is(rules.ADDED), "ui_page_added"), _when(moved & has("guards"), "ui_page_regated"), _when(moved & has("route", "parent"), "ui_page_moved"))
    control = _labels(
        _when(_is(rules.REMOVED), "ui_control_removed"), _when(_is(rules.ADDED), "ui_control_added"), _when(moved & has("control"), "ui_control_type_changed"),
        _when(moved & has("pref"), "ui_control_repointed"), _when(moved & has("build_conditions"), "build_gate_changed"), _when(moved & has("label"), "ui_control_relabelled"),
    )
    gate = _labels(_when(_is(rules.REMOVED), "ui_gate_removed"), _when(_is(rules.ADDED), "ui_gate_added"), _when(moved & has("expression", "features", "enabled_checks"), "ui_gate_changed"))
    kind = F.col("kind")
    scan = _labels(
        F.when(_is(rules.REMOVED), F.concat(kind, F.lit("_left_scan"))).when(has("platform_state"), F.lit("build_gate_changed")).when(has("var"), F.concat(kind, F.lit("_symbol_renamed")))
    )
    expiry = attr_text("after", "expiry_milestone").try_cast("int")
    soon = _is(rules.ADDED, rules.MODIFIED) & (expiry > 0) & (expiry <= target_milestone + 2) if target_milestone else F.lit(False)
    flag = _labels(F.when(soon, F.lit("flag_expiring")).when(moved & has("expiry_milestone"), F.lit("flag_expiry_moved")))
    return {("feature_param",): param, ("webui_route",): route, ("webui_control",): control, ("webui_gate",): gate, ("pref", "switch"): scan, ("flag_entry",): flag}


def with_signals(changes: DataFrame, target_milestone: int | None = None) -> DataFrame:
    """Changes with all their signals (C1 to C15) and the severity (C17), step by step: what a step takes several times is worked out once before it."""
    kind, none = F.col("kind"), F.array().cast("array<string>")
    by_kind = {("base_feature",): base_feature_signals(), ("blink_runtime_feature",): runtime_flag_signals(), ("idl_member", "idl_interface"): web_api_signals(), ("mojo_struct", "mojo_field", "mojo_enum"): message_data_signals(), ("mojo_method", "mojo_interface"): message_call_signals()}
    out = none
    for kinds, value in (by_kind | small_signals(target_milestone)).items():
        out = F.when(kind.isin(*kinds), value).otherwise(out)
    rows = changes.withColumn("__names", F.transform("deltas", lambda d: d["attr"])).withColumn("__own", out)
    rows = rows.withColumn("__own", F.concat("__own", F.when(has("path"), F.array(F.lit("declaration_moved"))).otherwise(none)))
    late = F.when(has("platform_state"), F.array(F.lit("build_gate_changed"))).when(has("stable"), F.array(F.lit("ipc_stability_changed")))
    rows = rows.withColumn("signals", F.when(F.size("__own") == 0, F.coalesce(late, none)).otherwise(F.col("__own")))
    return rows.withColumn("__lead", leading_signal()).withColumn("severity", severity_of(F.col("__lead"))).drop("__names", "__own", "__lead")


def leading_signal(signals: str = "signals") -> Column:
    """The signal of the highest severity, the last by name among equals; '' without one."""
    ranked = F.transform(signals, lambda s: F.struct(F.coalesce(lookup(rules.SEVERITY, s), F.lit(0)).alias("n"), s.alias("s")))
    return F.coalesce(F.array_max(ranked)["s"], F.lit(""))


def severity_of(lead: Column | None = None) -> Column:
    """C17: the leading signal's severity; without one the prior of kind and direction. Here and below ``lead`` is the leading signal where it is known."""
    lead = leading_signal() if lead is None else lead
    prior = {f"{k}:{t}": n for k, some in rules.PRIOR.items() for t, n in zip((rules.REMOVED, rules.ADDED, rules.MODIFIED), some, strict=True)}
    return F.when(lead != "", F.coalesce(lookup(rules.SEVERITY, lead), F.lit(0))).otherwise(F.coalesce(lookup(prior, F.concat_ws(":", "kind", "change_type")), F.lit(rules.OTHER_PRIOR)))


def bucket_of(lead: Column | None = None) -> Column:
    """C18."""
    return F.coalesce(lookup(rules.SIGNAL_BUCKET, leading_signal() if lead is None else lead), lookup(rules.NO_SIGNAL_BUCKET, F.col("change_type")), F.lit(rules.HOUSEKEEPING))


def owner_of(lead: Column | None = None) -> Column:
    """C19."""
    return F.when((leading_signal() if lead is None else lead).isin(*rules.CONFIG_SIGNALS), "config").otherwise(F.coalesce(lookup(rules.by_member(rules.KIND_OWNER), F.col("kind")), F.lit("native")))


def group_of() -> Column:
    """C20."""
    return F.coalesce(lookup(rules.by_member(rules.GROUPS), F.col("kind")), F.lit(""))


def story_of(lead: Column | None = None) -> Column:
    """What a change is told under: its leading signal, else direction and kind."""
    lead = leading_signal() if lead is None else lead
    return F.when(lead != "", lead).otherwise(F.concat_ws(":", "change_type", "kind"))


def not_in_build() -> Column:
    """every side there is says 'not_compiled' for us, and there is one."""
    out = lambda m: platform_value(m, "platform_state") == "not_compiled"
    there = lambda m: F.coalesce(F.size(m), F.lit(0)) > 0
    return (there("before") | there("after")) & (~there("before") | out("before")) & (~there("after") | out("after"))
