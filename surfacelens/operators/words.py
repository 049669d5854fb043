"""Changes in words: states, controls, screens and one line for each change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import attr_list, attr_text, lookup, text_of


def state_word(value: Column) -> Column:
    """A state in words; unknown ones stay, nothing is 'not enabled'."""
    text = F.coalesce(value, F.lit(""))
    return F.coalesce(lookup(rules.STATE_WORDS, text), text)


def control_word(tag: Column) -> Column:
    """A control's type in words: that of the first part of the table found in its tag; other tags stay."""
    out = None
    for part, word in rules.CONTROL_WORDS:
        found = F.lower(tag).contains(part)
        out = F.when(found, word) if out is None else out.when(found, word)
    return out.otherwise(F.when(F.coalesce(tag, F.lit("")) == "", "control").otherwise(tag))


def _sides(name: str) -> Column:
    """An attribute of the older side, else of the newer; '' without any."""
    old = attr_text("before", name)
    return F.when(old != "", old).otherwise(attr_text("after", name))


def screen_of() -> Column:
    """The screen that a UI change is on; null for other kinds.

    Controls: surface and page, from the first side that names a surface, else from the key.
    Pages: the surface, else settings. Gates: the handler without one known ending.
    """
    side = F.when(attr_text("before", "surface") != "", F.col("before")).when(attr_text("after", "surface") != "", F.col("after"))
    surface, page = attr_text(side, "surface"), attr_text(side, "page")
    parts = F.split("key", "/")
    from_key = F.when(F.size(parts) >= 2, F.concat_ws(" › ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    control = F.when(side.isNull(), from_key).when((page != "") & (page != surface), F.concat_ws(" › ", surface, page)).otherwise(surface)
    handler = _sides("handler")
    handler = F.when(handler != "", handler).otherwise(F.get(parts, F.lit(0)))
    gate = handler
    for ending in reversed(rules.HANDLER_ENDINGS):
        gate = F.when(handler.endswith(ending), F.when(handler == ending, handler).otherwise(F.regexp_replace(handler, ending + "$", ""))).otherwise(gate)
    kind = F.col("kind")
    return F.when(kind == "webui_control", control).when(kind == "webui_route", F.when(_sides("surface") != "", _sides("surface")).otherwise("settings")).when(kind == "webui_gate", gate)


def _delta(name: str) -> Column:
    return F.get(F.filter("deltas", lambda d: d["attr"] == name), F.lit(0))


def _moved(name: str) -> Column:
    """'old → new' of an attribute that moved; null if it did not."""
    d = _delta(name)
    return F.when(d.isNotNull() & ~d["old"].eqNullSafe(d["new"]), F.concat(state_word(text_of(d["old"])), F.lit(" → "), state_word(text_of(d["new"]))))


def _moved_here(name: str) -> Column:
    """'old → new for Windows' where our platform's entry of an attribute moved and both sides have one."""
    d = _delta(name)
    entry = lambda side: F.get_json_object(d[side], f"$.{rules.PLATFORM}")
    both = d["old"].isNotNull() & d["new"].isNotNull()
    return F.when(both & ~entry("old").eqNullSafe(entry("new")), F.concat(state_word(entry("old")), F.lit(" → "), state_word(entry("new")), F.lit(f" for {rules.PLATFORM.capitalize()}")))


def _or(text: Column, more: Column) -> Column:
    return F.concat(text, F.coalesce(more, F.lit("")))


def _tail(before: str, value: Column, after: str = "") -> Column:
    """The value between two texts; nothing if it is empty."""
    return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))


def _first_two(names: Column) -> Column:
    return F.array_join(F.slice(names, 1, 2), ", ")


def describe() -> Column:
    """What a change is about, in one line: the thing in words, and what of it moved.

    Attributes are those of the newer side, of the older where there is none.
    """
    side = F.when(F.coalesce(F.size("after"), F.lit(0)) > 0, F.col("after")).otherwise(F.col("before"))
    text = lambda name: attr_text(side, name)
    word = lookup(rules.KIND_WORDS, F.col("kind"))
    named = lambda c: F.concat(word, F.lit(" "), c)
    name, key, added = F.col("name"), F.col("key"), F.col("change_type") == rules.ADDED
    moves = lambda m: F.concat(F.lit(" — "), m)

    tag = _delta("control")
    control = F.when(tag.isNotNull(), F.concat(control_word(text_of(tag["old"])), F.lit(" → "), control_word(text_of(tag["new"])))).otherwise(control_word(text("control")))
    label = F.when(text("label") != "", text("label")).when(text("element_id") != "", text("element_id")).otherwise(F.substring_index(name, ":", -1))
    control = _or(_or(control, _tail(" — ", label)), _tail(" (writes ", text("pref"), ")"))
    route = F.when(text("route") != "", text("route")).otherwise(name)
    page = _or(F.concat(F.lit("page "), route), _tail(" (shown when ", _first_two(attr_list(side, "guards")), ")"))
    gate = _or(F.concat(F.lit("visibility switch "), name), _tail(" (from ", _first_two(attr_list(side, "features")), ")"))

    ours = F.coalesce(F.get_json_object(F.try_element_at(side, F.lit("platform_state")), f"$.{rules.PLATFORM}"), F.lit(""))
    flag = F.coalesce(moves(F.coalesce(_moved_here("platform_state"), _moved("default_state"))), F.when(added & (ours != ""), F.concat(F.lit(" — arrives "), state_word(ours), F.lit(f" for {rules.PLATFORM.capitalize()}"))))
    status = F.when(text("windows_status") != "", text("windows_status")).otherwise(text("status"))
    runtime = F.coalesce(moves(F.coalesce(_moved_here("platform_status"), _moved("status"))), F.when(added & (status != ""), F.concat(F.lit(" — arrives "), state_word(status))))
    param = _or(_or(named(name), _tail(" of ", text("feature"))), moves(_moved("default")))
    sort = F.when(text("idl_kind") != "", text("idl_kind")).otherwise("interface")
    member = F.when(text("member_type") != "", text("member_type")).otherwise("member")
    count = lambda c, what: F.when(~c.isin("", "0"), F.concat(F.lit(" ("), c, F.lit(f" {what})")))
    n_values = F.size(attr_list(side, "values"))
    expiry = text("expiry_milestone")
    by_kind = {
        "webui_control": control, "webui_route": page, "webui_gate": gate,
        "base_feature": _or(named(name), flag), "feature_param": param, "blink_runtime_feature": _or(named(name), runtime),
        "idl_interface": F.concat(word, F.lit(" "), sort, F.lit(" "), name),
        "idl_member": _or(F.concat(word, F.lit(" "), member, F.lit(" "), key), _tail(" (behind ", text("runtime_enabled"), ")")),
        "mojo_interface": _or(named(key), count(text("method_count"), "calls")),
        "mojo_method": F.concat(named(key), F.lit("()")),
        "mojo_struct": _or(named(key), F.coalesce(moves(_moved("mojo_kind")), count(text("field_count"), "fields"))),
        "mojo_field": _or(named(key), F.coalesce(moves(_moved("type")), _tail(" (", text("type"), ")"))),
        "mojo_enum": _or(named(key), F.when(n_values > 0, F.concat(F.lit(" ("), n_values, F.lit(" values)")))),
        "switch": F.concat(word, F.lit(" --"), name),
        "pref": named(name),
        "flag_entry": _or(F.concat(word, F.lit(" #"), name), F.coalesce(F.concat(F.lit(" — removal "), _moved("expiry_milestone")), F.when(~expiry.isin("", "0"), F.concat(F.lit(" (removal M"), expiry, F.lit(")"))))),
    }
    out = None
    for kind, line in by_kind.items():
        out = F.when(F.col("kind") == kind, line) if out is None else out.when(F.col("kind") == kind, line)
    return out.otherwise(name)


def where_of() -> Column:
    """The screen of a UI change, else the folder of its first path."""
    path = F.coalesce(F.get("paths", F.lit(0)), F.lit(""))
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)
    return F.when(F.col("kind").isin("webui_control", "webui_route", "webui_gate"), F.coalesce(screen_of(), F.lit(""))).otherwise(folder)
