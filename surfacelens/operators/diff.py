"""Comparison of snapshots: meaningful attributes, full outer join, gates, renames and repoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..common import stored
from ..functions import rules
from ..functions.columns import attr, attr_text, location, lookup, our_status
from .facts import dedupe_facts, versions_of
from .ranking import placed
from .signals import severity_of, with_signals

#: Kinds that say whether a page can reach a web API.
GATES = ("blink_runtime_feature", "idl_interface")
_DELTAS = "array<struct<attr:string,old:string,new:string>>"


def meaningful(names: Column, attrs: Column) -> Column:
    """The attributes that a comparison reads: the kind's ``names`` (all, where these are null), without a platform state that is absent or 'compiled'."""
    state = lambda v: F.coalesce(F.get_json_object(v, f"$.{rules.PLATFORM}"), F.lit(""))
    return F.map_filter(attrs, lambda k, v: (names.isNull() | F.array_contains(names, k)) & ((k != "platform_state") | ~state(v).isin("", "compiled")))


def meaningful_attrs(facts: DataFrame) -> DataFrame:
    """facts with their meaningful attributes alone."""
    return facts.withColumn("attrs", meaningful(lookup(rules.MEANINGFUL, F.col("kind")), F.col("attrs")))


def attr_deltas(before: Column, after: Column, old_path: Column, new_path: Column) -> Column:
    """Sorted differences between two maps of meaningful attributes, and of the paths."""
    names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    one = lambda m, k: F.try_element_at(m, k)
    moved = F.filter(names, lambda k: ~one(before, k).eqNullSafe(one(after, k)) & (~k.isin(*rules.PAIRED) | (one(before, k).isNotNull() & one(after, k).isNotNull())))
    deltas = F.transform(moved, lambda k: F.struct(k.alias("attr"), one(before, k).alias("old"), one(after, k).alias("new")))
    path = F.when((old_path != "") & (new_path != "") & (old_path != new_path), F.array(F.struct(F.lit("path").alias("attr"), old_path.alias("old"), new_path.alias("new"))))
    return F.array_sort(F.concat(deltas, F.coalesce(path, F.array().cast(_DELTAS))))


def _overload_places(attrs: Column) -> Column:
    some = F.from_json(attr(attrs, "overload_locations"), "array<string>")
    return F.coalesce(F.transform(some, lambda x: F.element_at(F.split(x, " @ "), -1)), F.array().cast("array<string>"))


def locations(old: str, new: str) -> Column:
    """Places of both sides, then of overloads, each once."""
    side = lambda c: F.array(location(F.col(f"{c}.path"), F.col(f"{c}.line")))
    return F.array_distinct(F.array_compact(F.concat(side(old), side(new), _overload_places(F.col(f"{new}.attrs")), _overload_places(F.col(f"{old}.attrs")))))


def join_pair(facts: DataFrame, pairs: DataFrame, declared: bool = False, sizes: Observation | None = None) -> DataFrame:
    """Both sides of every pair by (pair, kind, key), with o and n as structs; null where a side lacks the identity.

    ``facts`` has one row per (snapshot, kind, key), see ``operators.facts.dedupe_facts``; with
    ``declared`` it has the raw declarations, of which the first of each identity are chosen on the way.
    All versions of an identity are brought together once, whatever the number of pairs they are
    in: one shuffle by (kind, key), and none where facts are bucketed by it (see
    ``sources.store``). Pairs are then read off these versions within their row. The pair
    list is short and read by the driver. ``sizes`` takes in each snapshot's number of facts as the rows pass;
    with ``declared``, identities that are the same in all versions are then left out.
    """
    some = [tuple(r) for r in pairs.select("pair_id", "from_id", "to_id").distinct().collect()]
    if not some:
        side = "struct<name:string,path:string,line:int,attrs:map<string,string>>"
        return facts.sparkSession.createDataFrame([], f"pair_id string, kind string, key string, o {side}, n {side}")
    number = {v: f"__v{i}" for i, v in enumerate(sorted({v for _, *sides in some for v in sides}))}
    if declared:
        rows = versions_of(facts, number, sizes)
    else:
        fields = F.struct("name", "path", "line", "attrs")
        version = lambda v: F.first(F.when(F.col("snapshot_id") == v, fields), ignorenulls=True)
        # The number is sorted by first: it settles nearly all comparisons of the identity.
        rows = facts.where(F.col("snapshot_id").isin(*number)).withColumn("__h", F.xxhash64("kind", "key"))
        rows = rows.groupBy("__h", "kind", "key").agg(*[version(v).alias(c) for v, c in number.items()])
    if sizes is not None and not declared:
        rows = rows.observe(sizes, *[F.count_if(F.col(c).isNotNull()).alias(v) for v, c in number.items()])
    sides = F.array(*[F.struct(F.lit(p).alias("pair_id"), F.col(number[a]).alias("o"), F.col(number[b]).alias("n")) for p, a, b in some])
    out = rows.select("kind", "key", F.explode(F.filter(sides, lambda x: x["o"].isNotNull() | x["n"].isNotNull())).alias("p"))
    return out.select("p.pair_id", "kind", "key", "p.o", "p.n")


def resolve_gates(rows: DataFrame, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``reachable`` to added and removed web-API rows: can a page reach it, on the side it is on.

    The first gate that is not stable, or unknown, decides; own gate before the interface's.
    Flags and gated interfaces of a pair are joined by name; Spark broadcasts them if small.
    """
    status = facts.where("kind = 'blink_runtime_feature'").select("snapshot_id", F.col("key").alias("gate"), our_status("attrs").alias("state"))
    gated = F.coalesce(F.get_json_object(attr("attrs", "ext"), "$.RuntimeEnabled"), F.lit(""))
    interfaces = facts.where("kind = 'idl_interface'").select("snapshot_id", F.col("key").alias("interface"), gated.alias("outer_gate")).where("outer_gate != ''")
    side = F.when(F.col("n").isNull(), F.col("from_id")).otherwise(F.col("to_id"))
    attrs = F.coalesce(F.col("n.attrs"), F.col("o.attrs"))
    web = F.col("kind").isin("idl_member", "idl_interface") & (F.col("n").isNull() | F.col("o").isNull())
    own = F.when(F.col("kind") == "idl_interface", F.coalesce(F.get_json_object(attr(attrs, "ext"), "$.RuntimeEnabled"), F.lit(""))).otherwise(attr_text(attrs, "runtime_enabled"))
    # Only rows that have a gate to look up are joined: no null key gathers the rest in one task.
    some = rows.where(web).join(F.broadcast(pairs), "pair_id").withColumns({"side": side, "own_gate": own, "interface": F.when(F.col("kind") == "idl_member", attr_text(attrs, "interface")).otherwise("")})
    out = some.join(interfaces.withColumnRenamed("snapshot_id", "side"), ["side", "interface"], "left")
    for name in ("own", "outer"):
        states = status.select(F.col("snapshot_id").alias("side"), F.col("gate").alias(f"{name}_gate"), F.col("state").alias(f"{name}_state"))
        out = out.join(states, ["side", f"{name}_gate"], "left")
    verdict = lambda gate, state: F.when(F.coalesce(gate, F.lit("")) == "", F.lit("open")).when(state.isNull(), "unknown").when(state == "stable", "open").otherwise("closed")
    first = verdict(F.col("own_gate"), F.col("own_state"))
    second = verdict(F.col("outer_gate"), F.col("outer_state"))
    decided = F.when(first != "open", first).otherwise(second)
    known = out.select(*rows.columns, F.when(decided == "open", True).when(decided == "closed", False).alias("reachable"))
    return rows.where(~web).withColumn("reachable", F.lit(None).cast("boolean")).unionByName(known)


def diff_snapshots(facts: DataFrame, pairs: DataFrame, target_milestone: int | None = None, declared: bool = False) -> DataFrame:
    """J1 to J4 and the signals: changes of every pair, before renames and repoints are paired. ``declared`` as in ``join_pair``."""
    return _changes(_moved(facts, pairs, declared), facts, pairs, target_milestone, declared)


def _moved(facts: DataFrame, pairs: DataFrame, declared: bool, sizes: Observation | None = None) -> DataFrame:
    """The joined rows whose sides are not equal, with their direction and what moved, written.

    Most facts stay as they are: what is equal entry by entry goes before anything is worked out for
    it. Gates are looked up for some of these rows; written once, neither the join nor the deltas are
    repeated for the others. The attributes that are compared are worked out a step before the deltas, which read them many times.
    """
    equal = F.map_entries("o.attrs").eqNullSafe(F.map_entries("n.attrs")) & F.col("o.path").eqNullSafe(F.col("n.path"))
    rows = join_pair(facts, pairs, declared, sizes).where(F.col("o").isNull() | F.col("n").isNull() | ~equal)
    kind_of = F.when(F.col("o").isNull(), rules.ADDED).when(F.col("n").isNull(), rules.REMOVED).otherwise(rules.MODIFIED)
    both = lambda c: F.when(F.col("change_type") == rules.MODIFIED, meaningful(F.col("__names"), F.col(f"{c}.attrs")))
    sides = rows.withColumns({"change_type": kind_of, "__names": lookup(rules.MEANINGFUL, F.col("kind"))}).withColumns({"__b": both("o"), "__a": both("n")})
    deltas = F.when(F.col("change_type") == rules.MODIFIED, attr_deltas(F.col("__b"), F.col("__a"), F.col("o.path"), F.col("n.path"))).otherwise(F.array().cast(_DELTAS))
    return stored(sides.withColumn("deltas", deltas).drop("__names", "__b", "__a"), "joined")


def _changes(joined: DataFrame, facts: DataFrame, pairs: DataFrame, target_milestone: int | None, declared: bool) -> DataFrame:
    rows = joined.where((F.col("change_type") != rules.MODIFIED) | (F.size("deltas") > 0))
    if declared:
        facts = stored(dedupe_facts(facts.where(F.col("kind").isin(*GATES))), "gates")
    rows = resolve_gates(rows, facts, pairs)
    paths = F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array("o.path", "n.path")), lambda p: p != "")))
    flat = rows.select(
        "pair_id", "change_type", "kind", "key", F.coalesce("n.name", "o.name").alias("name"), F.col("o.attrs").alias("before"), F.col("n.attrs").alias("after"),
        "deltas", paths.alias("paths"), locations("o", "n").alias("locations"), "reachable",
    )
    return with_signals(flat, target_milestone).drop("reachable")


def _anchor(renames: bool, repoints: bool) -> Column:
    """What ties a removed to an added row: the identifier of a preference, switch or flag, the place of a control; null for other rows.

    A kind has one of the two, so that both are paired in one pass.
    """
    attrs = F.when(F.col("change_type") == rules.ADDED, F.col("after")).otherwise(F.col("before"))
    one_sided = F.col("change_type").isin(rules.ADDED, rules.REMOVED)
    var, ident = attr_text(attrs, "var"), F.when(attr_text(attrs, "element_id") != "", attr_text(attrs, "element_id")).otherwise(attr_text(attrs, "label"))
    place = F.to_json(F.struct(attr_text(attrs, "surface").alias("s"), attr_text(attrs, "page").alias("p"), ident.alias("i")))
    named = F.lit(renames) & F.col("kind").isin(*rules.RENAMES) & (var != "")
    return F.when(one_sided & named, var).when(one_sided & F.lit(repoints) & (F.col("kind") == rules.CONTROL) & (ident != ""), place)


def detect_moves(changes: DataFrame, renames: bool = True, repoints: bool = True) -> DataFrame:
    """A removed and an added row that are alone with one another under their anchor become one modified row.

    Renames: a kind and ``var``, the name ``old -> new``, the delta ``value``. Repoints: a control's
    surface, page and element id or label, where the preferences differ. Anchors are counted
    on their keys alone, so that a common one never meets itself in a join; wide rows are fetched last, and only those of
    pairs. Rows without an anchor pass by all joins.
    """
    marked = changes.withColumn("__anchor", _anchor(renames, repoints))
    sided = marked.where(F.col("__anchor").isNotNull())
    added = F.col("change_type") == rules.ADDED
    alone = (
        sided.select("pair_id", "kind", "__anchor", "change_type", "key")
        .groupBy("pair_id", "kind", "__anchor")
        .agg(F.count_if(added).alias("n_added"), F.count_if(~added).alias("n_removed"), F.min(F.when(added, F.col("key"))).alias("ak"), F.min(F.when(~added, F.col("key"))).alias("rk"))
        .where("n_added = 1 and n_removed = 1")
    )
    wide = F.struct("key", "name", "before", "after", "paths", "locations")
    side = lambda t, k, c: sided.where(F.col("change_type") == t).select("pair_id", "kind", F.col("key").alias(k), wide.alias(c))
    pairs = alone.join(side(rules.REMOVED, "rk", "r"), ["pair_id", "kind", "rk"]).join(side(rules.ADDED, "ak", "a"), ["pair_id", "kind", "ak"])
    old, new, control = F.col("r.before"), F.col("a.after"), F.col("kind") == rules.CONTROL
    pairs = stored(pairs.select("pair_id", "kind", "r", "a").where(~control | (attr_text(old, "pref") != attr_text(new, "pref"))), "pairs")
    used = pairs.select("pair_id", "kind", F.explode(F.array("r.key", "a.key")).alias("key")).distinct()
    rest = marked.where(F.col("__anchor").isNull()).unionByName(sided.join(used, ["pair_id", "kind", "key"], "left_anti")).drop("__anchor")
    moved = lambda a: F.when((F.lit(a) == "pref") | ~attr(old, a).eqNullSafe(attr(new, a)), F.struct(F.lit(a).alias("attr"), attr(old, a).alias("old"), attr(new, a).alias("new")))
    value = F.array(F.struct(F.lit("value").alias("attr"), F.col("r.key").alias("old"), F.col("a.key").alias("new"))).cast(_DELTAS)
    retyped = F.when(~attr(old, "control").eqNullSafe(attr(new, "control")), F.lit("ui_control_type_changed"))
    merged = pairs.select(
        "pair_id", F.lit(rules.MODIFIED).alias("change_type"), "kind", F.col("r.key").alias("key"),
        F.when(control, F.concat_ws(" -> ", "r.name", "a.name")).otherwise(F.concat_ws(" -> ", "r.key", "a.key")).alias("name"), old.alias("before"), new.alias("after"),
        F.when(control, F.array_compact(F.array(moved("control"), moved("label"), moved("pref"))).cast(_DELTAS)).otherwise(value).alias("deltas"),
        F.array_sort(F.array_union("r.paths", "a.paths")).alias("paths"), F.array_distinct(F.concat("r.locations", "a.locations")).alias("locations"),
        F.when(control, F.array_compact(F.array(F.lit("ui_control_repointed"), retyped))).otherwise(F.array(lookup(rules.RENAMES, F.col("kind")))).alias("signals"),
    ).withColumn("severity", severity_of())
    return rest.unionByName(merged.select(*changes.columns))


def detect_renames(changes: DataFrame) -> DataFrame:
    """One removed and one added row of a kind with the same ``var`` become one modified row. See ``detect_moves``."""
    return detect_moves(changes, repoints=False)


def detect_repoints(changes: DataFrame) -> DataFrame:
    """A removed and an added control on one anchor that write different preferences become one modified row. See ``detect_moves``."""
    return detect_moves(changes, renames=False)


def comparable(headers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the reason for which they can't be compared; null if they can."""
    key = F.struct("target_set", F.coalesce("partitions", F.array().cast("array<string>")).alias("partitions"), F.coalesce("complete", F.lit(False)).alias("complete"))
    side = lambda c: headers.select(F.col("snapshot_id").alias(c), key.alias(f"{c}_set"))
    rows = pairs.join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left")
    reason = F.when(~F.col("from_id_set").eqNullSafe(F.col("to_id_set")), "built from different target sets")
    return rows.select("pair_id", "from_id", "to_id", reason.alias("reason"))


def lopsided(facts: DataFrame, pairs: DataFrame, least: int = 500, ratio: float = 0.5) -> DataFrame:
    """Pairs whose sides' sizes make a comparison meaningless, with the reason; null if they don't."""
    return _lopsided(facts.groupBy("snapshot_id").agg(F.count("*").alias("n")), pairs, least, ratio)


def _lopsided(sizes: DataFrame, pairs: DataFrame, least: int = 500, ratio: float = 0.5) -> DataFrame:
    """J13 from (snapshot_id, n)."""
    side = lambda c: sizes.select(F.col("snapshot_id").alias(c), F.col("n").alias(f"{c}_n"))
    rows = pairs.join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left").na.fill(0, ["from_id_n", "to_id_n"])
    low, high = F.least("from_id_n", "to_id_n"), F.greatest("from_id_n", "to_id_n")
    reason = F.when((high >= least) & (low == 0), "one side is empty").when((high >= least) & (low < ratio * high), "one side is less than half of the other")
    return rows.select("pair_id", F.col("from_id_n").alias("from_facts"), F.col("to_id_n").alias("to_facts"), reason.alias("reason"))


def compare(facts: DataFrame, headers: DataFrame | None, pairs: DataFrame, target_milestone: int | None = None, declared: bool = False) -> DataFrame:
    """Changes of all comparable pairs, with renames and repoints paired.

    With ``declared`` the facts are raw declarations. They are then read and shuffled once: first
    ones, versions and the snapshots' sizes come from one pass, after which lopsided pairs are left out.
    """
    some = pairs
    if headers is not None:
        some = some.join(comparable(headers, pairs).where("reason is null").select("pair_id"), "pair_id", "left_semi")
    even = lambda sizes: some.join(sizes.where("reason is null").select("pair_id"), "pair_id", "left_semi")
    if declared:
        seen = Observation()
        moved = _moved(facts, some, True, seen)
        counts = seen.get if some.limit(1).count() else {}
        some = even(_lopsided(facts.sparkSession.createDataFrame(list(counts.items()), "snapshot_id string, n long"), some))
        moved = moved.join(F.broadcast(some.select("pair_id")), "pair_id", "left_semi").select(*moved.columns)
    else:
        some = even(lopsided(facts, some))
        moved = _moved(facts, some, False)
    # Pairing reads the changes several times; written once, the join isn't repeated.
    changes = stored(_changes(moved, facts, some, target_milestone, declared), "changes")
    return detect_moves(changes)


def rank_changes(changes: DataFrame) -> DataFrame:
    """Changes with their place within the pair: severity descending, kind, key."""
    return placed(changes, ["pair_id"], [F.desc("severity"), F.col("kind"), F.col("key")], name="rank")
