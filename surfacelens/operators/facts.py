"""Facts of a snapshot: one row per identity, overload sets, platform stamps and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import attr, attr_text, location, other_platform_dir, packed, text_of, unpacked

KEY = ("snapshot_id", "kind", "key")
#: Only these declare several argument lists under one identity.
OVERLOADED = "idl_member"
_OVERLOAD_ATTRS = ("signatures", "overload_traits", "overload_locations")


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _not_compiled(attrs: Column) -> Column:
    """The attributes with the platform's state merged in: not compiled."""
    state = F.coalesce(F.from_json(attr(attrs, "platform_state"), "map<string,string>"), _empty_map())
    rest = F.map_filter(state, lambda k, _: k != rules.PLATFORM)
    merged = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(rest, F.create_map(F.lit(rules.PLATFORM), F.lit("not_compiled")))))))
    return F.map_concat(F.map_filter(attrs, lambda k, _: k != "platform_state"), F.create_map(F.lit("platform_state"), merged))


def _declaration(facts: DataFrame) -> Column:
    """A declaration in the order of one identity's: path, line, name, attributes entry by entry; so no result depends on partitioning.

    The least one is the first, and is all that is sent: the attributes are one text, a quarter of their map's size. Facts that
    have this text already (a column ``packed``) are not read as maps.
    """
    return F.struct("path", "line", "name", (F.col("packed") if "packed" in facts.columns else packed("attrs")).alias("attrs"))


def stamp_platform_dirs(facts: DataFrame) -> DataFrame:
    """Facts all of whose declarations lie in another platform's directory are not compiled for us.

    The state is merged into what the fact says of other platforms.
    """
    elsewhere = F.bool_and(other_platform_dir(F.col("path"))).over(Window.partitionBy(*KEY))
    return facts.withColumn("__e", F.coalesce(elsewhere, F.lit(False))).withColumn("attrs", F.when(F.col("__e"), _not_compiled(F.col("attrs"))).otherwise(F.col("attrs"))).drop("__e")


def _overloads(facts: DataFrame) -> DataFrame:
    """A2 to A4: (snapshot_id, key, added): the overload attributes of members with several argument lists or traits."""
    # Equal declarations, of which a member may have very many, are sent once, and read after that. The count keeps Spark from leaving this step out.
    members, said = facts.where(F.col("kind") == OVERLOADED), (attr("attrs", "signature").alias("s"), attr("attrs", "runtime_enabled").alias("r"), attr("attrs", "ext").alias("e"))
    once = lambda *names: members.groupBy("snapshot_id", "key", *names, "path", "line").agg(F.count("*").alias("n")).where("n > 0")
    if "packed" in facts.columns:
        said = once("packed").withColumn("attrs", unpacked(F.col("packed"))).select("snapshot_id", "key", *said, "path", "line")
    else:
        said = once(*said)
    text = lambda c: F.coalesce(text_of(F.col(c)), F.lit(""))
    ext = F.coalesce(F.from_json("e", "map<string,string>"), _empty_map())
    traits = F.array_sort(F.transform(F.map_entries(ext), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))))
    rows = said.select("snapshot_id", "key", text("s").alias("sig"), text("r").alias("gate"), F.array_join(traits, ", ").alias("ext"), location(F.col("path"), F.col("line")).alias("place"))
    sets = rows.where("sig != ''").groupBy("snapshot_id", "key").agg(F.collect_set(F.struct("sig", "gate", "ext", "place")).alias("o"), F.max(F.lit(OVERLOADED)).alias("kind"))
    signatures = F.array_sort(F.array_distinct(F.transform("o", lambda x: x["sig"])))
    kinds = F.array_distinct(F.transform("o", lambda x: F.struct(x["gate"], x["ext"])))
    label = lambda x: F.concat(x["sig"], F.lit(" ["), F.when(x["gate"] == "", "ungated").otherwise(x["gate"]), F.when(x["ext"] == "", "").otherwise(F.concat(F.lit("; "), x["ext"])), F.lit("]"))
    several = F.size(signatures) > 1
    added = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(several, F.struct(F.lit("signatures"), F.to_json(signatures))),
                F.when(F.size(kinds) > 1, F.struct(F.lit("overload_traits"), F.to_json(F.array_sort(F.transform("o", label))))),
                F.when(several, F.struct(F.lit("overload_locations"), F.to_json(F.array_sort(F.transform("o", lambda x: F.concat_ws(" @ ", x["sig"], x["place"])))))),
            )
        )
    )
    # The kind comes from the aggregation: were it a constant, joins would be on the key alone, and all facts shuffled again for it.
    return sets.select("snapshot_id", "kind", "key", added.alias("added"))


def _fresh(attrs: Column, elsewhere: Column, added: Column) -> Column:
    """The attributes of a first declaration with the platform stamp and the overload attributes."""
    stamped = F.when(F.coalesce(elsewhere, F.lit(False)), _not_compiled(attrs)).otherwise(attrs)
    rest = F.map_filter(stamped, lambda k, _: ~k.isin(*_OVERLOAD_ATTRS))
    return F.when(added.isNull(), stamped).otherwise(F.map_concat(rest, added))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first declaration of each identity, with the platform stamp of all and the overload attributes.

    One aggregation picks the first declaration and sees whether all lie elsewhere. It runs on
    every partition before the one shuffle by identity, so an identity that much of the table
    declares sends a row a partition. Overload sets are gathered of web members alone,
    from a few narrow columns.
    """
    rows = facts.select(*KEY, _declaration(facts).alias("d"), other_platform_dir(F.col("path")).alias("__o"))
    first = rows.groupBy(*KEY).agg(F.min("d").alias("f"), F.bool_and("__o").alias("__e"))
    out = first.select(*KEY, "f.name", "f.path", "f.line", unpacked(F.col("f.attrs")).alias("attrs"), "__e").join(_overloads(facts), [*KEY], "left")
    return out.select(*KEY, "name", "path", "line", _fresh(F.col("attrs"), F.col("__e"), F.col("added")).alias("attrs"))


def versions_of(facts: DataFrame, names: dict[str, str], sizes: Observation | None = None) -> DataFrame:
    """``dedupe_facts`` of raw declarations with all snapshots of an identity in one row: kind, key and a struct for each of ``names`` (snapshot to column).

    One aggregation over (kind, key), run on every partition before its one shuffle: an identity's
    versions in one partition are sent as one row. With ``sizes``, which takes in each snapshot's
    number of facts, identities whose versions are all there and the same in path and attributes are left out.
    """
    at = lambda v, x: F.when(F.col("snapshot_id") == v, x)
    rows = facts.where(F.col("snapshot_id").isin(*names)).select(*KEY, _declaration(facts).alias("d"), other_platform_dir(F.col("path")).alias("__o"))
    first = rows.groupBy("kind", "key").agg(*[x for v, c in names.items() for x in (F.min(at(v, F.col("d"))).alias(c), F.bool_and(at(v, F.col("__o"))).alias(f"{c}e"))])
    added = _overloads(facts).groupBy("kind", "key").agg(*[F.first(at(v, F.col("added")), ignorenulls=True).alias(f"{c}a") for v, c in names.items()])
    out = first.join(added, ["kind", "key"], "left")
    if sizes is not None:
        out = out.observe(sizes, *[F.count_if(F.col(c).isNotNull()).alias(v) for v, c in names.items()])
        some, differ = list(names.values()), F.lit(len(names) < 2)
        for c in some:
            differ |= F.col(c).isNull()
            for what in (lambda x: F.col(f"{x}.path"), lambda x: F.col(f"{x}.attrs"), lambda x: F.col(f"{x}e"), lambda x: F.map_entries(F.col(f"{x}a"))):
                differ |= ~what(c).eqNullSafe(what(some[0]))
        out = out.where(differ)
    one = lambda c: F.struct(F.col(f"{c}.name"), F.col(f"{c}.path"), F.col(f"{c}.line"), _fresh(unpacked(F.col(f"{c}.attrs")), F.col(f"{c}e"), F.col(f"{c}a")).alias("attrs"))
    return out.select("kind", "key", *[F.when(F.col(c).isNotNull(), one(c)).alias(c) for c in names.values()])


def keep_lowest(facts: DataFrame) -> DataFrame:
    """A1 alone: the first declaration of each identity, found on every partition before the one shuffle."""
    first = facts.groupBy(*KEY).agg(F.min(_declaration(facts)).alias("f"))
    return first.select(*KEY, "f.name", "f.path", "f.line", unpacked(F.col("f.attrs")).alias("attrs"))


def first_places(facts: DataFrame) -> DataFrame:
    """Path of the first declaration of each identity: what ``dedupe_facts`` gives as its path, without the other columns."""
    return facts.groupBy(*KEY).agg(F.min(F.struct("path")).alias("f")).select(*KEY, "f.path")


def count_by_kind(facts: DataFrame) -> DataFrame:
    """A5."""
    return facts.groupBy("snapshot_id", "kind").agg(F.count("*").alias("n_facts"))


def member_position(members: DataFrame) -> DataFrame:
    """Zero-based place of each member among its declaration's, by offset; only of stable declarations."""
    place = F.row_number().over(Window.partitionBy("snapshot_id", "declaration").orderBy("offset", "member")) - 1
    return members.withColumn("position", F.when(F.col("stable"), place))


def occurrence_index(elements: DataFrame) -> DataFrame:
    """W3: 'tag#n' of the n-th element of a tag in a file that has no other identity."""
    n = F.row_number().over(Window.partitionBy("snapshot_id", "path", "tag").orderBy("offset")) - 1
    return elements.where("identity = ''").withColumn("identity", F.concat_ws("#", "tag", n.cast("string")))


def interface_shape(facts: DataFrame) -> DataFrame:
    """Members of each interface and struct: how many, and their names in order."""
    owner = F.when(F.col("kind") == "mojo_method", attr_text("attrs", "interface")).when(F.col("kind") == "mojo_field", attr_text("attrs", "struct"))
    rows = facts.where(F.col("kind").isin("mojo_method", "mojo_field")).withColumn("owner", owner)
    return rows.groupBy("snapshot_id", "kind", "owner").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("name")).alias("members"))
