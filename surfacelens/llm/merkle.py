"""Merkle manifests: a tree of digests over each group's rows in order, and one over the groups.

Nodes of a level are numbered from 0 within their group; ``FAN`` consecutive ones are a run, whose
digest is their parent. A level is one equi-join of nodes with their siblings' computed indices
(the slot shifted by 1 to ``FAN`` - 1 within the run); slot-zero rows then emit the parents. Both
sides share one shuffle by (group, run), as the slot's condition stays out of the shuffle's key.
All is DataFrame functions; digests are lowercase hex text, and inputs of a digest are concatenated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import placed
from .common import stored

FAN = 16
_STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """H: lowercase hex SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(*columns: str | Column) -> Column:
    """The digest of a row's fields: '-' for null, else the UTF-8 byte count, ':' and the value."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in columns]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def with_siblings(some: DataFrame, level: DataFrame) -> DataFrame:
    """``some`` nodes (g, at, hash, ...) of a level with ``left`` and ``right``: their siblings' digests, each in order, concatenated."""
    n = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed_ = lambda rows: rows.withColumn("run", F.expr(f"at div {FAN}")).repartition(n, "g", "run")
    slot = F.col("at") - F.col("run") * FAN
    looking = placed_(some).withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(FAN - 1)))).withColumn("wanted", F.col("run") * FAN + (slot + F.col("shift")) % FAN)
    there = placed_(level.select("g", "at", "hash")).select(F.col("g").alias("g2"), F.col("run").alias("run2"), F.col("at").alias("sibling"), F.col("hash").alias("other"))
    met = looking.join(there, (F.col("g") == F.col("g2")) & (F.col("run") == F.col("run2")) & (F.col("sibling") - F.col("wanted") == 0), "left")
    rest = [c for c in some.columns if c not in ("g", "at")]
    found = met.groupBy("g", "run", "at").agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.when(F.col("sibling").isNotNull(), F.struct("sibling", "other")))).alias("__s"))
    side = lambda keep: F.array_join(F.transform(F.filter("__s", keep), lambda x: x["other"]), "")
    return found.select("g", "at", "run", *rest, side(lambda x: x["sibling"] < F.col("at")).alias("left"), side(lambda x: x["sibling"] > F.col("at")).alias("right"))


def _alone(at: Column, left: Column, right: Column) -> Column:
    """A group's only node: it goes up as it is."""
    return (at == 0) & (left == "") & (right == "")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """(g, at, hash) of every level from the leaves on, until each group has one node: its root.

    A run is digested also where it is the last and has one node; only a group that has just one
    node passes it on unchanged, up to the level at which the largest group ends.
    """
    out = [leaves]
    while (out[-1].agg(F.max("at")).first()[0] or 0) > 0:  # one number a level
        first = with_siblings(out[-1].select("g", "at", "hash").where(F.col("at") % FAN == 0), out[-1])
        parent = F.when(_alone(F.col("at"), F.col("left"), F.col("right")), F.col("hash")).otherwise(digest(F.concat("hash", "right")))
        out.append(stored(first.select("g", F.col("run").alias("at"), parent.alias("hash")), "level"))
    return out


def _steps(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes of a level with ``proof``: their own siblings, then what ``above`` (g, at, proof, ...) has for their parent."""
    some = with_siblings(level, level)
    own = F.when(_alone(F.col("at"), F.col("left"), F.col("right")), F.array().cast(_STEP)).otherwise(F.array(F.struct("left", "right"))).cast(_STEP)
    rows = some.withColumn("own", own).drop("left", "right")
    if above is None:
        return rows.drop("run").withColumnRenamed("own", "proof")
    extra = [c for c in above.columns if c not in ("g", "at", "proof")]
    top = above.select(F.col("g").alias("g2"), F.col("at").alias("at2"), F.col("proof").alias("rest"), *extra)
    met = rows.join(top, (F.col("g") == F.col("g2")) & (F.col("run") == F.col("at2")))
    return met.withColumn("proof", F.concat("own", "rest")).drop("own", "rest", "g2", "at2", "run")


def _group(name: str) -> Column:
    """A group's key: null is one of its own, before all others in byte order."""
    return F.coalesce(F.concat(F.lit("1"), F.col(f"`{name}`").cast("string")), F.lit("0"))


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels of the groups' trees, levels of the tree over their roots) of ``rows`` with a digest ``leaf`` each.

    Within a group leaves ascend by ``order`` (null first), equal ones by digest; repeated rows are
    leaves each. Groups ascend by their text in bytes, null first. The leaves keep all other
    columns of ``rows``. An empty table has empty levels and no root.
    """
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), _group(group).alias("g"), F.col(f"`{leaf}`").alias("hash"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    numbered = placed(stored(keyed, "leaves"), ["g"], [*(f"o{i}" for i in range(len(order))), "hash"])
    numbered = stored(numbered.select("g", (F.col("place") - 1).alias("at"), "hash", "row"), "level")
    lower = levels(numbered)
    roots = placed(lower[-1].select(F.lit("").alias("all"), "g", "hash"), ["all"], ["g"])
    upper = levels(stored(roots.select(F.lit("").alias("g"), (F.col("place") - 1).alias("at"), "hash", F.col("g").alias("of")), "level"))
    return lower, upper


def prove(rows: DataFrame, group: str, order: list[str], leaf: str) -> DataFrame:
    """``rows`` with ``proof`` (steps of siblings to the left and right, from the leaf to the root), ``subroot`` and ``root``.

    See ``manifest`` for order, nulls and repeated rows. A level at which a node has no siblings
    because it is its group's only one is no step. Proofs of upper levels are worked out once a
    node and met by the rows below it; the rows themselves are shuffled by their run alone, so a
    group of any size is spread. Columns of ``rows`` called like the results give way to them.
    """
    lower, upper = manifest(rows, group, order, leaf)
    above = None
    for level in reversed(upper):
        above = _steps(level, above)
        if level is not upper[0]:
            above = stored(above.select("g", "at", "proof"), "proofs")
    root = upper[-1].select(F.col("hash").alias("root"))  # one row
    above = stored(above.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("at"), "proof", F.col("hash").alias("subroot")).join(F.broadcast(root)), "proofs")
    above = _below_root(lower[-1], above)
    for level in reversed(lower[:-1]):
        above = _steps(level, stored(above.select("g", "at", "proof", "subroot", "root"), "proofs"))
    done = above
    kept = [c for c in rows.columns if c not in ("proof", "subroot", "root")]
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "proof", "subroot", "root")


def _below_root(level: DataFrame, above: DataFrame) -> DataFrame:
    """The groups' roots with what lies above them: they have no siblings of their own."""
    top = above.select(F.col("g").alias("g2"), "proof", "subroot", "root")
    return level.join(top, F.col("g") == F.col("g2")).drop("g2")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))
