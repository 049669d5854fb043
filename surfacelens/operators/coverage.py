"""Paths: routing to extractors, scopes and what of a listing was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.columns import any_of, base_name, coverage_percent, literal_map, other_platform_dir, skip_reason, unix
from .ranking import placed

_SOURCE = r"\.(cc|h)$"


def _holds(name: Column, parts: tuple[str, ...]) -> Column:
    return name.rlike(any_of(parts))


def _routes() -> dict[str, tuple[str, Column]]:
    """Extractors with the surface they read and which files (by the column ``path``)."""
    path, name = unix(F.col("path")), base_name(F.col("path"))
    source = name.rlike(_SOURCE)
    return {
        "base_features": ("feature flags", source & _holds(name, rules.FEATURE_FILES) & ~_holds(name, rules.FEATURE_TEST_FILES)),
        "blink_runtime": ("web platform flags", name == rules.RUNTIME_FLAGS_FILE),
        "web_idl": ("web API definitions", path.endswith(".idl") & path.startswith(rules.WEB_IDL)),
        "mojom": ("process-boundary interfaces", path.endswith(".mojom")),
        "constants": ("preference keys and switches", source & _holds(name, (*rules.SWITCH_FILES, *rules.PREF_FILES))),
        "flags_metadata": ("chrome://flags entries", name == rules.FLAG_METADATA_FILE),
        "webui_routes": ("chrome:// routes", path.startswith(rules.RESOURCES) & name.isin(*rules.ROUTE_FILES)),
        "webui_controls": ("chrome:// controls", path.startswith(rules.RESOURCES) & path.rlike(r"\.html(\.ts)?$")),
        "webui_gates": ("chrome:// visibility gates", path.startswith(rules.HANDLERS) & path.endswith(".cc")),
    }


#: Routes that a caller adds: name to (surface, condition on the column ``path``).
ADDED_ROUTES: dict[str, tuple[str, Column]] = {}
CROSS_PLATFORM_EXTRACTOR = "constants"


def extractors_of(path: Column, added: dict[str, tuple[str, Column]] | None = None) -> Column:
    """names of the extractors that read the file of the column ``path``; ``added`` are routes besides the library's own (else those registered)."""
    some = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, (_, rule) in (_routes() | (ADDED_ROUTES if added is None else added)).items()]))
    elsewhere = unix(path).rlike("(^|/)" + any_of(rules.CONSTANTS_ONLY) + "(/|$)")
    return F.when(elsewhere, F.filter(some, lambda x: x == CROSS_PLATFORM_EXTRACTOR)).otherwise(some)


def surfaces_of(path: Column) -> Column:
    """Surfaces whose extractors read a file."""
    names = literal_map({k: s for k, (s, _) in (_routes() | ADDED_ROUTES).items()})
    return F.transform(extractors_of(path), lambda x: F.element_at(names, x))


def in_scope(paths: DataFrame) -> DataFrame:
    """paths of product sources."""
    return paths.where(skip_reason(F.col("path")) == "")


def route_files(paths: DataFrame, added: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """a row for each extractor that reads a file."""
    return paths.withColumn("extractor", F.explode(extractors_of(F.col("path"), added)))


def could_declare(paths: DataFrame, all_platforms: bool = False) -> DataFrame:
    """product files of our platform that some extractor reads, with their surfaces."""
    rows = in_scope(paths).withColumn("surfaces", surfaces_of(F.col("path"))).where(F.size("surfaces") > 0)
    return rows if all_platforms else rows.where(~other_platform_dir(F.col("path")))


def _folder(path: Column) -> Column:
    """A tree's path with one slash at its end; the whole tree's is empty."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("/")))


def _levels(scope: DataFrame) -> tuple[DataFrame, list[int]]:
    """(a row for each snapshot and tree with its suffixes, null for all; the depths at which there are trees)."""
    trees = scope.where("is_tree").select("snapshot_id", _folder(F.col("path")).alias("tree"), "suffixes")
    rows = trees.groupBy("snapshot_id", "tree").agg(F.max(F.col("suffixes").isNull()).alias("all"), F.flatten(F.collect_set("suffixes")).alias("some"))
    rows = rows.select("snapshot_id", "tree", (F.length("tree") - F.length(F.replace("tree", F.lit("/"), F.lit("")))).alias("depth"), F.struct(F.when(~F.col("all"), F.col("some")).alias("suffixes")).alias("hit"))
    return rows, sorted(r[0] for r in rows.select("depth").distinct().collect())  # as many as levels of folders


def marked(paths: DataFrame, scope: DataFrame, name: str) -> DataFrame:
    """``paths`` with whether a scope row of their snapshot names them or lies over them (all that do are tried).

    A path is looked up by each of its folders at the depths at which the scope has trees: as many
    hash lookups as levels, whatever the scope's length. The scope has a row a target and is
    broadcast; paths don't move and no row is repeated.
    """
    trees, depths = _levels(scope)
    columns, reached = [F.col(f"`{c}`") for c in paths.columns], F.lit(False)
    files = scope.where("not is_tree").select(F.col("snapshot_id").alias("__s"), F.col("path").alias("__p")).distinct().withColumn("__f", F.lit(True))
    out = paths.join(F.broadcast(files), (F.col("snapshot_id") == F.col("__s")) & (F.col("path") == F.col("__p")), "left").drop("__s", "__p")
    for d in depths:
        over = F.concat(F.substring_index("path", "/", d), F.lit("/")) if d else F.lit("")
        some = trees.where(F.col("depth") == d).select(F.col("snapshot_id").alias("__s"), F.col("tree").alias("__p"), F.col("hit").alias(f"__h{d}"))
        out = out.join(F.broadcast(some), (F.col("snapshot_id") == F.col("__s")) & (over == F.col("__p")), "left").drop("__s", "__p")
        hit = F.col(f"__h{d}")
        fits = hit["suffixes"].isNull() | F.exists(hit["suffixes"], lambda x: F.endswith(F.col("path"), x))
        reached = reached | (hit.isNotNull() & F.startswith(F.col("path"), over) & fits)
    return out.select(*columns, (F.coalesce("__f", F.lit(False)) | F.coalesce(reached, F.lit(False))).alias(name))


def reaches(paths: DataFrame, scope: DataFrame, how: str = "left_semi") -> DataFrame:
    """paths that a scope row of their snapshot names or lies over; with 'left_anti' those none does. See ``marked``."""
    hit = F.col("__reached")
    return marked(paths, scope, "__reached").where(~hit if how == "left_anti" else hit).drop("__reached")


def absent_targets(scope: DataFrame, paths: DataFrame) -> DataFrame:
    """Scope rows that no path is, or lies below.

    The scope has a row a target and is broadcast; of the paths' folders only those that it names are kept and
    made distinct, so that no more rows than targets come back, whatever the number of paths or Spark's guess of it.
    """
    place = F.when(F.col("is_tree"), _folder(F.col("path"))).otherwise(F.col("path"))
    folders = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(folders) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(folders, F.lit(1), k), "/"), F.lit("/"))))
    every = paths.select("snapshot_id", F.explode(F.concat(above, F.array("path"))).alias("__place"))
    asked = scope.select("snapshot_id", place.alias("__place"))
    there = every.join(F.broadcast(asked), ["snapshot_id", "__place"], "left_semi").distinct()
    return scope.withColumn("__place", place).join(there, ["snapshot_id", "__place"], "left_anti").drop("__place")


def partition_scope(scope: DataFrame, partitions: DataFrame, names: list[str]) -> DataFrame:
    """F8: scope rows whose path starts with a prefix of the named partitions or of the core that is always kept.

    ``partitions`` (name, prefix) is a short list, as the scope is, and is broadcast.
    """
    some = partitions.where(F.col("name").isin(*names, "core")).select("prefix")
    return scope.alias("s").join(F.broadcast(some).alias("p"), F.startswith(F.col("s.path"), F.col("p.prefix")), "left_semi")


def complete_scope(partitions: DataFrame, names: list[str]) -> DataFrame:
    """(path, is_tree, suffixes): all readable files below the roots of the named partitions, and the core's files.

    ``partitions`` has name, prefix and closable. A root that names a file (its last part has a dot)
    stays one; below the handlers' root sources are read too. Partitions that are not closable, or
    unknown, are refused.
    """
    some = partitions.where(F.col("name").isin(*names, "core"))
    known = {r["name"]: r["closable"] for r in some.select("name", "closable").distinct().collect()}  # as many as names
    bad = sorted(n for n in names if not known.get(n))
    if bad:
        raise ValueError(f"these partitions can't be read whole: {', '.join(bad)}")
    root = F.regexp_replace("prefix", "/+$", "")
    is_file = F.substring_index("root", "/", -1).contains(".") | (F.col("name") == "core")
    handlers = rules.HANDLERS.rstrip("/")
    below = (F.col("root") == handlers) | F.startswith("root", F.lit(handlers + "/"))
    suffixes = F.when(below, F.array(*map(F.lit, (*rules.READABLE, ".cc")))).otherwise(F.array(*map(F.lit, rules.READABLE)))
    rows = some.withColumn("root", root).groupBy("root").agg(F.min("name").alias("name"), F.max((F.col("name") == "core").cast("int")).alias("core"))
    rows = rows.withColumn("name", F.when(F.col("core") == 1, "core").otherwise(F.col("name")))
    path = F.when(is_file, F.col("root")).otherwise(F.concat("root", F.lit("/")))
    return rows.select(path.alias("path"), (~is_file).alias("is_tree"), F.when(~is_file, suffixes).alias("suffixes"))


def candidates_all(listing: DataFrame) -> DataFrame:
    """Every file once that could declare something, with the surfaces that claim it in order of name."""
    rows = could_declare(listing).select("snapshot_id", "path", F.explode("surfaces").alias("surface"))
    return rows.groupBy("snapshot_id", "path").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def scope_violations(facts: DataFrame, scope: DataFrame) -> DataFrame:
    """paths of facts that their own snapshot's scope does not reach."""
    return reaches(facts.select("snapshot_id", "path").where("path != ''").distinct(), scope, "left_anti")


def coverage_join(listing: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates of a listing with whether the scope reads them. See ``marked``."""
    return marked(could_declare(listing), scope, "read")


def coverage(rows: DataFrame) -> DataFrame:
    """Candidates and read files per surface (each file once per surface, however often it is listed) and overall (null surface, every listed row)."""
    agg = (F.count("*").alias("candidates"), F.count_if("read").alias("read"))
    overall = rows.groupBy("snapshot_id").agg(*agg).withColumn("surface", F.lit(None).cast("string"))
    files = rows.select("snapshot_id", "path", "read", F.explode("surfaces").alias("surface")).distinct()
    each = files.groupBy("snapshot_id", "surface").agg(*agg)
    return each.unionByName(overall)


def _first(n: int) -> Column:
    folders = F.split("path", "/")
    return F.array_join(F.slice(folders, 1, n), "/")


def missed_by_directory(rows: DataFrame, n: int = 12) -> DataFrame:
    """The n directories (two levels) with the most unread candidates; ties go to the first path."""
    some = rows.where(~F.col("read")).groupBy("snapshot_id", _first(2).alias("directory")).agg(F.count("*").alias("missed"), F.min("path").alias("first"))
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("missed"), "first"))
    return some.withColumn("place", place).where(F.col("place") <= n).drop("first")


def missed_by_area(rows: DataFrame) -> DataFrame:
    """Unread candidates by first directory, with the percentage read."""
    out = rows.groupBy("snapshot_id", _first(1).alias("area")).agg(F.count("*").alias("candidates"), F.count_if("read").alias("n_read"))
    return out.select("snapshot_id", "area", "candidates", (F.col("candidates") - F.col("n_read")).alias("missed"), coverage_percent(F.col("candidates"), F.col("n_read")).alias("percent"))


def multi_surface_files(rows: DataFrame) -> DataFrame:
    """Files that more than one surface claims."""
    return rows.where(F.size(F.array_distinct("surfaces")) > 1).groupBy("snapshot_id").agg(F.count("*").alias("n_files"))


def violations_by_suffix(violations: DataFrame) -> DataFrame:
    """Out-of-scope files by all that follows the first dot of their name."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.contains("."), F.regexp_extract(name, r"^[^.]*(\..*)$", 1)).otherwise("(none)")
    return violations.groupBy("snapshot_id", suffix.alias("suffix")).agg(F.count("*").alias("n_files"))


def missed_paths(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Unread candidates by path, with how many there are; ``limit`` rows a snapshot are listed."""
    some = rows.where(~F.col("read")).select("snapshot_id", "path")
    of = some.groupBy("snapshot_id").agg(F.count("*").alias("of"))  # as many rows as snapshots
    return placed(some, ["snapshot_id"], ["path"], limit).join(F.broadcast(of), "snapshot_id")


def catalog_order(rows: DataFrame) -> DataFrame:
    """Candidates, unread ones first, then by path."""
    return placed(rows, ["snapshot_id"], ["read", "path"])
