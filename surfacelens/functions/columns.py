"""Column functions: attribute access, paths, names, versions and shares."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a small literal table; null where the key has none."""
    return F.try_element_at(literal_map(values), key)


def literal_map(values: Mapping[str, object]) -> Column:
    """A table of texts to texts, numbers or lists of texts as a constant.

    Written as one JSON text, which the optimizer folds to a literal: a map of literals would be a
    hundred nodes of every plan that it is in, for each time that it is in there.
    """
    some = next(iter(values.values()))
    kind = "int" if isinstance(some, int) else "array<string>" if isinstance(some, (list, tuple)) else "string"
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def attr(attrs: Column | str, name: str) -> Column:
    """An attribute's canonical JSON; null where it is missing."""
    return F.try_element_at(F.col(attrs) if isinstance(attrs, str) else attrs, F.lit(name))


def text_of(json: Column) -> Column:
    """The text of a JSON string or number; lists and objects stay JSON."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def attr_text(attrs: Column | str, name: str) -> Column:
    """An attribute as text; '' where it is missing."""
    return F.coalesce(text_of(attr(attrs, name)), F.lit(""))


def attr_list(attrs: Column | str, name: str) -> Column:
    """A list attribute; an empty list where it is missing."""
    return F.coalesce(F.from_json(attr(attrs, name), "array<string>"), F.array().cast("array<string>"))


def platform_value(attrs: Column | str, name: str) -> Column:
    """Our platform's entry of a per-platform attribute; '' where there is none."""
    return F.coalesce(F.get_json_object(attr(attrs, name), f"$.{rules.PLATFORM}"), F.lit(""))


def our_state(attrs: Column | str) -> Column:
    """A feature's state for us: the platform's, else the default."""
    own = platform_value(attrs, "platform_state")
    return F.when(own != "", own).otherwise(attr_text(attrs, "default_state"))


def our_status(attrs: Column | str) -> Column:
    """A runtime flag's status for us."""
    own = platform_value(attrs, "platform_status")
    return F.when(own != "", own).otherwise(attr_text(attrs, "windows_status"))


def status_rank(status: Column) -> Column:
    """Place of a status in the order of release; unknown ones are as the empty one."""
    return F.coalesce(lookup({s: i for i, s in enumerate(rules.STATUS_ORDER)}, status), F.lit(0))


def any_of(names: Iterable[str]) -> str:
    """A pattern of alternatives."""
    return "(" + "|".join(re.escape(n) for n in names) + ")"


def unix(path: Column) -> Column:
    """A path with forward slashes."""
    return F.regexp_replace(path, r"\\", "/")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(unix(path), "/", -1)


def skip_reason(path: Column) -> Column:
    """Why a path is no product source; '' if it is: the first skipped folder, a test file, another program, or vendored code."""
    clean = unix(path)
    parts = F.split(clean, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.filter(folders, lambda p: p.isin(*rules.SKIPPED_DIRS))
    test = any_of(rules.TEST_ENDINGS) + r"\.[A-Za-z0-9]+$|(^|/)" + any_of(rules.TEST_STEMS) + r"\.[A-Za-z0-9]+$"
    vendored = (clean.startswith(rules.VENDORED_ROOT) & ~clean.startswith(rules.OWN_VENDORED)) | clean.rlike("/third_party/" + any_of(rules.VENDORED_NAMES) + "/")
    return (
        F.when(F.size(bad) > 0, F.concat(F.lit("folder "), F.get(bad, F.lit(0))))
        .when(clean.rlike(test), "test file")
        .when(clean.rlike("^" + any_of(rules.OTHER_PROGRAMS)), "other program")
        .when(vendored, "vendored")
        .otherwise("")
    )


def other_platform_dir(path: Column) -> Column:
    """Whether a path lies in a directory that our platform does not build."""
    return unix(path).rlike("^" + any_of(rules.OTHER_PLATFORM_ROOTS) + "/|/" + any_of(rules.OTHER_PLATFORM_FOLDERS) + "/")


def feature_name_from_var(var: Column) -> Column:
    """The name in an identifier: a leading k goes if an upper-case letter follows."""
    return F.regexp_replace(var, r"^k(?=\p{Lu})", "")


def norm_identifier(name: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def location(path: Column, line: Column) -> Column:
    """'path:line', or the path alone where the line is 0; null without a path."""
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(F.coalesce(line, F.lit(0)) == 0, path).otherwise(F.concat_ws(":", path, line))


def packed(attrs: Column | str) -> Column:
    """A map as one text, which sorts as its entries do; null where the map is. Keys and values must hold neither character 0 nor 1; JSON holds none."""
    entry = lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("\u0001"), e["value"]))
    return F.array_join(F.transform(F.map_entries(attrs), entry), "\u0000")


def unpacked(text: Column) -> Column:
    """The map of ``packed``."""
    return F.when(text == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(text, F.lit("\u0000"), F.lit("\u0001")))


def norm_ascii(name: Column) -> Column:
    """a-z and 0-9 in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def collapse_ws(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parse_version(text: Column) -> Column:
    """A dotted version of four numbers as an array; null if it is none."""
    return F.when(text.rlike(r"^\d+(\.\d+){3}$"), F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def milestone_from_ref(ref: Column) -> Column:
    """The first number of a version reference such as refs/tags/151.0.1.2; null without one."""
    found = F.regexp_extract(ref, r"(?:^|/)M?(\d+)(?:\.|$)", 1)
    return F.when(found != "", found.cast("int"))


def share(candidates: Column, read: Column) -> Column:
    """Read share in [0, 1]; null without candidates or reading."""
    part = read.cast("double") / F.when(candidates > 0, candidates)
    return F.when(part.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


def read_percent(value: Column) -> Column:
    """A share as 'NN%' (halves to even); '?' if unknown."""
    return F.coalesce(F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("?"))


def coverage_percent(candidates: Column, read: Column) -> Column:
    """Whole percent, rounded down; 0 without candidates."""
    return F.when(candidates > 0, F.floor(read * 100 / candidates)).otherwise(0).cast("int")


def guard_platform_state(results: Column) -> Column:
    """State of a declaration under conditions whose results are an array of true, false and null."""
    return (
        F.when(F.size(results) == 0, None)
        .when(F.exists(results, lambda r: F.coalesce(~r, F.lit(False))), "not_compiled")
        .when(F.exists(results, lambda r: r.isNull()), "conditional")
        .otherwise("compiled")
    )


def _resource(path: Column) -> Column:
    """A path below the resources' root; other paths as they are."""
    return F.regexp_replace(path, "^" + re.escape(rules.RESOURCES), "")


def surface_of(path: Column) -> Column:
    """The UI surface of a resource: the first folder below the resources' root."""
    return F.substring_index(_resource(path), "/", 1)


def stem_of(path: Column) -> Column:
    """A template's name without '.html' or '.html.ts'; another file's without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"\.html(\.ts)?$"), F.regexp_replace(name, r"\.html(\.ts)?$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def page_of(path: Column) -> Column:
    """The page of a resource: the second folder below the root, else the file's stem."""
    parts = F.split(_resource(path), "/")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(stem_of(path))


def trim_location(where: Column, most: int = 52) -> Column:
    """The tail of a path within ``most`` characters, after '…/' if something is cut."""
    parts = F.split(where, "/")
    tail = F.aggregate(
        F.reverse(parts),
        F.lit(""),
        lambda acc, p: F.when(acc == "", p).when(acc.startswith("\u0000"), acc).when(F.length(acc) + F.length(p) + 3 <= most, F.concat(p, F.lit("/"), acc)).otherwise(F.concat(F.lit("\u0000"), acc)),
        lambda acc: F.regexp_replace(acc, "^\u0000", ""),
    )
    return F.when(F.length(where) <= most, where).otherwise(F.concat(F.lit("…/"), tail))
