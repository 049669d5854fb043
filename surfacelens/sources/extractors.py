"""Facts from source files: each routed file is parsed on its own, in batches; a file that fails becomes an error row."""

from __future__ import annotations

import gc
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from json.encoder import encode_basestring
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored
from ..functions import rules
from ..functions.columns import milestone_from_ref
from ..functions.lexer import Lines, Part, Source
from ..functions.parsing import collapse, mask_comments, normalize_params, normalize_signature, parse_ext_attrs, platform_state, split_top
from ..operators import coverage
from ..operators.facts import dedupe_facts
from ..schema import SCHEMA_VERSION

_SCHEMA = "snapshot_id string, extractor string, kind string, key string, name string, path string, line int, attrs map<string,string>, n_facts int, size long, error string"
#: The error of a file without a text whose row has none of its own.
UNREADABLE = "not readable"
_json = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
Found = tuple[str, str, str, int, dict]  # kind, key, name, line, attributes


def _canonical(value: object) -> str:
    """A value as canonical JSON; texts, truth values and lists of texts, which are nearly all, without a new encoder each."""
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is bool:
        return "true" if value else "false"
    if kind is list and all(type(v) is str for v in value):
        return "[" + ",".join(map(encode_basestring, value)) + "]"
    return _json(value)


_STATES = {"FEATURE_ENABLED_BY_DEFAULT": "enabled", "FEATURE_DISABLED_BY_DEFAULT": "disabled"}


class _Branches:
    """The conditional blocks that are open after the directives taken in so far."""

    def __init__(self) -> None:
        self.levels: list[tuple[list[str], list[str]]] = []  # (what holds, the branch conditions so far)

    def read(self, directive: str, include_guard: bool = False) -> None:
        """Take a directive in."""
        word, _, rest = directive.lstrip("# \t").partition(" ")
        split = next((i for i, c in enumerate(word) if not c.isalnum()), len(word))  # '#if(X)', a tab
        word, rest = word[:split], (word[split:] + " " + rest).strip()
        own = {"if": rest, "ifdef": f"defined({rest})", "ifndef": f"!defined({rest})"}.get(word)
        if own is not None:
            self.levels.append(([], []) if include_guard else ([own], [own]))
        elif self.levels and word == "endif":
            self.levels.pop()
        elif self.levels and word in ("elif", "else"):
            # A later branch holds where all before it fail.
            before = self.levels.pop()[1]
            mine = [rest] if word == "elif" else []
            self.levels.append(([f"!({c})" for c in before] + mine, before + mine))

    def holding(self) -> list[str]:
        """Conditions of the open branches, the innermost block first."""
        return [c for held, _ in reversed(self.levels) for c in held]


class _Guards:
    """The build conditions that hold at each token. A header's own include guard (#ifndef X, then #define X) is none."""

    def __init__(self, source: Source) -> None:
        self.since, self.held = [-1], [[]]
        open_ = _Branches()
        for i in (i for i, sort in enumerate(source.sort) if sort == "directive"):
            words, then = source.said[i].lstrip("# \t").split(), source.said[i + 1].lstrip("# \t").split() if i + 1 < len(source) and source.sort[i + 1] == "directive" else []
            near = bool(then) and source.line(i + 1) - source.line(i) <= 3
            open_.read(source.said[i], len(words) == 2 and words[0] == "ifndef" and near and then[:2] == ["define", words[1]])
            self.since.append(i)
            self.held.append(open_.holding())

    def at(self, i: int) -> list[str]:
        return self.held[bisect_right(self.since, i) - 1]


def _feature_state(source: Source, begin: int, end: int, conditions: list[str]) -> dict[str, str]:
    """A declaration's state for us: what the conditions around it leave of the one that its own conditional chain picks; {} without a state."""
    outer = platform_state(conditions)
    if outer in ("not_compiled", "conditional"):
        return {rules.PLATFORM: outer}
    open_, found = _Branches(), []
    for i in range(begin, end):
        if source.sort[i] == "directive":
            open_.read(source.said[i])
        elif source.said[i] in _STATES:
            found.append((platform_state(open_.holding()) or "compiled", _STATES[source.said[i]]))
    picked = [state for held, state in found if held == "compiled"]
    if picked or not found:
        return {rules.PLATFORM: picked[0]} if picked else {}
    return {rules.PLATFORM: "conditional" if any(held == "conditional" for held, _ in found) else "not_compiled"}


def _bare(var: str) -> str:
    """A name without the k before a capital."""
    return var[1:] if len(var) > 1 and var[0] == "k" and var[1].isupper() else var


def _string(text: str) -> str | None:
    """What a text between double quotes holds; None for any other text."""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' and '"' not in text[1:-1] else None


def _is_symbol(text: str) -> bool:
    """A constant's name: k and more."""
    return len(text) > 1 and text[0] == "k" and text.replace("_", "a").isalnum()


def _braced(source: Source, *lead: str) -> Iterator[tuple[int, int, int]]:
    """(first token, name, opening brace) of initialised constants of a type: its words, what is in angle brackets, a name and braces that close."""
    for i in source.words(lead[0]):
        k = i + len(lead)
        if not source.is_at(i, *lead):
            continue
        if source.is_at(k, "<"):
            depth = 0
            while k < len(source) and source.said[k] not in ";{":
                depth += (source.said[k] == "<") - (source.said[k] == ">")
                k += 1
                if not depth:
                    break
        if k + 1 in source.close and _is_symbol(source.said[k]) and source.said[k + 1] == "{":
            yield i, k, k + 1


def feature_flags(text: str, path: str) -> Iterator[Found]:
    """Feature flags in their three spellings, and their parameters."""
    source = Source(text)
    guards = _Guards(source)
    inside = lambda bracket: source.parts(bracket + 1, source.close[bracket])
    # (place, bracket, symbol, where its string would be, how it is declared)
    found = []
    for i, bracket in source.calls("BASE_FEATURE"):
        args = inside(bracket)
        found.append((i, bracket, args[0].said, args[1].said if len(args) > 2 else "", "macro3" if len(args) > 2 else "macro2"))
    for i, name, bracket in _braced(source, "base", "::", "Feature"):
        found.append((i - source.is_at(i - 1, "const"), bracket, source.said[name], inside(bracket)[0].said, "legacy"))
    for i, bracket, symbol, given, form in found:
        if not _is_symbol(symbol):
            continue
        name, end = _string(given) or _bare(symbol), source.close[bracket]
        state = next((_STATES[t] for t in source.said[bracket:end] if t in _STATES), "unknown")
        conditions = guards.at(i)
        yield (
            "base_feature", name, name, source.line(i),
            {"var": symbol, "default_state": state, "platform_state": _feature_state(source, bracket, end, conditions), "declared_form": form, "conditions": conditions},
        )
    for i, name, bracket in _braced(source, "base", "::", "FeatureParam"):
        yield from _parameter(source.span(i + 4, name - 1), source.said[name], [p.said for p in inside(bracket)], path, source.line(i))
    for i, bracket in source.calls("BASE_FEATURE_PARAM"):
        args = [p.said for p in inside(bracket)]
        if len(args) > 3:
            yield from _parameter(args[0], args[1], args[2:], path, source.line(i))


def _parameter(kind: str, var: str, values: list[str], path: str, line: int) -> Iterator[Found]:
    """A parameter from what initialises it: the address of its flag, its name in quotes, its default; each of the first two may be missing."""
    owner = ""
    if values[0].startswith("&"):
        owner, values = _bare(values[0].rpartition(":")[2].lstrip("&")), values[1:] or [""]
    given = _string(values[0])
    # Without a name the variable gives it, and the value comes first.
    name, default = (_bare(var), values[0]) if given is None else (given, values[1] if values[1:] else "")
    if name:
        yield "feature_param", f"{owner}/{name}" if owner else f"{path}:{name}", name, line, {"feature": owner, "type": collapse(kind), "var": var, "default": collapse(default)}


def string_constants(text: str, path: str) -> Iterator[Found]:
    """Preference keys and switches by their string: a constant of characters that is set to one quoted text."""
    source, base = Source(text), path.rsplit("/", 1)[-1]
    guards, kind = _Guards(source), "pref" if any(h in base for h in rules.PREF_FILES) else "switch"
    for i in (i for i, sort in enumerate(source.sort) if sort == "text"):
        value = _string(source.said[i])
        if not value or not source.is_at(i - 1, "=") or not source.is_at(i + 1, ";"):
            continue
        if source.is_at(i - 3, "[", "]") and source.is_at(i - 5, "char"):
            name, first = i - 4, i - 5
        elif source.is_at(i - 5, "std", "::", "string_view"):
            name, first = i - 2, i - 5
        else:
            continue
        first -= 1
        if first < 0 or source.said[first] not in ("const", "constexpr") or not _is_symbol(source.said[name]):
            continue
        first -= source.is_at(first, "constexpr") and first > 0 and source.said[first - 1] in ("const", "constexpr")
        conditions = guards.at(first)
        state = platform_state(conditions)
        restricted = {"platform_state": {rules.PLATFORM: state}} if state not in (None, "compiled") else {}
        yield kind, value, value, source.line(first), {"var": source.said[name]} | ({"conditions": conditions} if conditions else {}) | restricted


def read_json5(text: str) -> object:
    """A JSON5 text of plain data: comments, bare names, single quotes and trailing commas allowed."""
    clean = mask_comments(text)
    strings: list[str] = []

    def hold(m: re.Match) -> str:
        body = m[0][1:-1]
        strings.append(m[0] if m[0][0] == '"' else json.dumps(body.replace("\\'", "'")))
        return f"\x00{len(strings) - 1}\x00"

    bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', hold, clean)
    bare = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", r'\1"\2":', bare)
    bare = re.sub(r",(\s*[}\]])", r"\1", bare)
    return json.loads(re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], bare))


def _entries(some: object, text: str, quoted: bool) -> Iterator[tuple[dict, int]]:
    """(entry, its line) of a manifest's entries with a name; the line is that on which the name is the first thing, 0 where there is none."""
    key, lines = '"name"' if quoted else "name", {}
    for number, line in enumerate(text.split("\n"), 1):
        bare, colon, value = line.lstrip(" \t{").partition(":")
        parts = value.lstrip().split('"')
        if colon and bare.rstrip() == key and len(parts) > 2 and not parts[0]:
            lines[parts[1]] = number
    for entry in some if isinstance(some, list) else ():
        if isinstance(entry, dict) and entry.get("name"):
            yield entry, lines.get(entry["name"], 0)


def runtime_flags(text: str, path: str) -> Iterator[Found]:
    """Runtime flags of a manifest. A status by platform that lists no default is empty elsewhere."""
    manifest = read_json5(text)
    for entry, line in _entries(manifest.get("data") if isinstance(manifest, dict) else None, text, False):
        status = entry.get("status", "")
        every = status if isinstance(status, dict) else {"default": status}
        default = every.get("default", "")
        ours = {rules.PLATFORM: every.get("Win", default), "default": default}
        kept = {k: entry[k] for k in rules.WIRING if k in entry}
        yield "blink_runtime_feature", entry["name"], entry["name"], line, {"status": "per-platform" if isinstance(status, dict) else status, "platform_status": ours, "windows_status": ours[rules.PLATFORM]} | kept


def flag_metadata(text: str, path: str) -> Iterator[Found]:
    """E5: flags with the milestone of their removal."""
    for entry, line in _entries(read_json5(text), text, True):
        yield "flag_entry", entry["name"], entry["name"], line, {"expiry_milestone": entry.get("expiry_milestone"), "owners": entry.get("owners", [])}


#: Words that define something of the web's surface, each with the words before or behind that make it another thing.
_DEFINERS = {"interface": {"before": ("callback",), "behind": ("mixin",)}, "dictionary": {}, "namespace": {}, "enum": {}}


def _bracketed_before(source: Source, i: int) -> int | None:
    """The opening bracket of the list in square brackets that ends right before a token."""
    return source.open.get(i - 1) if source.is_at(i - 1, "]") else None


def web_definitions(text: str, path: str) -> Iterator[Found]:
    """Web-API definitions and their members; a partial definition adds members only."""
    source, behind = Source(text), 0
    for i in source.words(*_DEFINERS):
        if i < behind:
            continue  # inside the last definition
        shape, first, name = _DEFINERS[source.said[i]], i, i + 1
        kind = [source.said[i]]
        if i and source.said[i - 1] in shape.get("before", ()):
            first, kind = i - 1, [source.said[i - 1], *kind]
        elif name + 1 < len(source) and source.said[name] in shape.get("behind", ()) and source.sort[name + 1] == "word":
            kind, name = [*kind, source.said[name]], name + 1
        brace = name + 3 if source.is_at(name + 1, ":") else name + 1
        if name >= len(source) or source.sort[name] != "word" or not source.is_at(brace, "{"):
            continue
        if brace not in source.close:
            return
        partial, end, what = source.is_at(first - 1, "partial"), source.close[brace], source.said[name]
        first, behind = first - partial, end + 1
        listed = _bracketed_before(source, first)
        attrs = {"idl_kind": " ".join(kind), "partial": partial, "inherits": source.said[name + 2] if brace == name + 3 else "", "ext": parse_ext_attrs(source.span(listed + 1, first - 1)) if listed is not None else {}}
        if kind == ["enum"]:
            attrs["values"] = [p.said.strip("\"'") for p in source.parts(brace + 1, end) if p.said]
        if not partial:
            yield "idl_interface", what, what, source.line(first), attrs
        for part in source.parts(brace + 1, end, ";") if kind != ["enum"] else ():
            yield from _member(source, part, what, partial)


def _member(source: Source, part: Part, owner: str, partial: bool) -> Iterator[Found]:
    begin, ext = part.begin, {}
    if source.is_at(begin, "[") and source.close.get(begin, part.end) < part.end:
        ext, begin = parse_ext_attrs(source.span(begin + 1, source.close[begin])), source.close[begin] + 1
    name, sort = member_of(_hyphenated(source, begin, part.end))
    if name:
        attrs = {"interface": owner, "member_type": sort, "signature": normalize_signature(source.span(begin, part.end)), "ext": ext, "runtime_enabled": ext.get("RuntimeEnabled", ""), "from_partial": partial}
        yield "idl_member", f"{owner}.{name}", name, source.lines.of(part.at), attrs


def _hyphenated(source: Source, begin: int, end: int) -> list[str]:
    """Tokens, with those that touch a hyphen made one: 'margin-top'."""
    out: list[str] = []
    for i in range(begin, end):
        touches = i > begin and source.end_of(i - 1) == source.at[i] and "-" in (source.said[i], source.said[i - 1])
        if touches and out:
            out[-1] += source.said[i]
        else:
            out.append(source.said[i])
    return out


#: Members that have no name of their own are called by their leading words.
_DECLARATIVE = ("iterable", "maplike", "setlike", "stringifier")
_SPECIAL = ("getter", "setter", "deleter")


def member_of(tokens: list[str]) -> tuple[str, str]:
    """(name, type) of a member's tokens without its extended attributes; '' where it has no name."""
    lead = next((t for t in tokens if t not in ("readonly", "inherit", "async")), "")
    before = tokens[: tokens.index(lead)] if lead else []
    named = lambda some: some[-1] if some and some[-1].replace("_", "a").replace("-", "a").isalnum() else ""
    if not before and lead == "const":
        return named(tokens[: tokens.index("=")]) if "=" in tokens else "", "const"
    if lead == "attribute" and "async" not in before:
        return named(tokens), "attribute"
    if lead in _DECLARATIVE and before in ([], ["async"]):
        return " ".join([*before, lead]), "declarative"
    if lead == "constructor" and not before:
        return "constructor", "operation"
    if "(" not in tokens:
        return named(tokens[: tokens.index("=")] if "=" in tokens else tokens), "field"
    head = tokens[: tokens.index("(")]
    name, special = named(head), [t for t in _SPECIAL if t in head]
    if name in _SPECIAL:
        return f"{name}()", "operation"
    # Of several special words the latest of their order counts.
    return (f"{special[-1]} {name}" if special and name else name), "operation"


@dataclass
class _Declared:
    """One declaration of a message file: its keyword's place, its brackets, and those around it."""

    source: Source
    word: int
    outer: list[_Declared]

    def __post_init__(self) -> None:
        listed = _bracketed_before(self.source, self.word)
        self.first = self.word if listed is None else listed
        self.attrs = [] if listed is None else split_top(self.source.span(listed + 1, self.word - 1))
        self.name, self.brace = self.source.said[self.word + 1], self.word + 2
        self.end = self.source.close[self.brace]
        self.conditions = [a for a in self.attrs if a.startswith("EnableIf")]
        self.stable = {"stable": True} if "Stable" in self.attrs else {}
        self.inner: list[_Declared] = []

    def qualified(self, module: str) -> str:
        return ".".join([*([module] if module else []), *(o.name for o in self.outer), self.name])

    def all_conditions(self) -> list[str]:
        return [c for d in (*self.outer, self) for c in d.conditions]

    def parts(self, mark: str) -> list[Part]:
        """Parts of the body, without the declarations in it."""
        return [p for p in self.source.parts(self.brace + 1, self.end, mark, {d.word: d.end + 1 for d in self.inner}) if p.said]


def _declarations(source: Source) -> list[_Declared]:
    found: list[_Declared] = []
    around: list[_Declared] = []
    for i in source.words("interface", "struct", "union", "enum"):
        if not source.is_at(i + 2, "{") or i + 2 not in source.close or source.sort[i + 1] != "word" or (i and source.said[i - 1] not in "]{};"):
            continue
        while around and around[-1].end < i:
            around.pop()
        found.append(_Declared(source, i, list(around)))
        if around:
            around[-1].inner.append(found[-1])
        around.append(found[-1])
    return found


def _module(source: Source) -> str:
    for i in source.words("module"):
        end = next((k for k in range(i + 1, len(source)) if source.said[k] == ";"), None)
        if end is not None and (i == 0 or source.said[i - 1] in "];"):
            return source.span(i + 1, end)
    return ""


def _restricted(conditions: list[str], inherited: int = 0) -> dict:
    """Conditions, what they mean for us, and which of them are an outer declaration's."""
    state = platform_state(conditions, "attribute")
    if state is None:
        return {}
    return {"conditions": conditions, "platform_state": {rules.PLATFORM: state}} | ({"inherited_conditions": conditions[:inherited]} if inherited else {})


def message_definitions(text: str, path: str) -> Iterator[Found]:
    """Calls of interfaces, and the structs, unions and enums that travel along them."""
    source = Source(text)
    module = _module(source)
    for d in _declarations(source):
        whole, kind, line = d.qualified(module), source.said[d.word], source.line(d.word)
        if kind == "interface":
            calls = list(_calls_of(d, module))
            yield from calls
            names = [c[2] for c in calls]
            yield "mojo_interface", f"{module}.{d.name}" if module else d.name, d.name, line, {"module": module, "method_count": len(names), "methods": sorted(names)} | d.stable | _restricted(d.conditions)
        elif kind == "enum":
            values = [" = ".join(filter(None, map(collapse, p.said.partition("=")[::2]))) for p in d.parts(",") if source.sort[p.begin] == "word" and (p.end == p.begin + 1 or source.is_at(p.begin + 1, "="))]
            yield "mojo_enum", whole, d.name, line, {"module": module, "values": values} | d.stable | _restricted(d.all_conditions())
        else:
            fields = list(_fields_of(d, module, whole))
            yield from fields
            names = [f[2] for f in fields]
            yield "mojo_struct", whole, d.name, line, {"module": module, "mojo_kind": kind, "field_count": len(names), "fields": sorted(names)} | d.stable | _restricted(d.all_conditions())


def _listed(source: Source, part: Part) -> tuple[str, int]:
    """(what a declaration's list in square brackets holds, its first token behind that list)."""
    if source.is_at(part.begin, "[") and source.close.get(part.begin, part.end) < part.end:
        end = source.close[part.begin]
        return collapse(source.span(part.begin + 1, end)), end + 1
    return "", part.begin


def _ordinal(source: Source, i: int) -> tuple[str | None, int]:
    """(the number behind an '@' at token i, the token after it)."""
    return (source.said[i + 1], i + 2) if source.is_at(i, "@") and i + 1 < len(source) else (None, i)


def _calls_of(d: _Declared, module: str) -> Iterator[Found]:
    source, whole, n = d.source, f"{module}.{d.name}" if module else d.name, 0
    for part in d.parts(";"):
        given, i = _listed(source, part)
        ordinal, bracket = _ordinal(source, i + 1)
        if i >= part.end or source.sort[i] != "word" or not source.is_at(bracket, "(") or source.close.get(bracket, part.end) >= part.end:
            continue
        end, response = source.close[bracket], ""
        if source.is_at(end + 1, "=>", "(") and source.close.get(end + 2, part.end) < part.end:
            response = normalize_params(source.span(end + 3, source.close[end + 2]))
        name, params = source.said[i], normalize_params(source.span(bracket + 1, end))
        attrs = {"interface": whole, "module": module, "signature": f"{name}({params})" + (f" => ({response})" if response else ""), "params": params, "response": response}
        attrs["attrs"] = {k: True for k in map(str.strip, given.split(",")) if k}
        attrs |= ({} if ordinal is None else {"ordinal": ordinal}) | _restricted(d.conditions + [a for a in split_top(given) if a.startswith("EnableIf")], len(d.conditions))
        attrs |= {"position": n} | d.stable if d.stable else {}
        n += 1
        yield "mojo_method", f"{whole}.{name}", name, source.lines.of(part.at), attrs


def _fields_of(d: _Declared, module: str, whole: str) -> Iterator[Found]:
    source, outer, n = d.source, d.all_conditions(), 0
    for part in d.parts(";"):
        given, begin = _listed(source, part)
        equals = next((i for i in range(begin, part.end) if source.said[i] == "="), part.end)
        numbered = source.is_at(equals - 2, "@")
        name = equals - 3 if numbered else equals - 1
        if name <= begin or source.sort[name] != "word":
            continue
        version = parse_ext_attrs(given).get("MinVersion")
        attrs = {
            "struct": whole, "module": module, "type": collapse(source.span(begin, name)), "ordinal": source.said[equals - 1] if numbered else None,
            "default": collapse(source.span(equals + 1, part.end)) or None, "attrs": given or None, "min_version": version if isinstance(version, str) and version.isdigit() else None,
        }
        attrs |= _restricted(outer + [a for a in split_top(given) if a.startswith("EnableIf")], len(outer)) | ({"position": n} | d.stable if d.stable else {})
        n += 1
        yield "mojo_field", f"{whole}.{source.said[name]}", source.said[name], source.lines.of(part.at), attrs


def _below_resources(path: str) -> list[str]:
    return path.removeprefix(rules.RESOURCES).split("/")


def page_routes(text: str, path: str) -> Iterator[Found]:
    """Pages with their route, parent and the visibility keys whose blocks they stand in."""
    source, surface = Source(text), _below_resources(path)[0]
    blocks: list[tuple[int, str]] = []  # (closing brace, key)
    upper = lambda i: i >= 0 and source.sort[i] == "word" and source.said[i][0].isupper() and source.said[i] == source.said[i].upper()
    for i in source.words("if", "createChild", "createSection"):
        while blocks and blocks[-1][0] < i:
            blocks.pop()
        bracket = i + 1
        if bracket not in source.close or source.said[bracket] != "(":
            continue
        end = source.close[bracket]
        if source.said[i] == "if":
            asked = next((k for k in range(bracket, end) if source.is_at(k, "loadTimeData", ".", "getBoolean", "(") and source.sort[k + 4] == "text"), None)
            if asked is not None and source.is_at(end + 1, "{"):
                blocks.append((source.close.get(end + 1, len(source)), source.said[asked + 4][1:-1]))
            continue
        # object.NAME = [object.PARENT.]create...('route')
        parent = source.said[i - 2] if source.is_at(i - 1, ".") and upper(i - 2) else ""
        equals = i - 5 if parent else i - 1
        if source.is_at(equals, "=") and upper(equals - 1) and source.is_at(equals - 2, ".") and source.sort[bracket + 1] == "text" and source.said[bracket + 1][1:-1]:
            name = source.said[equals - 1]
            yield "webui_route", f"{surface}/{name}", name, source.line(equals - 3), {"surface": surface, "route": source.said[bracket + 1][1:-1], "parent": parent, "route_kind": source.said[i].removeprefix("create").lower(), "guards": [k for _, k in blocks]}


def _template(text: str, path: str) -> tuple[int, int]:
    """Where the markup of a template lies: all of an HTML file, of a script what is between the first html` and the last backtick."""
    if not path.endswith(".html.ts"):
        return 0, len(text)
    at = text.find("html`")
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at = text.find("html`", at + 1)
    if at < 0:
        return 0, 0
    last = text.rfind("`")
    return at + 5, last if last > at + 5 else len(text)


def _tags(text: str, begin: int, end: int) -> Iterator[tuple[int, str, str]]:
    """(offset, name, attributes) of custom elements and of 'if' and '/if', comments skipped.

    A custom element's name is in lower case and has a hyphen; its tag ends at the first '>'. A condition may have one in its quotes.
    """
    at = text.find("<", begin, end)
    while at >= 0:
        after = stop = at + 1
        if text.startswith("<!--", at) and (closed := text.find("-->", at, end)) >= 0:
            at = text.find("<", closed + 3, end)
            continue
        while stop < end and (text[stop].isalnum() or text[stop] == "-" or (stop == after and text[stop] == "/")):
            stop += 1
        name, tail = text[after:stop], text[stop : stop + 1]
        custom = "-" in name and all(name.split("-")) and name.isascii() and name == name.lower() and name[0].isalpha() and (tail.isspace() or tail in ("/", ">"))
        if custom or name in ("if", "/if"):
            close = text.find(">", stop, end)
            if name == "if" and (quote := text.find('"', stop, end)) >= 0 and (quote := text.find('"', quote + 1, end)) >= 0:
                close = text.find(">", quote, end)
            if close >= 0:
                yield at, name, text[stop:close]
                after = close + 1
        at = text.find("<", after, end)


def _attributes(text: str) -> dict[str, str]:
    """Attributes with a value in double quotes; the mark before a bound one's name goes."""
    out, at = {}, 0
    while (quote := text.find('"', at)) >= 0:
        end = text.find('"', quote + 1)
        if end < 0:
            break
        head = text[at:quote].rstrip()
        if head.endswith("="):
            name = head[:-1].rstrip()
            size = next((k for k, c in enumerate(reversed(name)) if not (c.isalnum() or c in "_-")), len(name))
            if size:
                out[name[len(name) - size :]] = text[quote + 1 : end]
        at = end + 1
    return out


#: How a template writes a value in: opening and closing marks, and what may stand before the preferences.
_BINDINGS = (("{{", "}}", ""), ("[[", "]]", ""), ("${", "}", "this."))
#: Forms of a localised label: what stands between '$i18n' and its name in braces.
_LABELS = ("", "Polymer", "Raw")


def _bound_pref(value: str) -> str:
    """The preference that an attribute is bound to; a binding to anything else is none."""
    for begin, end, owner in _BINDINGS:
        for piece in value.split(begin)[1:]:
            inner = piece.split(end, 1)[0].strip().removeprefix(owner)
            name = inner.removeprefix("prefs.")
            if end in piece and name != inner and name and name.replace(".", "a").replace("_", "a").isalnum():
                return name[: -len(".value")] if name.endswith(".value") and name != ".value" else name
    return ""


def _message(value: str) -> str:
    """The name of a localised label."""
    for piece in value.split("$i18n")[1:]:
        form, brace, rest = piece.partition("{")
        name, close, _ = rest.partition("}")
        if brace and close and form in _LABELS and name.replace("_", "a").isalnum():
            return name
    return ""


def page_controls(text: str, path: str) -> Iterator[Found]:
    """Controls of a template, each by preference and id, preference, id, label, or its place among those of its tag.

    A control writes a preference, is a unit of a page, or has an interactive part in its tag and an id or label.
    """
    folders, name, lines = _below_resources(path), path.rsplit("/", 1)[-1], Lines(text)
    file = name.removesuffix(".ts").removesuffix(".html") if name.endswith((".html", ".html.ts")) else name.rpartition(".")[0]
    surface, page = folders[0], folders[1] if len(folders) >= 3 else file
    tags = list(_tags(text, *_template(text, path)))
    closed, waiting = set(), []  # conditions that end somewhere, and their ends
    for k, (_, tag, inside) in enumerate(tags):
        if tag == "if" and "expr" in _attributes(inside):
            waiting.append(k)
        elif tag == "/if" and waiting:
            closed |= {waiting.pop(), k}
    around: list[str] = []
    seen: dict[str, int] = {}
    for k, (at, tag, inside) in enumerate(tags):
        given = _attributes(inside)
        if tag in ("if", "/if"):
            if k in closed:
                around = [*around, given["expr"]] if tag == "if" else around[:-1]
            continue
        pref, ident = given.get("pref-key", "").strip() or _bound_pref(given.get("pref", "")), given.get("id", "")
        label = next((m for k in ("label", "page-title", "sub-label", "aria-label") if (m := _message(given.get(k, "")))), "")
        interactive = not set(tag.split("-")).isdisjoint(rules.CONTROL_PARTS)
        if not (pref or tag in rules.PAGE_UNITS or (interactive and (ident or label))):
            continue
        known = f"pref:{pref}" + (f"#{ident}" if ident else "") if pref else f"id:{ident}" if ident else f"label:{label}"
        if not (pref or ident or label):
            seen[tag] = seen.get(tag, -1) + 1
            known = f"{tag}#{seen[tag]}"
        conditions = around[::-1]  # the innermost first
        state = platform_state(conditions, "template")
        restricted = {"platform_state": {rules.PLATFORM: state}} if state not in (None, "compiled") else {}
        yield "webui_control", f"{surface}/{page}/{file}/{known}", known, lines.of(at), {"surface": surface, "page": page, "file": file, "control": tag, "pref": pref, "label": label, "element_id": ident, "build_conditions": conditions} | restricted


_SETTERS = {"AddBoolean": "boolean", "AddInteger": "integer", "AddString": "string", "AddDouble": "double"}


def visibility_gates(text: str, path: str) -> Iterator[Found]:
    """Visibility keys that a handler sets, with the features and checks in the expression."""
    source, handler = Source(text), path.rsplit("/", 1)[-1].removesuffix(".cc")
    for i, bracket in source.calls(*_SETTERS):
        args = source.parts(bracket + 1, source.close[bracket])
        key = _string(args[0].said)
        if not key or len(args) < 2 or not key.translate({ord(c): "a" for c in "_.-"}).isalnum():
            continue
        named = [k + 2 for k in range(args[1].begin, source.close[bracket]) if source.is_at(k, "features", "::") and _is_symbol(source.said[k + 2])]
        features = list(dict.fromkeys(source.said[k] for k in named))
        checks = sorted({source.said[k] for k in named if _is_checked(source, k - 2)})
        yield "webui_gate", f"{handler}/{key}", key, source.line(i), {"data_key": key, "handler": handler, "value_type": _SETTERS[source.said[i]], "expression": collapse(",".join(a.said for a in args[1:]))[:400], "features": features, "enabled_checks": checks}


def _is_checked(source: Source, i: int) -> bool:
    """Whether what begins at token i, or a namespace before it, is the first argument of IsEnabled."""
    while source.is_at(i - 1, "::"):
        i -= 2
    return source.is_at(i - 2, "IsEnabled", "(")


Extractor = Callable[[str, str], Iterable[Found]]
#: Extractors by the name that routing gives a file.
EXTRACTORS: dict[str, Extractor] = {
    "base_features": feature_flags,
    "blink_runtime": runtime_flags,
    "web_idl": web_definitions,
    "mojom": message_definitions,
    "constants": string_constants,
    "flags_metadata": flag_metadata,
    "webui_routes": page_routes,
    "webui_controls": page_controls,
    "webui_gates": visibility_gates,
}


def register_extractor(name: str, applies: Column, surface: str, function: Extractor) -> None:
    """Add an extractor: which files (a condition on the column ``path``), the surface they are, and what reads one."""
    if name in EXTRACTORS:
        raise ValueError(f"an extractor is called {name} already")
    coverage.ADDED_ROUTES[name] = (surface, applies)
    EXTRACTORS[name] = function


def _kept(known: dict[str, Extractor], r: dict) -> list[tuple]:
    """The rows of one file and extractor: its facts, and one that tells how many there are or what went wrong."""
    rows: list[tuple] = []
    error = r["error"] or (UNREADABLE if r["text"] is None else None)
    read = error is None
    if read:
        try:
            for kind, key, name, line, attrs in known[r["extractor"]](r["text"], r["path"]):
                values = [(k, _canonical(v)) for k, v in sorted(attrs.items()) if v is not None]
                rows.append((r["snapshot_id"], r["extractor"], kind, key, name, r["path"], line, values, None, None, None))
        except Exception as e:  # one bad file must not fail the job; its error is a row
            rows, error = [], f"{type(e).__name__}: {e}"
    return [*rows, (r["snapshot_id"], r["extractor"], None, None, None, r["path"], None, None, len(rows) if read else None, r["size"], error)]


def extract(corpus: DataFrame, extractors: dict[str, Extractor] | None = None, routes: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Facts of a corpus (snapshot_id, path, text), with the extractor, and a status row for each file and extractor.

    Files are routed by path before their text is read; those that are no product source are
    left out. A status row has no kind but ``n_facts``, the file's ``size`` (in bytes, where the
    corpus has it) and ``error``: null, what an extractor raised (then its facts of that file are
    dropped and ``n_facts`` is 0), or why the file could not be read (the corpus's ``error``, else
    ``UNREADABLE``; ``n_facts`` is null). A file without facts has a status row like any other.
    Values become canonical JSON; nulls are dropped. ``extractors`` and ``routes`` (name to surface and
    condition on ``path``) stand for what is registered: T1 as values, for one call.
    """
    known = dict(EXTRACTORS if extractors is None else extractors)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = gc.get_threshold()
        gc.set_threshold(200_000, 20)  # a file's tokens are many small objects, of which few are left: looking for loops each 2,000 takes a quarter of the time
        try:
            for batch in batches:
                rows: list[tuple] = []
                columns = list(zip(batch.schema.names, batch.columns, strict=True))
                for i in range(batch.num_rows):  # one file's text at a time
                    rows += _kept(known, {c: values[i].as_py() for c, values in columns})
                    if len(rows) > 5000 or i == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
        finally:
            gc.set_threshold(*before)

    extra = [F.col(c) if c in corpus.columns else F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("error", "string"))]
    routed = coverage.route_files(coverage.in_scope(corpus.select("snapshot_id", "path", "text", *extra)), routes).where(F.col("extractor").isin(*known))
    return routed.select("snapshot_id", "extractor", "path", "text", "size", "error").mapInArrow(run, _SCHEMA)


def facts_of(found: DataFrame) -> DataFrame:
    """The facts among the rows of ``extract``."""
    return found.where("kind is not null").select("snapshot_id", "kind", "key", "name", "path", "line", "attrs")


def file_status(found: DataFrame) -> DataFrame:
    """(snapshot_id, extractor, path, n_facts, size, error): one row for each file and extractor that reads it."""
    return found.where("kind is null").select("snapshot_id", "extractor", "path", "n_facts", "size", "error")


def extract_stats(status: DataFrame, extractors: dict[str, Extractor] | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Facts before deduplication, files read and files that failed, by extractor, of ``file_status``.

    Every extractor has a row in each snapshot (of ``snapshots``, else of ``status``), also one that no file was routed to.
    """
    names = F.explode(F.array(*map(F.lit, EXTRACTORS if extractors is None else extractors)))
    every = (status if snapshots is None else snapshots).select("snapshot_id").distinct().withColumn("extractor", names)
    got = status.groupBy("snapshot_id", "extractor").agg(F.sum("n_facts").alias("n_facts"), F.count("n_facts").alias("n_files"), F.count("error").alias("n_errors"))
    return every.join(got, ["snapshot_id", "extractor"], "left").na.fill(0, ["n_facts", "n_files", "n_errors"])


def file_totals(status: DataFrame) -> DataFrame:
    """(snapshot_id, n_files, n_errors): files that were read; files that could not be, each once, and failures of extractors."""
    unread = F.max(F.col("n_facts").isNull().cast("long"))
    per_file = status.groupBy("snapshot_id", "path").agg(unread.alias("u"), F.count_if(F.col("n_facts").isNotNull() & F.col("error").isNotNull()).alias("f"))
    return per_file.groupBy("snapshot_id").agg(F.sum(1 - F.col("u")).alias("n_files"), F.sum(F.col("u") + F.col("f")).alias("n_errors"))


class Snapshot(NamedTuple):
    """What a corpus says: deduplicated facts, statistics by extractor, a status row a file and extractor, and the header."""

    facts: DataFrame
    stats: DataFrame
    status: DataFrame
    header: DataFrame


def snapshot_header(versions: DataFrame, corpus: DataFrame, status: DataFrame, scope: DataFrame | None = None, created: str | None = None) -> DataFrame:
    """Headers worked out from what was read: a row for each of ``versions`` (snapshot_id, ref, target_set, partitions, complete).

    The milestone is the reference's; ``parse_errors`` are those of ``file_totals``; a target of the
    scope is missing if no file of the corpus is it or lies below it (one whose row says that
    it is missing is none). Without a scope no target is missing.
    """
    errors = file_totals(status).select("snapshot_id", F.col("n_errors").cast("int").alias("parse_errors"))
    out = versions.join(errors, "snapshot_id", "left")
    if scope is None:
        out = out.withColumn("missing_targets", F.array().cast("array<string>"))
    else:
        there = corpus.where(F.coalesce(F.col("error"), F.lit("")) != "missing") if "error" in corpus.columns else corpus
        lost = coverage.absent_targets(scope, there.select("snapshot_id", "path")).groupBy("snapshot_id").agg(F.array_sort(F.collect_set("path")).alias("missing_targets"))
        out = out.join(lost, "snapshot_id", "left")
    at = F.current_timestamp() if created is None else F.lit(created).cast("timestamp")
    return out.select(
        "snapshot_id", "ref", milestone_from_ref(F.col("ref")).cast("int").alias("milestone"), at.alias("created"), "target_set", F.array_sort(F.coalesce("partitions", F.array().cast("array<string>"))).alias("partitions"),
        F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("missing_targets", F.array().cast("array<string>")).alias("missing_targets"), F.coalesce("parse_errors", F.lit(0)).alias("parse_errors"), F.lit(SCHEMA_VERSION).alias("schema"),
    )


def build_snapshot(corpus: DataFrame, versions: DataFrame, scope: DataFrame | None = None, extractors: dict[str, Extractor] | None = None) -> Snapshot:
    """Snapshots of a corpus: E1 to E11, then J11 and A1 to A4, and the header; with a scope only its files are read.

    The corpus is parsed once: what extractors found is stored and read for facts and status.
    """
    found = stored(extract(corpus if scope is None else coverage.reaches(corpus, scope), extractors), "extracted")
    status = file_status(found)
    stats = extract_stats(status, extractors, versions)
    return Snapshot(dedupe_facts(facts_of(found)), stats, status, snapshot_header(versions, corpus, status, scope))
