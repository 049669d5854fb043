"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(number: str) -> str:
    """SQL for the unsigned CRC-32 of an integer's decimal text, bit by bit."""
    digits = f"list_transform(range(1, length(({number})::VARCHAR) + 1), lambda i: ascii((({number})::VARCHAR)[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, b: list_reduce(list_prepend(xor(a, b)::BIGINT, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"


URL_RULES = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit"""

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (SELECT c.conv_id, t.place, role, text FROM c JOIN t USING (conv_id) WHERE place >= h UNION ALL SELECT c.conv_id, t.place, role, text FROM c JOIN t ON t.conv_id = c.base WHERE place < h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text FROM turns),
seq AS (SELECT conv_id, depth, length(text) AS chars, list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY depth) AS s FROM d UNION ALL SELECT conv_id, 0, 0, [] FROM c),
nodes AS (SELECT s, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(chars) AS chars, count(*) AS n_convs FROM seq GROUP BY s),
sizes AS (SELECT conv_id, max(depth) AS size FROM seq GROUP BY 1),
ends AS (SELECT s, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM seq JOIN sizes USING (conv_id) WHERE depth = size GROUP BY s),
kids AS (SELECT s[:len(s) - 1] AS s, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (s)),
sums AS (SELECT up.s, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM full_nodes f JOIN seq up ON up.conv_id = f.conv_id AND up.depth <= f.depth GROUP BY up.s)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes f JOIN sums USING (s) LEFT JOIN ends USING (s) LEFT JOIN nodes p ON f.depth > 0 AND p.s = f.s[:len(f.s) - 1]"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _level(k: int, name: str) -> str:
    """SQL for the next level of trees (g, i, h): a group's only node goes up as it is."""
    return f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16)"


def _path(k: int, name: str) -> str:
    """SQL for a level's siblings to the left and right."""
    return f"{name}p{k} AS (SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, n FROM {name}{k})"


#: Levels of a source's tree and of the tree over sources: enough for a million rows and 256 sources.
LOWER, UPPER = 5, 2
_FOLDED = "shown"
_PROOF, _STEPS = [], []
for _name, _n in (("a", LOWER), ("b", UPPER)):
    for _k in range(_n):
        _p = f"{_name}p{_k}"
        _STEPS.append(f"JOIN {_p} ON {_p}.g = {_name}0.g AND {_p}.i = {_name}0.i // {16**_k}")
        _PROOF.append(f"{_p}.l || {_p}.r")
        _FOLDED = f"CASE WHEN {_p}.n = 1 THEN {_FOLDED} ELSE sha256({_p}.l || {_FOLDED} || {_p}.r) END"
MERKLE = f"""WITH leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256(concat({", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))})) AS leaf,
  CASE WHEN {crc32("doc_id")} % 5 = 0 THEN sha256(concat({", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))}, {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")})) ELSE sha256(concat({", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))})) END AS shown FROM documents),
a0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY g) AS n, doc_id, leaf, shown FROM leaves),
{", ".join(_level(k, "a") for k in range(LOWER))},
b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS source_key FROM a{LOWER}),
{", ".join(_level(k, "b") for k in range(UPPER))},
{", ".join(_path(k, "a") for k in range(LOWER))}, {", ".join(_path(k, "b") for k in range(UPPER))},
told AS (SELECT a0.doc_id, a0.leaf, b0.h AS subroot, b{UPPER}.h AS root, sha256({" || ".join(_PROOF)}) AS proof_sha256, {_FOLDED} AS folded_root FROM a0 JOIN b0 ON b0.source_key = a0.g JOIN b{UPPER} ON true {" ".join(_STEPS)})
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM told"""

_WORD = r"[^\x20\x09-\x0D]+"
SUBSTRING = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i)),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (s), range(13) r(k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id, sizes.n"""

SQL: dict[str, str] = {"op3_substring_dedup": SUBSTRING, "op10_ngram_join": NGRAM_JOIN, "op11_url_rules": URL_RULES, "op12_prefix_trie": PREFIX_TRIE, "op13_merkle": MERKLE}
