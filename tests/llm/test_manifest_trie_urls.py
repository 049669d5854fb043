"""URL rules, the prefix trie and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from surfacelens.llm import merkle, prefix_trie, queries, url_filter

RULES = "host string, path string, verdict string"
TURNS = "conv_id long, turn long, role string, text string, key string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, proof string"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def cut(text, marks):
    return text[: min([text.find(c) for c in marks if c in text] or [len(text)])]


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
    host, best = lower(host), None
    for (h, p), v in rules.items():
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            k = (len(h) + len(p), len(h))
            best = (k, h + p, v) if best is None or k > best[0] else best
    return (host, path, *(best[1:] if best else (None, "allow")))


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "x-y", "", "c", "a1", "A"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(150)] + [(None, "/", "block"), ("a", None, "allow"), ("b", "/", None)]
    some = [(i, rng.choice(["http://", "s://", "://", "x"]) + host() + path() + rng.choice(["", "?q=://a", "#f", "/z?"])) for i in range(1200)]
    some += [(5000 + i, "http://q.a.b.c/a/b") for i in range(800)] + [(9001, None), (9002, ""), *[(9003, "http://" + "a." * 9000 + "b/a" + "/b" * 9000)] * 2]
    return some, rules


def test_url_rules(spark, urls):
    some, rules = urls
    known = {}
    for h, p, v in rules:
        if h and v:
            known[lower(h), p or ""] = max(v, known.get((lower(h), p or ""), ""))
    table = spark.createDataFrame([(i, u, "clash", "v", {"k": "v"}) for i, u in some], "id long, url string, host string, verdict string, more map<string,string>").repartition(5)
    given = spark.createDataFrame(rules, RULES)
    out = url_filter.judge(table, given)
    assert out.columns == ["id", "url", "more", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == sorted(i for i, _ in some)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], known), r["url"]
    assert sum(r["rule"] is not None for r in rows) > 500
    assert url_filter.judge(table.limit(0), given).count() == 0
    assert [tuple(r) for r in url_filter.judge(table, spark.createDataFrame([], RULES), default="block").groupBy("rule", "verdict").count().collect()] == [(None, "block", len(some))]


def test_sweep_forest():
    host = url_filter._Host("a.")
    for p in ("", "/a", "/a/b", "/a/b/c", "/a/d", "/b"):
        host.add(p, "a" + p, "block")
    assert [host.longest(p)[1] for p in ("/a/b/zz", "/a/c", "/a/b/c", "/", "/bb", "")] == ["a/a/b", "a/a", "a/a/b/c", "a", "a/b", "a"]


def trie_of(conversations):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_prefix_trie_query(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in [*range(230), 1000, 1100, 7777, -3]:
        rows += [(c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é😀x", None, "", "A"]), "k") for t in range(rng.randint(1, 6))]
    rows += [(5000 + i, t, "u", f"hot{t}", None) for i in range(300) for t in range(4)] + [(900, t, "u", "z" * (t % 3) * 500, "k") for t in range(60)] + [(None, 1, "u", "x", "k"), *rows[:20]]
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    out = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    got = [tuple(r[c] for c in NODE) for r in out]
    assert len(got) == len(set(got)) and set(got) == trie_of(built)


def test_prefix_trie_shards(spark):
    rng = random.Random(1)
    some = {c: tuple(("r", rng.choice("xyz")) for _ in range(rng.randint(0, 5))) for c in range(300)}
    rows = spark.createDataFrame([(c, d, r, x, "") for c, t in some.items() for d, (r, x) in enumerate(t)], TURNS)
    ids = spark.createDataFrame([(c,) for c in some], "conv_id long")
    trie = prefix_trie.build(prefix_trie.turn_rows(rows), ids)
    out = trie.nodes.join(prefix_trie.end_digests(trie), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    assert {tuple(r[c] for c in NODE) for r in out.collect()} == trie_of(some)
    none = prefix_trie.build(prefix_trie.turn_rows(rows.limit(0)))
    assert none.nodes.count() == 0 and prefix_trie.end_digests(none).count() == 0
    # Small shards give the same nodes, each shard its own.
    turns = [[x.encode() for _, x in t] for t in some.values()]
    whole = {(n[0], n[1], n[2]) for n in prefix_trie._nodes(list(some), turns, {})}
    assert len(whole) == len(trie_of(some)) and sum(n[6] is not None for n in prefix_trie._nodes(list(some), turns, {})) == len(set(some.values()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def proofs(rows):
    leaf = lambda r, t: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], t)))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top, out = tree([trees[s][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = steps(trees[s], i) + steps(top, k)
            h = leaf(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(map(str, out))


PROVED = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sources", [40, 1])
def test_merkle_query(spark, tmp_path, sources):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        s = "hot" if sources == 1 or i % 3 == 0 else rng.choice([None, "", "é", "z", "a", *(f"s{k}" for k in range(sources))])
        rows.append((i, s, rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "Abc", "abc", "X" * 5000]), "g", "p"))
    rows += [*[rows[0]] * 3, (None, "hot", "x", 1, "T", None, None)]
    if sources > 1:
        rows += [(9999, "lone", "x", 1, "T", "g", "p"), *[(20000 + i, "r17", None, None, "Q", "g", "p") for i in range(17)]]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r[c] for c in PROVED)) for r in out) == proofs(rows)


def test_merkle_clashes_and_empty(spark):
    rows = spark.createDataFrame([(1, "s", None, None, "A", "x", "mine"), (2, None, "l", 3, None, "y", None)], DOCS).withColumn("leaf", merkle.leaf_hash("doc_id", "text"))
    out = merkle.prove(rows, "source", ["doc_id"], "leaf")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "text", "g", "leaf", "proof", "subroot", "root"]
    assert got[1]["leaf"] == sha("1:11:A") and got[2]["leaf"] == sha("1:2-") and got[1]["g"] == "x"
    assert {r["root"] for r in got.values()} == {sha(got[2]["leaf"] + got[1]["leaf"])}
    assert [(s["left"], s["right"]) for s in got[1]["proof"]] == [(got[2]["leaf"], "")]
    assert merkle.prove(rows.limit(0), "source", ["doc_id"], "leaf").count() == 0
