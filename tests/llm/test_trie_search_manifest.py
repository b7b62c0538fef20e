"""Prefix trie, exact top-k search and Merkle manifest against brute force,
with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shipcast.llm import merkle, ordering, prefix_trie, topk_search
from shipcast.llm import queries as q

CLASH = "pos n part place rows g h doc one key mark words depth shared last rid entries rank before path leaf more l p".split()


def clash(frame):
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in frame.columns])


# positions


def test_ranks_of_a_hot_group(spark):
    rows = [("a" if i % 3 else f"g{i}", i * 7919 % 501, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "grp string, x long, i long").repartition(7)
    got = ordering.ranked(spark, frame, "grp", ["x", "i"], "test").collect()
    want = defaultdict(list)
    for g, x, i in rows:
        want[g].append((x, i))
    assert {(r.grp, r.x, r.i): (r.pos, r.n) for r in got} == {
        (g, *v): (k + 1, len(vs)) for g, vs in want.items() for k, v in enumerate(sorted(vs))
    }


# trie


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        kids = [out[x] for x in children[k]]
        ends = sorted(c for c in members[k] if len(convs[c]) == len(k))
        out[k] = (
            min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids),
            sum(x[5] for x in kids) or 1, (len(members[k]) - 1) * words + sum(x[6] for x in kids), h(",".join(map(str, ends))),
        )
    return Counter(out.values())


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame):
    return Counter(tuple(r[c] for c in COLS) for r in frame.select(*COLS).collect())


def conversations(rng, n):
    rows, convs = [], {}
    for c in rng.sample(range(-30, 5 * n), n):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["hi there", "ok", "", None, "a b \tc", "long " * 30])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        if rng.random() < 0.3:  # a hot conversation
            turns = [("user", "hot start"), ("assistant", "yes")] * 3
        convs[c] = [(r or "", t or "") for r, t in turns]
        rows += [(c, k if k else rng.choice([None, -5]), r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows, convs


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("counters", [1 << 27, 64])
def test_trie_matches_brute_force(spark, monkeypatch, counters):
    """A sketch that is far too small proves nothing and changes nothing."""
    monkeypatch.setattr(prefix_trie, "MOST_COUNTERS", counters)
    monkeypatch.setattr(prefix_trie, "DEPTHS", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows, convs = conversations(random.Random(1), 150)
    frame = clash(spark.createDataFrame(rows + [(None, 0, "user", "nobody's"), (None, None, None, None)], SCHEMA).repartition(5))
    assert nodes(prefix_trie.conversation_trie(spark, frame)) == trie(convs)


def test_hot_parents_are_broadcast(spark):
    convs = {c: [("user", "same"), ("assistant", f"other {c}")] for c in range(400)}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    assert nodes(prefix_trie.conversation_trie(spark, spark.createDataFrame(rows, SCHEMA))) == trie(convs)


def test_rebuilt_conversations(spark, tmp_path):
    rows, convs = conversations(random.Random(2), 200)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for c, own in convs.items():
        first = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = convs.get(donor, [])[:first] + own[first:]
    assert any(not t for t in rebuilt.values())
    assert nodes(q.QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == trie(rebuilt)


def test_trie_ties_and_empty(spark):
    twice = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "a")]
    got = nodes(prefix_trie.conversation_trie(spark, spark.createDataFrame(twice, SCHEMA)))
    assert got == trie({c: [("user", "a"), ("user", "a")] for c in (1, 2)})
    assert nodes(prefix_trie.conversation_trie(spark, spark.createDataFrame([], SCHEMA))) == Counter()


# top-k


def best(rows, k, is_query):
    out = Counter()
    for a, (i, e) in enumerate(rows):
        if e is None or i is None or not is_query(i):
            continue
        mine = defaultdict(int)
        for t, w in e:
            mine[t] += w
        found = [
            (-sum(mine.get(t, 0) * w for t, w in f), j is None, j) for b, (j, f) in enumerate(rows) if b != a and f is not None
        ]
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.update((i, n + 1, j, -s) for n, (s, _, j) in enumerate(found[:k]))
    return out


SPARSE = "id long, entries array<struct<term:long,weight:long>>"


@pytest.mark.parametrize("big", [False, True])
def test_search_matches_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(topk_search, "QUERY_ENTRIES", 60)
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk_search, "SCORES", 50)
    rng = random.Random(3)
    scale = 2**28 if big else 1
    rows = []
    for i in range(140):
        entries = [(rng.randrange(9), rng.randint(-3, 3) * scale) for _ in range(rng.choice([0, 1, 3, 6]))]
        rows.append((rng.choice([None, i, i // 2]), rng.choice([entries, entries, entries, None])))
    rows += [(10, [(1, 2 * scale)])] * 40  # many equal rows, queries among them
    frame = clash(spark.createDataFrame(rows, SPARSE).repartition(3))
    got = topk_search.top_k(spark, frame, 4, F.col("id") % 5 == 0)
    assert Counter(tuple(r) for r in got.collect()) == best(rows, 4, lambda i: i % 5 == 0)


def test_vectors_that_take_no_part(spark):
    vectors = [(0, [1.0, -0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, []), (50, [3e38, 3e38])]
    frame = spark.createDataFrame(vectors, "id long, v array<float>").select("id", topk_search.int_entries(F.col("v"), 256.0).alias("entries"))
    got = [tuple(r) for r in topk_search.top_k(spark, frame, 5, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    top = 2**63 - 1  # weights and scores end at the longest long
    assert got == [(0, 1, 50, top * 256 - top * 128 if top * 128 <= top else top), (0, 2, 5, 0), (0, 3, 6, 0), (50, 1, 0, top), (50, 2, 5, 0), (50, 3, 6, 0)]
    assert topk_search.top_k(spark, frame.where("false"), 5, F.lit(True)).count() == 0


# manifest


def folded(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def siblings(levels, p):
    out = []
    for level in levels[:-1]:
        run = level[p // 8 * 8 : p // 8 * 8 + 8]
        out.append((p % 8, run[: p % 8] + run[p % 8 + 1 :]))
        p //= 8
    return out


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, tops = {}, []
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = folded([leaf(r) for r in groups[g]])
        tops.append(trees[g][-1][0])
    high = folded(tops)
    out = Counter()
    for k, g in enumerate(langs):
        for p, r in enumerate(groups[g]):
            path = siblings(trees[g], p) + siblings(high, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf((*r[:4], text))
            for i, others in path:
                now = h("".join([*others[:i], now, *others[i:]]))
            proof = h("".join(s for _, others in path for s in others))
            out[(r[0], leaf(r), tops[k], high[-1][0], proof, now, now == high[-1][0])] += 1
    return out


@pytest.mark.parametrize("n, langs", [(1, 1), (9, 1), (700, 3), (120, 100)])
def test_manifest_matches_brute_force(spark, tmp_path, monkeypatch, n, langs):
    if n == 700:
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)  # ancestors by a shuffle
    rng = random.Random(n)
    names = [None, "en", "=", ""] + [f"lä{i}" for i in range(langs)]
    rows = []
    for i in range(n):
        lang = rng.choice(names[1:2] if langs == 1 else [*names[: langs + 4], "en", "en"])
        rows.append((rng.choice([i, i, i, None, 5]), rng.choice(["s", None]), lang, rng.choice([i, None]), rng.choice(["Text é A", "same", "", None])))
    rows += rows[:3] if n > 1 else []
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash(frame).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = q.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == manifest(rows)


def test_manifest_of_nothing_and_long_text(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = spark.createDataFrame([], schema)
    assert merkle.merkle_manifest(spark, empty, carry={"c": F.lit(1)}).columns == ["doc_id", "leaf", "subroot", "root", "path", "c"]
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert q.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).count() == 0
    long = [(1, "s", "en", 1, "word " * 400_000), (2, None, None, None, None)]
    got = merkle.merkle_manifest(spark, spark.createDataFrame(long, schema)).collect()
    assert {r.leaf for r in got} == {leaf(r) for r in long}
