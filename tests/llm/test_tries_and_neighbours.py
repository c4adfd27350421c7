"""Operators 11 to 13 against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import conversation_trie, nearest_vectors, source_divergence

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(1 for x in below if not kids[x]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talk(rng):
    """Shared beginnings of several lengths, copies, chains, turnless conversations, one long conversation and its copy."""
    rows = []
    for c in [*range(0, 260), 1007, 900, -3, -100]:
        kind = c % 7
        n = {0: 0, 1: 2, 2: 9}.get(kind, rng.randint(1, 8))
        for i in range(n):
            text = f"t{i}" if kind in (1, 2) else rng.choice(["é漢", "b", "", "common"]) + str(rng.randint(0, 2))
            rows.append((c, i, "user" if i % 2 else "system", text))
        if not n:
            rows.append((c, None, None, None))
    for c in (301, 302, 303):
        rows += [(c, i, "user", f"long{i}" if (c, i) != (303, 150) else "other") for i in range(200)]
    return rows


@pytest.mark.parametrize("limit", [4096, 40, 3])
def test_11_trie(spark, monkeypatch, limit):
    monkeypatch.setattr(conversation_trie, "LIMIT", limit)
    monkeypatch.setattr(conversation_trie, "PIECE", 5)
    rows = talk(random.Random(11))
    rows += [(None, 1, "user", "nobody's"), (1007, 3, None, "x"), (1007, 4, "user", None), (5, None, "system", "before all")]
    rng = random.Random(1)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 AS head", "2 AS depth", "3 AS up", "4 AS seq", "5 AS n", "6 AS t", "7 AS mark", "8 AS name")
    got = Counter(map(tuple, conversation_trie.trie(table).collect()))
    assert got == plain_trie(rows)


def test_11_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, "user", t) for t in "abcdefgh"] + [(2, 0, "user", t) for t in "abcdefgh"] + [(1, 0, "user", "a")]
    tables = [spark.createDataFrame(r, TURNS) for r in (rows, rows[::-1])]
    a, b = (Counter(map(tuple, conversation_trie.trie(t).collect())) for t in tables)
    assert a == b


def test_11_empty_and_very_long(spark):
    assert conversation_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(7, 0, "user", "é" * 1_200_000), (8, 0, "user", "é" * 1_200_000), (8, 1, "user", "x")]
    assert Counter(map(tuple, conversation_trie.trie(spark.createDataFrame(rows, TURNS)).collect())) == plain_trie(rows)


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, every=100, k=10):
    fine = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in fine:
        if q % every == 0:
            far = [(float(np.sqrt(np.square(np.array(v, np.float32).astype(float) - np.array(w, np.float32).astype(float)).sum())), i) for i, w in fine if i != q and len(w) == len(v)]
            out[q] = sorted(far)[:k]
    return out


def recall(got, want):
    found = total = 0
    for q, near in want.items():
        mine = [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert mine == sorted(mine) and [r["rank"] for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(range(1, len(mine) + 1))
        assert len(mine) == len(near)
        total += len(near)
        found += sum(1 for s, _ in mine if near and s <= near[-1][0])
    return found / max(total, 1)


@pytest.mark.parametrize("shard", [16_384, 700])
def test_12_recall_on_the_table(spark, monkeypatch, shard):
    monkeypatch.setattr(nearest_vectors, "SHARD", shard)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest_vectors.nearest(table).collect()
    assert recall(got, plain_nearest([(r.vec_id, r.embedding) for r in table.collect()])) >= 0.95


def test_12_recall_where_the_sample_is_a_small_part(spark, monkeypatch):
    monkeypatch.setattr(nearest_vectors, "SAMPLE", 200)
    monkeypatch.setattr(nearest_vectors, "QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    vectors = (centres[rng.integers(0, 30, 6000)] + 0.4 * rng.standard_normal((6000, 24))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    got = nearest_vectors.nearest(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    want = {}
    for q in range(0, 6000, 100):
        far = np.sqrt(np.square(vectors.astype(float) - vectors[q].astype(float)).sum(axis=1))
        far[q] = np.inf
        order = np.lexsort((np.arange(6000), far))[:10]
        want[q] = [(float(far[i]), int(i)) for i in order]
    assert recall(got, want) >= 0.95


def test_12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(5)], 0) for i in range(1, 40)]
    rows += [(0, [1.0] * 5, 0), (100, [1.0] * 5, 0), (200, None, 0), (300, [0.0] * 5, 0), (400, [1.0, None, 0.0, 0.0, 0.0], 0), (500, [nan] * 5, 0), (600, [inf, 0.0, 0.0, 0.0, 0.0], 0), (700, [], 0), (800, [1.0, 2.0], 0), (None, [1.0] * 5, 0)]
    rows += [(i, [1.0] * 5, 0) for i in range(1000, 1030)] + [(0, [1.0] * 5, 0), (7, rows[6][1], 0)]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS v", "3 AS size", "4 AS bound", "5 AS score", "6 AS rank")
    want = plain_nearest(rows)
    got = nearest_vectors.nearest(table).collect()
    assert {q for q in want if want[q]} == {r.query_id for r in got}
    for q, near in want.items():
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == near
    assert nearest_vectors.nearest(table.limit(0)).count() == 0


def plain_divergence(rows):
    words = [(lang or "", source or "", [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in words}:
        own = [x for x in words if x[0] == lang]
        docs = Counter(w for _, _, t in own for w in set(t))
        kept = [w for w in docs if docs[w] >= 3]
        counts = {s: Counter(w for _, x, t in own if x == s for w in t if docs[w] >= 3) for s in {x[1] for x in own}}
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(x, sum((p(c, w) - p(d, w)) ** 2 // p(d, w) for w in kept)) for x, d in counts.items() if x != s]
            terms = [(w, (p(c, w) - p(whole, w)) ** 2 // p(whole, w)) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, top in (("pair", pairs, None), ("term", terms, source_divergence.TOP)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return Counter(out)


@pytest.mark.parametrize("held, pairs, top", [(200_000, 500_000, 200), (10, 20, 5)])
def test_13_divergence(spark, monkeypatch, odd, held, pairs, top):
    for name, value in (("HELD", held), ("PAIRS", pairs), ("TOP", top)):
        monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(13)
    vocabulary = ["the", "é", "漢字", "A", "a", "Zz", *[f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 96])]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "fr", None, ""]), rng.choice([None, "s1", "s2", "S1", "é", "s3"]), text if rng.random() < 0.95 else None))
    rows += [("xx", "only", "one two"), ("xx", "other", "one"), ("xx", None, "!!! 12"), ("en", "bare", "12 34"), ("yy", "alone", "a a a")]
    rows += [(r.lang, r.source, r.text) for r in odd.collect()]
    table = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    table = table.selectExpr("*", "1 AS term", "2 AS n", "3 AS v", "4 AS at", "5 AS total", "6 AS path", "7 AS rank", "8 AS value")
    assert Counter(map(tuple, source_divergence.divergence(table).collect())) == plain_divergence(rows)
    assert source_divergence.divergence(table.limit(0)).count() == 0


def test_13_sums_beyond_a_long():
    tree = source_divergence.Corrections()
    tree.sources = {"a": 0, "b": 1}
    tree.add(np.array([0, 0, 1]), np.array([1, 1, 0]), np.array([5 * 10**9, 7, 3]), np.array([4 * 10**18, -(4 * 10**18), 9]))
    assert tree.sums == {(0, 1): 4 * 10**18 * (5 * 10**9 - 7), (1, 0): 27}


def test_13_very_long_text(spark):
    rows = [("en", s, "word " * 300_000 + "z" * 1_000_000) for s in "abc"] + [("en", "a", "word")]
    table = spark.createDataFrame(rows, "lang string, source string, text string")
    assert Counter(map(tuple, source_divergence.divergence(table).collect())) == plain_divergence(rows)
