"""Whitening, packing by dominance and ranked search against plain versions, with every awkward row."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from docloom.llm import dominance, rankedsearch, registry, whitening

DOCS = "doc_id long, text string, n int, rank int, k long, part string, length string, score string, query string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "p", "l", "s", "q") for i, t in rows], DOCS).repartition(3)


def _awkward():
    rng = random.Random(3)
    words = ["the", "of", "und"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(n))
    texts = [draw(rng.choice([3, 20, 60, 200])) for _ in range(150)]
    texts += texts[:30] + [texts[7]] * 40  # ties
    texts += ["", None, " \n\t", "THE the The", "the " * 30_000, "ÉÀ é-à", "x" * 30_000, "\x00\x1f!?", "İstanbul ΣΑΣ ﬁ Å ´́"]
    rows = [(i * 3 % 271, t) for i, t in enumerate(texts)] + [(None, texts[7]), (None, None), (5, texts[7]), (5, texts[7])]
    return rows, texts


ROWS, TEXTS = _awkward()


# Whitening


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n int, whitened string").repartition(3)


def test_jacobi_gives_small_eigenvalues():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(13, 13))
    a = a @ a.T
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-10) and np.allclose(v @ np.diag(e) @ v.T, a) and np.allclose(v.T @ v, np.eye(13))
    d = [1.0, 2.0**-20, 2.0**-40]
    b = [[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]]
    a = np.array([[b[i][j] * d[i] * d[j] for j in range(3)] for i in range(3)])
    e, _ = whitening.jacobi(a)
    f = [[Fraction(float(x)) for x in r] for r in a]
    det = sum(s * f[0][i] * f[1][j] * f[2][k] for s, i, j, k in ((1, 0, 1, 2), (-1, 0, 2, 1), (-1, 1, 0, 2), (1, 1, 2, 0), (1, 2, 0, 1), (-1, 2, 1, 0)))
    assert abs(float(det) / (e[0] * e[1]) / e[2] - 1) < 1e-9
    for n in (0, 1, 2):
        assert len(whitening.jacobi(np.eye(n))[0]) == n


@pytest.mark.parametrize("factor", [1.0, 3e9])
def test_whitening(spark, factor):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 9)) * np.geomspace(3, 0.1, 9) * factor).astype(np.float32)
    x[:, 8] = 0.25
    good = [(i, [float(c) for c in x[i]]) for i in range(400)] + [(None, [float(c) for c in x[3]]), (7, [float(c) for c in x[5]])]
    bad = [(900, None), (901, []), (902, [math.nan] * 9), (903, [math.inf] + [1.0] * 8), (904, [None] + [1.0] * 8), (905, [1.0, 2.0])]
    rows, d = whitening.usable(_vectors(spark, good + bad))
    assert d == 9
    w = whitening.fit(rows, d)
    fixed = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, s = len(good), [sum(c) for c in zip(*fixed, strict=True)]
    y = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s, strict=True)] for v in fixed])
    cov = y.T @ y / n
    e = np.linalg.eigvalsh(cov)[::-1]
    assert w.n == n and np.allclose(w.values[:8], e[:8], rtol=1e-9) and np.allclose(w.explained, np.maximum(e, 0) / np.trace(cov), atol=1e-9)
    got = whitening.whiten(rows, w).collect()
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got) == Counter((i, sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True))) for (i, _), v in zip(good, fixed, strict=True))
    z = np.array([r["whitened"] for r in got])
    assert np.abs(z.T @ z / n - np.diag([1.0] * 8 + [0.0])).max() < 1e-8 and not z[:, 8].any()
    assert whitening.identity_error(rows, w) < 1e-8
    mine = {i: v for (i, _), v in zip(good, y, strict=True) if i not in (None, 7)}
    for r in got:
        if r["vec_id"] in mine:
            assert np.allclose(np.array(r["whitened"])[:8], mine[r["vec_id"]] @ w.matrix[:, :8], rtol=1e-6, atol=1e-6)


def test_whitening_of_little(spark):
    assert whitening.fit(*whitening.usable(_vectors(spark, []))) is None
    rows, d = whitening.usable(_vectors(spark, [(1, [1.0, 2.0])] * 3))
    w = whitening.fit(rows, d)
    assert w.n == 3 and not w.matrix.any() and whitening.identity_error(rows, w) == 0.0
    assert all(r["whitened"] == [0.0, 0.0] and r["deviation"] == 0 for r in whitening.whiten(rows, w).collect())
    with pytest.raises(ValueError, match="too large"):
        whitening.fit(*whitening.usable(_vectors(spark, [(1, [3e38])])))


# Packing


def _optimum(sizes, capacity):
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(8)
    fixed_some = triples = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 35])
        sizes = Counter(rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randint(1, 9)))
        fixed, left = dominance.reduce(dict(sizes), capacity)
        spent = Counter()
        for group, times in fixed:
            assert sum(group) <= capacity and times > 0
            triples += len(group) == 3
            for s in group:
                spent[s] += times
        assert spent + Counter(left) == sizes
        fixed_some += bool(fixed)
        assert sum(t for _, t in fixed) + _optimum(list(Counter(left).elements()), capacity) == _optimum(list(sizes.elements()), capacity)
    assert fixed_some > 200 and triples


def test_plan_places_every_piece_once():
    rng = random.Random(9)
    for most in (3, 2000):
        for capacity in (12, 200):
            sizes = {s: rng.randint(1, most) for s in rng.sample(range(1, capacity + 1), min(60, capacity))}
            rows, n = dominance.plan(sizes, capacity)
            used: dict[int, list] = {}
            for s in sizes:
                own = sorted(r for r in rows if r[0] == s)
                assert [r[1] for r in own] == [0, *[r[2] for r in own[:-1]]] and own[-1][2] == sizes[s]
            for s, first, last, sequence, each, offset in rows:
                for k in range(last - first):
                    used.setdefault(sequence + k // each, []).append((offset + k % each * s, s))
            assert sorted(used) == list(range(n))
            for pieces in used.values():
                at = 0
                for offset, s in sorted(pieces):
                    assert offset == at
                    at += s
                assert at <= capacity
            assert n <= -(-sum(s * c for s, c in sizes.items()) // capacity) * 11 / 9 + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(dominance.vocabulary_path())
    extra = [(2000, "<|endoftext|> a<|startoftext|>b\x1cc\x85d e f"), (2001, "oḱ ́x don't DON'T 12a3 ½ 😀")]
    docs = _docs(spark, ROWS + extra)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in ROWS + extra]
    packed = dominance.pack(dominance.pieces(docs, length=512, with_ids=True), 512)
    rows = packed.collect()
    want = Counter((d, p // 512, p, len(x[p : p + 512]), zlib.crc32(x[p : p + 512].tobytes())) for (d, _), x in zip(ROWS + extra, ids, strict=True) for p in range(0, len(x), 512))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    got = dominance.sequences(packed).collect()
    assert sum(len(r["input_ids"]) for r in got) == sum(map(len, ids)) and all(len(r["input_ids"]) <= 512 for r in got)
    assert len(got) <= -(-sum(map(len, ids)) // 512) + 1
    by = {r["sequence_id"]: r for r in got}
    for r in rows:
        assert by[r["sequence_id"]]["input_ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert dominance.pack(dominance.pieces(docs.limit(0))).collect() == []


# Ranked search


def _plain_search(docs, items, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("top", "shard", "max_bytes"), [(20, 65_536, 1 << 20), (3, 40, 900)])
def test_ranked_search(spark, monkeypatch, top, shard, max_bytes):
    monkeypatch.setattr(rankedsearch, "FIRST_DOCS", 8)
    items = [(k, t) for k, t in enumerate(TEXTS[:12])] + [(None, TEXTS[20]), (3, "the THE nothing"), (4, ""), (5, None), (6, "zzzz"), (7, TEXTS[7] + " " + TEXTS[7])]
    asked = spark.createDataFrame([(i, t, 1, "r") for i, t in items], "item_id long, text string, query int, rank string").repartition(2)
    got = rankedsearch.search(_docs(spark, ROWS), asked, top, max_bytes).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == _plain_search(ROWS, items, top)


def test_shards_skip_and_stay_exact(monkeypatch):
    monkeypatch.setattr(rankedsearch, "FIRST_DOCS", 64)
    rng = np.random.default_rng(6)
    n, t = 3000, 12
    doc, term = np.nonzero(rng.random((n, t)) < np.geomspace(0.5, 0.005, t))
    share = (rng.uniform(400, 1000, len(doc)) * np.geomspace(1, 9, t)[term]).astype(np.int64)
    shard = rankedsearch.Shard(n, doc, term, share)
    every = 0
    for _ in range(40):
        query = [(int(k), int(rng.integers(1, 3))) for k in rng.choice(t, 8, replace=False)]
        total = np.zeros(n, np.int64)
        for k, times in query:
            np.add.at(total, doc[term == k], share[term == k] * times)
            every += int((term == k).sum())
        best = np.lexsort((np.arange(n), -total))[:10]
        best = best[total[best] > 0]
        d, s = shard.top(query, 10)
        assert d.tolist() == best.tolist() and s.tolist() == total[best].tolist()
    assert shard.read < every * 0.7


def test_block_ends_are_optimal():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, longest, cost = int(rng.integers(1, 10)), int(rng.integers(1, 6)), float(rng.choice([0.3, 2.0]))
        lists = [rng.integers(0, 20, int(rng.integers(1, 10))) for _ in range(n)]
        first = np.concatenate([[0], np.cumsum([len(v) for v in lists])])
        ends = rankedsearch.block_ends(np.concatenate(lists), first, longest, 1024, cost)
        for k, v in enumerate(lists):
            price = cost * (v.max() - v.mean()) + 1e-6

            def loss(cut, v=v, price=price):
                at = [0, *cut, len(v)]
                return sum((z - a) * v[a:z].max() + price for a, z in itertools.pairwise(at)) if all(z - a <= longest for a, z in itertools.pairwise(at)) else math.inf

            cuts = [c for r in range(len(v)) for c in itertools.combinations(range(1, len(v)), r)]
            mine = (np.flatnonzero(ends[first[k] : first[k + 1]])[:-1] + 1).tolist()
            assert ends[first[k + 1] - 1] and loss(mine) <= min(map(loss, cuts)) + 1e-9


def test_empty_tables(spark):
    docs, none = _docs(spark, ROWS), _docs(spark, ROWS).limit(0)
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert rankedsearch.search(none, items).collect() == [] and rankedsearch.search(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = registry.QUERIES[name](spark, data)
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(cur.fetchall())
