"""Each operator against brute force, on a small table with every awkward row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import common as C
from docloom.llm import decontaminate, langid, mixing, packing, pii, sharding, suffixdedup, toxicity, triejoin, vptree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rep string, shard string, size string, uid long, score string, kind string"


def _corpus():
    rng = random.Random(5)
    syll = ["tha", "en", "or", "ing", "re", "sta", "mi", "lo", "qua", "ver", "dis", "pe"]
    words = ["".join(rng.choice(syll) for _ in range(rng.randint(1, 3))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([8, 40, 120]))) + "." for _ in range(60)]
    texts += texts[:6]  # exact copies
    for t in texts[6:14]:  # near copies
        w = t.split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts += [t + "\n" + passage for t in texts[14:20]]
    texts += ["", None, " \t\n", "one", "one two three", "ONE two  three", "x" * 5000, "123 456 !!", "a b " * 2000, "é😀 ü @ +1"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None, "s0"][i % 4]) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s1"), (None, "nobody's text", None, None), (None, None, None, None)]
    return rows, passage


ROWS, PASSAGE = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, lang, s, len(t or ""), 1, "r", "s", "z", 9, "q", "k") for i, t, lang, s in ROWS]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_vp_tree_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] * 12, 1), (2060, [None] + [1.0] * 11, 1), (None, rows[1][1], 1), (20, rows[20][1], 1), (3000, [1.0, 2.0], 1), (40, [9.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q int")
    got = defaultdict(list)
    for r in vptree.search(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=128, block=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    pool = {i: np.array(v, float) for i, v, _ in rows[:-1] if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    asked = [i for i in pool if i % 20 == 0]
    assert set(got) == {i for i in asked if len(pool[i]) == 12}
    for i in got:
        want = sorted(((-float((pool[i] * v).sum()), j) for j, v in pool.items() if j != i and len(v) == 12))[:20]
        assert [j for _, j, _ in sorted(got[i])] == [j for _, j in want]
        assert np.allclose([s for *_, s in sorted(got[i])], [-s for s, _ in want])
    few = vptree.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert vptree.search(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_vp_tree_search_with_equal_scores_of_unlike_vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((1500, 10)) < 0.4).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vptree.search(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=200, block=30).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    alive = np.flatnonzero(x.any(axis=1))
    for q in alive[alive % 20 == 0].tolist():
        s = x @ x[q]
        assert got[q] == [(j, s[j]) for j in sorted((j for j in alive.tolist() if j != q), key=lambda j: (-s[j], j))[:20]]


def test_stored_trees_are_read_back():
    x = np.random.default_rng(5).normal(size=(500, 6))
    tree = vptree.Tree(x)
    again = vptree.Tree.loads(tree.dumps(), x)
    assert again.nodes == tree.nodes and (again.order == tree.order).all() and again.top == tree.top


def test_relaxed_pruning_only_loses_recall():
    x = np.random.default_rng(3).normal(size=(2000, 8))
    tree = vptree.Tree(x)
    exact = set(zip(*map(list, tree.search(x[:50], 10, 1.0)), strict=True))
    loose = set(zip(*map(list, tree.search(x[:50], 10, 3.0)), strict=True))
    want = {(q, j) for q in range(50) for j in np.argsort(-(x @ x[q]))[:10]}
    assert exact == want and 0.2 < len(loose & want) / len(want) < 1


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in s) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_personal_data(spark, docs, empty):
    texts = [
        "a@b.com_x@d.com a@b..c @x y@z", "1.2.3.4.5.6.7.8 300.1.2.3.4 1.2.3 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112",
        "+1 (736) 555-2678 +12345 +1234567890123456", "ä😀 +49 30 1234567 a@ä.com b@c.de😀d@e.fr", "a" * 5000 + "@" + "b." * 2000, "1." * 500,
        "+1 (884) 555-3918 4111111111111111 then", "", None, "token = 36798284236820092bfe",
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = pii.find_personal_data(df.withColumn("kind", F.lit(1))).collect()
    text_of = defaultdict(list)
    for r in df.collect():
        text_of[r["doc_id"]].append(r["text"] or "")
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, own in text_of.items() for _ in own)
    for r in rows:
        hashes = set()
        for t in text_of[r["doc_id"]]:
            found = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if _valid(k, m.group()))
            hashes.add(hashlib.sha256(",".join(x for *_, x in found).encode()).hexdigest())
        assert r["base_sha256"] in hashes
        if r["doc_id"] is not None:
            assert {x for *_, x in found} <= set(r["spans"].split(",")) or not found
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x.startswith(k) for *_, x in found) for k in PATTERNS)
    assert pii.find_personal_data(empty).count() == 0


def test_added_personal_data(spark):
    """Planted spans that no base pattern finds, and look-alikes that are none: precision and recall of each kind."""
    rng = random.Random(12)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    good = {
        "email": lambda: rng.choice(["anna (at) example (dot) com", "j.doe [at] mail7 [dot] example [dot] org", "info(at)firma.de"]),
        "ip": lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)),
        "phone": lambda: rng.choice([f"({rng.randrange(2, 10)}{num(2)}) {rng.randrange(2, 10)}{num(2)}-{num(4)}", f"{rng.randrange(2, 10)}{num(2)}-{rng.randrange(2, 10)}{num(2)}-{num(4)}"]),
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
    }
    before = {"email": "write to ", "ip": "host address ", "phone": "call ", "secret": 'token = "'}
    rows, planted = [], []
    for i in range(400):
        kind = list(good)[i % 4]
        hit, lead = good[kind](), "some words " * rng.randint(1, 5) + before[kind]
        rows.append((i, f"{lead}{hit}" + ('"' if kind == "secret" else "") + " and more, as said."))
        planted.append((i, kind, len(lead), len(lead) + len(hit)))
    other = [lambda: f"order no. {num(16)} of today", lambda: f"version 1.{num(2)} at section {num(1)}", lambda: f"isbn {num(3)}-{num(3)}-{num(4)}x", lambda: "words at (a) dot in the (at) list", lambda: f"at 12:{num(2)} or {num(3)}", lambda: "token ring and the secret garden"]
    rows += [(1000 + i, rng.choice(other)()) for i in range(300)]
    rows += [(2000 + i, f"mail me: a{i}@b.example.com, host 10.0.0.{i % 256}") for i in range(100)]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in good:
        mine = [p for p in planted if p[1] == kind]
        assert sum(f"{k}:{a}:{z}" in out[i]["spans"].split(",") for i, k, a, z in mine) >= 0.9 * len(mine), kind
    assert sum(out[i]["n_added"] for i in out) <= 1.1 * len(planted) and sum(out[i]["n_added"] > 0 for i in out if i >= 1000) <= 9
    assert sum(out[i]["n_secret"] for i in out) == 100
    few = ["call me at (555) 223-4567 or 415-555-2671", "phone 212-555-0101, 646-555-0199", "mail john (at) example (dot) com"]
    found = pii.find_personal_data(spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_added"] for r in found] == [2, 2, 1]


def test_reliabilities_against_plain_em(spark):
    rng = random.Random(13)
    n = pii.N_LABELERS
    pats = {(k, tuple([rng.randint(0, 1), *(rng.randint(-1, 1) for _ in range(n - 1))])): rng.randint(1, 30) for k in (0, 3) for _ in range(40)}
    df = spark.createDataFrame([(k, list(v), c) for (k, v), c in pats.items()], "kind int, v array<int>, n long")
    got = {r["kind"]: r["w"] for r in pii.reliabilities(df).collect()}
    for kind in (0, 3):
        v = np.array([p for k, p in pats if k == kind], float)
        c = np.array([x for (k, _), x in pats.items() if k == kind], float)
        yes0 = np.array(pii.PRIOR_VOTES)
        no0 = yes0[:, ::-1]
        w, prior = np.log(yes0 / no0), np.zeros(2)
        cast = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
        for _ in range(pii.ROUNDS):
            q = c / (1 + np.exp(-((cast * w).sum((1, 2)) + prior[v[:, 0].astype(int)])))
            yes = (np.einsum("pjx,p->jx", cast, q) + yes0) / (q.sum() + yes0.sum(1, keepdims=True))
            no = (np.einsum("pjx,p->jx", cast, c - q) + no0) / ((c - q).sum() + no0.sum(1, keepdims=True))
            share = np.array([(1 + q[v[:, 0] == b].sum()) / (2 + c[v[:, 0] == b].sum()) for b in (0, 1)])
            w, prior = np.log(yes / no), np.log(share / (1 - share))
        assert np.allclose(got[kind], [*w.ravel(), *prior])


def test_packing_round_trip(spark, docs, empty):
    rows = packing.pack(docs, length=64).collect()
    tok = packing.Tokenizer()
    got = defaultdict(dict)
    for r in rows:
        assert len(r["input_ids"]) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        for k, (d, start) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            a, z = r["cu_seqlens"][k : k + 2]
            assert r["position_ids"][a:z] == list(range(z - a))
            got[d].setdefault(start, []).append(r["input_ids"][a:z])
    for i, t, *_ in ROWS:
        if i not in (None, 7):
            ids = [x for s in sorted(got[i]) for x in got[i][s][0]]
            assert tok.decode(ids[:-1]) == (t or "") and ids[-1] == packing.END
    assert packing.pack(empty).count() == 0
    assert 0 < packing.fill_rate(packing.pack(docs, length=64)) <= 1 and packing.fill_rate(packing.pack(empty)) is None


@pytest.mark.parametrize("kind", ["int", "string"])
def test_packed_matrices_are_read_back(spark, docs, empty, tmp_path, kind):
    packed = packing.pack(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), length=64)
    packing.write_matrices(packed, f"{tmp_path}/rows", block_rows=10)
    again = packing.read_matrices(spark, f"{tmp_path}/rows")
    assert again.dtypes == packed.dtypes
    assert Counter(map(str, again.collect())) == Counter(map(str, packed.collect()))
    raw = spark.read.parquet(f"{tmp_path}/rows").first()
    ids = np.frombuffer(raw["input_ids"], "<i4").reshape(raw["n_rows"], 64)
    assert (np.frombuffer(raw["position_ids"], "<i4").reshape(ids.shape)[:, 0] == 0).all()
    packing.write_matrices(packing.pack(empty), f"{tmp_path}/none")
    assert packing.read_matrices(spark, f"{tmp_path}/none").count() == 0


def test_tokenizer_round_trip():
    tok = packing.Tokenizer()
    for t in ["a  b", "a \nb", " x", "x ", "it's we'll", "ä 😀 12 34", "\t \t", *[t for _, t, *_ in ROWS if t]]:
        assert tok.decode(tok.encode(t)) == t


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    room, rows = [], []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
        fit = min(((r, k) for k, r in enumerate(room) if r >= sizes[i]), default=None)
        if fit is None:
            room.append(50)
            rows.append([])
            fit = (50, len(room) - 1)
        room[fit[1]] -= sizes[i]
        rows[fit[1]].append(i)
    assert packing.best_fit_decreasing(sizes, 50) == rows


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    plain = ["the", "road", "goes", "on", "and", "house", "tree", "river", "cloud", "stone"]
    rows, gold = [], []
    for i in range(600):
        own = [" ".join(rng.choice(plain) for _ in range(6)) for _ in range(rng.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            k = rng.randrange(len(own))
            own[k] = own[k] + " " + rng.choice(["grubble", "snarfit"])
        rows.append((i, ". ".join(own)))
        gold.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(gold + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(df, lab).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in out if out[i]["held_out"]} == set(held)
    assert np.mean([out[i]["predicted"] == gold[i][1] for i in held]) > 0.97
    text = dict(rows)
    assert all(re.search("grubble|snarfit", text[i][out[i]["start"] : out[i]["end"]]) for i in held if out[i]["predicted"] and gold[i][1])
    # Against a plain noisy-or, over sentences that have a word.
    weights, bias = toxicity.fit(df, lab)
    for i in list(text)[:40]:
        parts = [w for w in (re.findall(r"\w+", x.lower()) for x in re.split(r"[.!?\n]+", text[i])) if w]
        p = [1 / (1 + math.exp(-(bias - math.log(len(parts)) + sum(weights.get(f, 0.0) for w in set(own) for f in toxicity.features(w))))) for own in parts]
        assert math.isclose(out[i]["score"], 1 - math.prod(1 - x for x in p), abs_tol=1e-9)
    clean = [text[i] for i, bad in gold if not bad]
    long = [(0, ".\n".join(clean)), (1, ".\n".join(clean * 5)), (2, ". ".join(clean[:40]) + ". İ GRUBBLE SNARFIT GRUBBLE"), (3, "İ the road. GRUBBLE goes on"), (3, None)]
    found = {(r["doc_id"], r["score"] > 0): r for r in toxicity.score(spark.createDataFrame(long, "doc_id long, text string").unionByName(df.filter("doc_id > 3")), lab).collect()}
    assert not found[0, True]["predicted"] and not found[1, True]["predicted"] and found[3, True]["predicted"] and found[2, True]["predicted"]
    assert "GRUBBLE" in long[3][1][found[3, True]["start"] : found[3, True]["end"]]
    odd = toxicity.score(docs, lab.filter("doc_id < 0"))
    assert odd.count() == len(ROWS) and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, lab).count() == 0


def _components(n, percent):
    sets = defaultdict(set)
    for i, t, *_ in ROWS:
        w = words(t)
        if i is not None and w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    ids = sorted({i for i, *_ in ROWS if i is not None})
    comp = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return comp, sets


@pytest.mark.parametrize(("n", "percent", "cut", "hot"), [(4, 85, 1_000_000, 20_000), (5, 80, 150, 20_000), (4, 85, 1_000_000, 2)])
def test_prefix_tree_join(docs, empty, monkeypatch, n, percent, cut, hot):
    monkeypatch.setattr(triejoin, "HOT_SHINGLES", hot)
    comp, sets = _components(n, percent)
    rows = triejoin.near_duplicates(docs, n, percent, group_shingles=cut).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]])
    assert triejoin.near_duplicates(empty).count() == 0


def test_prefix_tree_join_between_chunks(spark):
    """A cluster of many chunks, a second one that touches it at the edge, and rows that repeat an id or have none."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]

    def edited(*places):
        return " ".join("e%d" % rng.randrange(10**6) if k in places else w for k, w in enumerate(base))

    rows = [(i, edited(i % 60)) for i in range(3, 43)] + [(100 + i, edited(0, 1, 2, 58 - i % 2, 59)) for i in range(12)]
    rows += [(2, edited(5)), (2, "other words of a repeated id"), (1, "other words of a repeated id"), (None, edited(30)), (None, "nothing like it at all")]
    rows += [(500 + i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(20)]
    for cut in (10**6, 300):
        got = triejoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80, group_shingles=cut).collect()
        sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for _, t in rows for w in [t.split()]]
        comp = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp = [comp[a] if c == comp[b] else c for c in comp]
        least = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in comp}
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((rows[k][0], len(sets[k]), least[comp[k]]) for k in range(len(rows)))
    kept = triejoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)), 4, 80)
    assert kept.columns == ["doc_id", "text", "n"] and kept.count() == len(set(comp))


def test_mixing(docs, empty):
    rows = mixing.mix(docs, block=16).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], target[s]) and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(2), block=16).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(empty).count() == 0


def test_suffix_dedup(docs, empty):
    rows = suffixdedup.remove_repeats(docs).collect()
    seen, want = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in ROWS if i is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept)
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
            assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]][3]).hexdigest()
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_hot_anchors(spark, docs, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("klmnopq ") for _ in range(60)) + ("XY" if i % 5 else "same ") * 8 + line + rng.choice(["tail" * 9, str(i) * 40]) + "z" * (i % 4)) for i in range(80)]
    shared = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def result(df, **options):
        return sorted(tuple(r) for r in suffixdedup.remove_repeats(df.filter("doc_id is not null"), **options).drop("kept").collect())

    for df in (docs, shared):
        assert result(df, hot_kinds=1) == result(df) == result(df, hot_rows=1) == result(df, hot_rows=4)
    seen, want = set(), {}
    for i, t in rows:
        gone = set()
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(t[k : k + 100])
        want[i] = len(gone)
    assert {r[0]: r[2] for r in result(shared, hot_kinds=5)} == want and max(want.values()) > 100
    # Some batches have few of a hot anchor and others many.
    monkeypatch.setattr(suffixdedup, "BATCH_ANCHORS", 60)
    assert {r[0]: r[2] for r in result(shared, hot_rows=3)} == want


def test_suffix_dedup_of_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(349)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + c), (None, c), (2, None)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 349, 0), (2, 349, 349), (2, 349, 0), (2, 349, 0), (3, 698, 349), (None, 349, 0), (2, 0, 0)])


def test_deep_shallow_sort_orders_rows():
    rng = np.random.default_rng(6)
    rows = rng.integers(97, 99, size=(400, 100)).astype(np.uint8)
    rows[100:300, :90] = rows[0, :90]
    rows[300:350] = rows[1]
    order = suffixdedup.deep_shallow_sort(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(400))


def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(by) <= {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    even = [(i, "text number %d " % (i % 900) * 5, "en", "s%d" % (i % 7)) for i in range(4000)] + [(9000 + i, "the same", "en", "s0") for i in range(6000)]
    out = sharding.shard_documents(spark.createDataFrame(even, "doc_id long, text string, lang string, source string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    load = [r["b"] for r in out]
    assert len(load) == 16 and max(load) <= 1.03 * sum(load) / 16 and min(load) >= 0.97 * sum(load) / 16
    assert sharding.shard_documents(empty).count() == 0
    # Copies of one text without ids, or with one id for all, are dealt out as well.
    rng = random.Random(2)
    for one in (None, 7):
        rows = [(one, "x" * 99, "en", "s0") for _ in range(2000)] + [(100 + i, "".join(rng.choice("ab ") for _ in range(150 + i % 90)), "en", "s%d" % (i % 5)) for i in range(2000)]
        out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
        load = Counter()
        for r in out:
            load[r["shard"]] += r["size"]
        assert len(out) == 4000 and len(load) == 16 and max(load.values()) <= 1.03 * sum(load.values()) / 16 and min(load.values()) >= 0.97 * sum(load.values()) / 16


def test_language_id(spark, docs, empty):
    rng = random.Random(8)
    stems = {"en": ["thing", "with", "shall", "know"], "xx": ["zukra", "vlik", "drzo", "kvat"]}
    rows = [(i, " ".join(rng.choice(stems[la]) + rng.choice(["", "er", "a"]) for _ in range(12)) + ".", la) for i in range(300) for la in [["en", "xx"][i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert all(out[i]["lang_pred"] == la and 0.5 < out[i]["score"] <= 1 for i, _, la in rows)
    assert {i for i in out if out[i]["held_out"]} == {i for i in out if zlib.crc32(str(i).encode()) % 3 == 1}
    model = langid.train(df.select("text", "lang").toPandas())
    w = langid.Words(model)
    ids = np.array([w[x] for x in ["shall", "know", "thinger", "withera", "zukra", "vlika", "drzoer", "kvat"]])
    g, _ = langid.label_words(ids, np.zeros(8, int), w)
    assert [model.langs[k] for k in g.argmax(axis=1)] == ["en"] * 4 + ["xx"] * 4
    mixed = "Shall know thinger withera zukra vlika drzoer kvat. Knower thing."
    runs = langid.label_runs(spark.createDataFrame([(1, mixed), (2, None), (3, "12 ..")], "doc_id long, text string"), model).orderBy("start").collect()
    assert [(mixed[r["start"] : r["end"]], r["lang"], r["n_words"]) for r in runs] == [("Shall know thinger withera", "en", 4), ("zukra vlika drzoer kvat", "xx", 4), ("Knower thing", "en", 2)]
    odd = langid.language_id(docs).collect()
    assert len(odd) == len(ROWS)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", dict((i, t) for i, t, *_ in ROWS)[r["doc_id"]] or "")) for r in odd if r["doc_id"] is not None)
    assert langid.language_id(empty).count() == 0


def test_every_language_and_every_letter_counts(spark, monkeypatch):
    rng = random.Random(2)
    langs = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(70)}
    df = spark.createDataFrame([(i, " ".join(rng.choice(langs[la]) for _ in range(8)), la) for i in range(700) for la in [f"l{i % 70:02d}"]], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 70
    with pytest.raises(ValueError, match="more than 69 values of lang"):
        langid.fit(df, max_languages=69)
    a, b = langid.features(["x" * 60 + "middle" + "y" * 60])[0], langid.features(["x" * 60 + "muddle" + "y" * 60])[0]
    assert sorted(a) != sorted(b)
    # Long texts are labelled in parts that change nothing.
    text = " ".join(rng.choice(langs["l03"] + langs["l04"]) + rng.choice(["", "", ".", " 7"]) for _ in range(3000))
    whole = langid.predict([text, None, text + " end"], langid.Words(model))
    monkeypatch.setattr(langid, "BATCH_WORDS", 200)
    monkeypatch.setattr(langid, "PIECE", 1000)
    cut = langid.predict([text, None, text + " end"], langid.Words(model))
    assert [w[0] for w in whole] == [c[0] for c in cut] and np.allclose([w[1:] for w in whole], [c[1:] for c in cut], atol=1e-5)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(9)
    e, trans, start = rng.random((1, 4, 3)), rng.random((3, 3)), rng.random(3)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = start[path[0]] * math.prod(e[0, t, path[t]] for t in range(4)) * math.prod(trans[path[t], path[t + 1]] for t in range(3))
        for t in range(4):
            want[t, path[t]] += p
    g, pairs, _ = langid.posteriors(e, np.array([4]), trans, start, True)
    assert np.allclose(g[0], want / want.sum(axis=1, keepdims=True)) and math.isclose(pairs.sum(), 3)


def test_decontamination(spark, docs, empty):
    items = [(0, PASSAGE + "."), (1, "Which stone is it? The one that lies on the river bank near town."), (2, None), (3, ""), (None, "x y z"), (0, "one two three"), (5, "a b " * 2000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = set()
    for i, t, *_ in ROWS:
        own = decontaminate.shingles(decontaminate.words_of(t))
        for k, item in items[:2] + items[4:]:
            s = decontaminate.shingles(decontaminate.words_of(item))
            if len(s & own) / len(s) >= 0.8:
                want.add((i, k))
    assert got == want and len(want) >= 8 and {k for _, k in want} >= {0, 5}
    texts = decontaminate.find_leaks(docs, bench.withColumn("item_id", F.concat(F.lit("q"), "item_id"))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in texts} == {(i, None if k is None else f"q{k}") for i, k in want}
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.count() == len(ROWS) - sum(i in {d for d, _ in want} for i, *_ in ROWS) and kept.columns == docs.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0


def test_wand_against_all_scores():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30)))) for k in range(70)]
    index = decontaminate.Index(items)
    for _ in range(60):
        terms = {index.term[w] for w in rng.sample(vocab, 45) if w in index.term}
        score = defaultdict(float)
        for t in terms:
            for k, x in zip(*index.posts[t][:2], strict=True):
                score[k] += x
        assert sorted(k for k, _ in index.wand(terms)) == sorted(k for k, s in score.items() if s >= 1 - 1e-12 and s >= 1)


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = C.numbered(df, ["g"], [F.col("id")], F.floor(F.col("id") / 100), "k").collect()
    for g in range(3):
        assert [k for _, k in sorted((r["id"], r["k"]) for r in out if r["g"] == g)] == list(range(sum(r["g"] == g for r in out)))


def test_training_holds_blocks_of_chains():
    """The driver trains: what it holds at once must not grow with all chains filled up to the longest."""
    import tracemalloc

    rng = np.random.default_rng(5)
    text = lambda letters: ". ".join(" ".join("".join(rng.choice(list(letters), 3)) for _ in range(60)) for _ in range(20))
    sample = pd.DataFrame([(lang, text(letters)) for lang, letters in (("a", "abcdef"), ("b", "uvwxyz")) for _ in range(100)], columns=["lang", "text"])
    tracemalloc.start()
    model = langid.train(sample, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p[0] for p in langid.predict(["abc fed", "xyz uvw"], langid.Words(model))] == ["a", "b"]
    assert peak < 24e6
    lengths = np.array([64, 64, 10, 3, 3, 1])
    assert langid._blocks(lengths, 64) == [0, 1, 2, 6] and langid._blocks(lengths, 1) == [0, 1, 2, 3, 4, 5, 6] and langid._blocks(lengths[:0], 9) == [0]
