"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

Every training passage (a window of ``2 * stride`` words, at each multiple of ``stride``) is a query
against an inverted index of the items. The threshold of an item is the BM25 score that a passage
reaches at least if it holds ``OVERLAP`` of the item's word shingles: the item's score against itself
less its ``1 - OVERLAP`` dearest words. So nothing that the last step would confirm is lost. Impacts
are stored divided by their item's threshold, which makes the threshold 1 for all.

A batch of passages is first held against the essential postings alone: what an item's other postings
add never exceeds ``SLACK``, so a passage whose essential sum stays below ``1 - SLACK`` for every
item has no pivot. The others go through block-max WAND one by one. What it returns is confirmed on
five-word shingles: at least ``OVERLAP`` of all of them, and some of the question and of the answer.

The index holds at most ``MAX_ITEMS`` items of at most ``MAX_WORDS`` words in all (or one longer item); more
items make more indexes, one after the other. Items of different magnitude, by factors of ``SPREAD``, have indexes of
their own in the same scan, so that a long item does not widen the passages that short ones are searched in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
PART = 0.3
SLACK = 0.3
BLOCK = 16
MIN_STRIDE = 64
SPREAD = 8
MAX_ITEMS = 20_000
MAX_WORDS = 2_000_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct n-word shingles; of fewer words the whole sequence."""
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer and the rest the question; a lone sentence gives its last quarter."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


class Index:
    """Postings with impacts relative to the items' thresholds, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], overlap: float = OVERLAP):
        kept = [(i, words_of(t)) for i, t in items]
        kept = [(i, w) for i, w in kept if w]
        text = dict(items)
        self.ids = [i for i, _ in kept]
        self.overlap = overlap
        self.parts = [tuple(map(shingles, question_and_answer(text[i]))) for i in self.ids]
        self.whole = [shingles(w) for _, w in kept]
        n, mean = len(kept), sum(len(w) for _, w in kept) / max(len(kept), 1)
        self.stride = max([MIN_STRIDE, *(len(w) for _, w in kept)])
        df: dict[str, int] = {}
        for _, w in kept:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        self.term = {t: k for k, t in enumerate(sorted(df))}
        posts: list[list[tuple[int, float]]] = [[] for _ in self.term]
        essential: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.need = np.full(n, 1.0 - SLACK)
        for k, (_, w) in enumerate(kept):
            tf: dict[str, int] = {}
            for t in w:
                tf[t] = tf.get(t, 0) + 1
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            # A lost shingle misses a word; at the edges each further missing word loses one shingle only.
            lost = int((1 - overlap) * len(self.whole[k]) + 1e-9)
            dear = sorted(impact.values(), reverse=True)
            least = max(sum(dear[lost:]), min(dear)) * (1 - 1e-9)
            spare = 0.0
            for t in sorted(impact, key=lambda t: (-df[t], t)):
                x = impact[t] / least
                posts[self.term[t]].append((k, x))
                if spare + x <= SLACK:
                    spare += x
                else:
                    essential[self.term[t]].append((k, x))
        self.posts = []
        for p in posts:
            at = np.array([k for k, _ in p])
            x = np.array([v for _, v in p])
            ends = [int(at[min(b + BLOCK, len(at)) - 1]) for b in range(0, len(at), BLOCK)]
            self.posts.append((at.tolist(), x.tolist(), float(x.max()), ends, [float(x[b : b + BLOCK].max()) for b in range(0, len(at), BLOCK)]))
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in essential])]).astype(np.int64)
        self.item = np.array([k for p in essential for k, _ in p], dtype=np.int64)
        self.gain = np.array([v for p in essential for _, v in p])

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """(item, score) of all items whose score reaches 1 for a passage of these distinct terms."""
        posts = self.posts
        at = {t: 0 for t in terms}
        found = []
        while True:
            heads = sorted((posts[t][0][p], t) for t, p in at.items() if p < len(posts[t][0]))
            if not heads:
                return found
            total, pivot = 0.0, None
            for item, t in heads:
                total += posts[t][2]
                if total >= 1:
                    pivot = item
                    break
            if pivot is None:
                return found
            upto = [(item, t) for item, t in heads if item <= pivot]
            # Bound by the blocks that hold the pivot, and the first item behind the nearest block's end.
            bound, ahead = 0.0, heads[len(upto)][0] if len(upto) < len(heads) else 1 << 60
            for _, t in upto:
                ends, tops = posts[t][3], posts[t][4]
                b = at[t] // BLOCK
                while b < len(ends) and ends[b] < pivot:
                    b += 1
                if b < len(ends):
                    bound += tops[b]
                    ahead = min(ahead, ends[b] + 1)
            if bound < 1:
                target = max(ahead, pivot + 1)
            elif upto[0][0] == pivot:
                score = sum(posts[t][1][at[t]] for _, t in upto)
                if score >= 1:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for item, t in upto:
                if item < target:
                    own, p = posts[t][0], at[t]
                    while p < len(own) and own[p] < target:
                        p += 1
                    at[t] = p

    def candidates(self, terms: np.ndarray, cell: np.ndarray, last: np.ndarray) -> np.ndarray:
        """First cells of the passages whose essential postings reach an item's need.

        ``terms`` are known terms only, ``cell`` their runs of ``stride`` words, numbered through the
        batch; ``last`` marks cells that end a document.
        """
        n = self.first[terms + 1] - self.first[terms]
        at = np.repeat(self.first[terms], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = len(self.ids)
        key = np.repeat(cell, n) * width + self.item[at]
        keys, inv = np.unique(key, return_inverse=True)
        gain = np.bincount(inv, weights=self.gain[at], minlength=len(keys))
        c, i = keys // width, keys % width
        nxt = np.minimum(np.searchsorted(keys, keys + width), max(len(keys) - 1, 0))
        more = np.where((keys[nxt] == keys + width) & ~last[c], gain[nxt], 0.0) if len(keys) else gain
        prev_open = np.ones(len(c), bool)
        prev_open[:] = (c > 0) & ~last[np.maximum(c - 1, 0)]
        own = gain + more >= self.need[i] - 1e-9
        # A passage that starts one cell earlier may hold this cell alone.
        before = (gain >= self.need[i] - 1e-9) & prev_open
        return np.unique(np.concatenate([c[own], c[before] - 1]))

    def confirm(self, words: list[str], item: int) -> tuple[float, float, float]:
        got = shingles(words)
        whole = len(self.whole[item] & got) / len(self.whole[item])
        # Parts may end in the middle of a shingle of the passage: look their own lengths up.
        q, a = self.parts[item]
        sizes = {len(s) for s in q | a} - {SHINGLE}
        for n in sizes:
            got = got | {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        return whole, len(q & got) / len(q) if q else 1.0, len(a & got) / len(a) if a else 1.0

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, float]]:
        """(place in texts, item, score, overlap, question overlap, answer overlap), the best passage of each pair."""
        get = self.term.get
        docs, terms, cells = [], [], []
        n_cells, last = 0, []
        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            t = np.array([get(w, -1) for w in words], dtype=np.int64)
            n = -(-len(words) // self.stride)
            docs.append((k, words, n_cells))
            on = np.flatnonzero(t >= 0)
            terms.append(t[on])
            cells.append(on // self.stride + n_cells)
            n_cells += n
            last += [False] * (n - 1) + [True]
        if not docs or not self.ids:
            return []
        firsts = np.array([d[2] for d in docs])
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for c in self.candidates(np.concatenate(terms), np.concatenate(cells), np.array(last)).tolist():
            k, words, start = docs[int(np.searchsorted(firsts, c, side="right")) - 1]
            own = words[(c - start) * self.stride : (c - start + 2) * self.stride]
            for item, score in self.wand({self.term[w] for w in own if w in self.term}):
                whole, q, a = self.confirm(own, item)
                if whole >= self.overlap - 1e-9 and min(q, a) >= PART:
                    best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0, 0.0)), (whole, q, a, score))
        return [(k, i, s, w, q, a) for (k, i), (w, q, a, s) in best.items()]


class Suite:
    """Some of the items, in an index for each magnitude; ``names`` are their ids."""

    def __init__(self, items: list[tuple], overlap: float = OVERLAP):
        self.names = [i for i, _ in items]
        by_size: dict[int, list[tuple[int, str]]] = {}
        for k, (_, text) in enumerate(items):
            size, most = len(words_of(text)), MIN_STRIDE
            while size > most:
                most *= SPREAD
            by_size.setdefault(most, []).append((k, text))
        self.indexes = [Index(own, overlap) for _, own in sorted(by_size.items())]

    def leaks(self, texts: list[str | None]) -> list[tuple]:
        """(place in texts, item_id, score, overlap, question overlap, answer overlap)."""
        return [(k, self.names[index.ids[i]], *rest) for index in self.indexes for k, i, *rest in index.leaks(texts)]


def _suites(benchmark: DataFrame, overlap: float) -> Iterator[Suite]:
    """Suites of bounded size over all items, each distinct id and text being one: rows are dealt by hash into as many as are needed."""
    rows = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    shards = max(1, -(-n // MAX_ITEMS), -(-size // MAX_WORDS))
    for k in range(shards):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).distinct().collect()
        part = sorted(((r["item_id"], r["text"]) for r in part), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))
        yield Suite(part, overlap)


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, overlap, q_overlap, a_overlap.

    ``score`` is BM25 relative to the item's threshold. Null and empty texts hold nothing; items without
    words or text are left out. Items with a null id and texts that share an id are items of their own.
    Repeated documents give repeated rows; a null doc_id is kept. Extra columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {dict(benchmark.dtypes)['item_id']}, score double, overlap double, q_overlap double, a_overlap double"
    out = None
    for suite in _suites(benchmark, overlap):
        shared = spark.sparkContext.broadcast(suite)  # at most MAX_ITEMS items and MAX_WORDS words

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            suite = shared.value
            for part in parts:
                for a in range(0, len(part), 256):
                    piece = part.iloc[a : a + 256]
                    got = suite.leaks(piece["text"].tolist())
                    ids = piece["doc_id"].tolist()
                    yield pd.DataFrame(
                        [(ids[k], *rest) for k, *rest in got],
                        columns=["doc_id", "item_id", "score", "overlap", "q_overlap", "a_overlap"],
                    )

        found = docs.select("doc_id", "text").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item; nothing is shuffled. Null and empty texts stay."""
    spark = docs.sparkSession
    for suite in _suites(benchmark, overlap):
        shared = spark.sparkContext.broadcast(suite)  # at most MAX_ITEMS items and MAX_WORDS words

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            suite = shared.value
            for part in parts:
                for a in range(0, len(part), 256):
                    piece = part.iloc[a : a + 256]
                    hit = {k for k, *_ in suite.leaks(piece["text"].tolist())}
                    yield piece[[k not in hit for k in range(len(piece))]]

        docs = docs.mapInPandas(run, docs.schema)
    return docs


def op10_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
