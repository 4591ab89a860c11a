"""Ranked lexical search by variable-block-max WAND.

One pass over the documents counts the terms that the queries ask for (``counted``); its table gives the number of documents and
terms and every term's document frequency. A task then makes shards of what it reads: documents by rising doc_id, posting lists
with each posting's share of the score, cut into blocks of varying length, which end where dynamic programming finds the least
bound error: what a block's largest share exceeds its other shares by, and a fixed cost a block against blocks of one.

A search sums the block bounds of its terms over the runs of documents between block borders, all at once. That is WAND's
pivot: a run is opened only if the lists that meet it can reach the threshold together. The runs with the highest bounds are
scored first, which sets the threshold, and then the others by falling bound until one is below it. Ties are
opened, so the result is exact. The best of all shards are ranked by Spark.

Queries are taken in batches of at most ``MAX_BYTES`` of text (or one longer query); more batches are more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import common as C

TOP = 20
MAX_BYTES = 8_000_000
SHARD_DOCS, SHARD_POSTINGS = 65_536, 2_000_000
#: Longest block, and the run of postings that is cut at once.
LONGEST, RUN = 64, 1024
BLOCK_COST = 4
FIRST_DOCS, GROWTH = 512, 16

_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, only A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in ``terms``), tfs. Documents without a term are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # of one batch of queries
    width = max(len(terms), 1)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for at in range(0, b.num_rows, 500):
                rows, sizes, own, found = [], [], [], []
                for r in range(at, min(at + 500, b.num_rows)):
                    words = terms_of(texts[r].as_py())
                    if words:
                        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                        found.append(ids[ids >= 0])
                        own.append(np.full(len(found[-1]), len(rows), np.int64))
                        rows.append(r)
                        sizes.append(len(words))
                if not rows:
                    continue
                keys, tfs = np.unique(np.concatenate(own) * width + np.concatenate(found), return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(len(rows) + 1) * width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(rows, pa.int32())).cast(id_type), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(cuts, pa.array(keys % width, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int32())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, terms array<int>, tfs array<int>")


def block_ends(shares: np.ndarray, first: np.ndarray, longest: int = LONGEST, run: int = RUN, cost: float = BLOCK_COST) -> np.ndarray:
    """Marks the last posting of each block. List t is ``shares[first[t]:first[t + 1]]``.

    Runs of at most ``run`` postings are cut, each on its own and many in step: the best cost of the first j postings is the least, over
    the last block's length, of the best before it, the block's length times its largest share, and the price of a block, which
    is ``cost`` times what the run's largest share exceeds its mean by. The sum of all shares is left out, as it is the same for all cuts.
    """
    ends = np.zeros(len(shares), bool)
    starts = np.concatenate([np.arange(a, z, run) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    stops = np.minimum(starts + run, first[np.searchsorted(first, starts, side="right")])
    sizes = stops - starts
    for bits in range(run.bit_length() + 1):
        of = np.flatnonzero((sizes > (1 << bits) // 2) & (sizes <= 1 << bits))
        for part in np.array_split(of, -(-len(of) * (1 << bits) // (1 << 21)) or 1):
            if len(part):
                _cut(shares, starts[part], sizes[part], ends, longest, cost)
    return ends


def _cut(shares: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, longest: int, cost: float) -> None:
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    n, most = len(starts), int(sizes[0])
    place = starts[:, None] + np.arange(most)
    there = np.arange(most) < sizes[:, None]
    v = np.where(there, shares[np.minimum(place, len(shares) - 1)], 0).astype(np.float64)
    price = cost * (v.max(axis=1) - v.sum(axis=1) / sizes) + 1e-6
    longest = min(longest, most)
    best = np.full((n, most + longest + 1), np.inf)  # shifted by ``longest``, so that every window is inside
    best[:, longest] = 0.0
    back = np.zeros((n, most + 1), np.int32)
    tops = np.zeros((n, longest))
    lengths = np.arange(1, longest + 1)
    alive = n
    for j in range(1, most + 1):
        while sizes[alive - 1] < j:
            alive -= 1
        own = v[:alive, j - 1]
        # tops[:, r]: the largest share of the r + 1 postings up to j.
        tops[:alive, 1:] = np.maximum(tops[:alive, :-1], own[:, None])
        tops[:alive, 0] = own
        total = best[:alive, j : j + longest][:, ::-1] + lengths * tops[:alive]
        r = np.argmin(total, axis=1)
        best[:alive, longest + j] = total[np.arange(alive), r] + price[:alive]
        back[:alive, j] = j - 1 - r
    at, rows = sizes.copy(), np.arange(n)
    while len(rows):
        ends[starts[rows] + at[rows] - 1] = True
        at[rows] = back[rows, at[rows]]
        rows = rows[at[rows] > 0]


class Shard:
    """An index of some documents, numbered by rising doc_id."""

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, share: np.ndarray):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.doc, self.share = doc[order], share[order]
        term = term[order]
        cuts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        self.place = {int(t): k for k, t in enumerate(term[cuts].tolist())}
        self.first = np.append(cuts, len(term))
        last = np.flatnonzero(block_ends(self.share, self.first))
        start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        self.block_first = np.searchsorted(start, self.first)
        self.block_start, self.block_end = self.doc[start], self.doc[last]
        self.block_max = np.maximum.reduceat(self.share, start) if len(last) else self.share
        self.list_max = np.maximum.reduceat(self.share, self.first[:-1]) if len(last) else self.share
        self.total = np.zeros(n_docs, np.int64)
        self.read = 0  # postings that searches have looked at

    def runs(self, query: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, bound) of the runs of documents between block borders that some block meets."""
        at, change = [], []
        for k, times in query:
            a, z = self.block_first[k], self.block_first[k + 1]
            at += [self.block_start[a:z], self.block_end[a:z] + 1]
            change += [self.block_max[a:z] * times, self.block_max[a:z] * -times]
        at, change = np.concatenate(at), np.concatenate(change)
        order = np.argsort(at, kind="stable")
        at, bound = at[order], np.cumsum(change[order])
        lasts = np.concatenate([at[1:] != at[:-1], [True]])
        at, bound = at[lasts], bound[lasts]
        some = np.flatnonzero(bound[:-1] > 0)
        return at[some], at[some + 1] - 1, bound[some]

    def scored(self, lists: list[tuple[int, int, int]], first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some runs that may reach ``least``, with their scores; ``lists`` (list, times, bound) by falling bound.

        What is in no list but the last ones, whose bounds together stay below ``least``, is not a candidate. These lists are looked up
        for candidates alone, and only where what is found, the block's bound and the bounds of the lists to come still reach it.
        """
        order = np.argsort(first)
        first, last = first[order], last[order]
        new = np.concatenate([[True], first[1:] > last[:-1] + 1])
        first, last = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
        rest = np.append(np.cumsum([bound for _, _, bound in lists][::-1])[::-1], 0).tolist()
        for j, (k, times, _) in enumerate(lists):
            if rest[j] < least:
                break
            a, z = self.first[k], self.first[k + 1]
            own = self.doc[a:z]
            lo, hi = np.searchsorted(own, first), np.searchsorted(own, last, side="right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(n) > 1 else slice(lo[0], hi[0])
            self.total[own[at]] += self.share[a:z][at] * times
            self.read += int(n.sum())
        docs = np.flatnonzero(self.total)
        scores = self.total[docs]
        self.total[docs] = 0
        for j, (k, times, _) in enumerate(lists):
            if rest[j] >= least:
                continue
            open_ = scores + rest[j] >= least
            docs, scores = docs[open_], scores[open_]
            a, z = self.block_first[k], self.block_first[k + 1]
            block = np.minimum(a + np.searchsorted(self.block_end[a:z], docs), z - 1)
            top = np.where((self.block_start[block] <= docs) & (docs <= self.block_end[block]), self.block_max[block] * times, 0)
            open_ = scores + top + rest[j + 1] >= least
            docs, scores, top = docs[open_], scores[open_], top[open_]
            if not len(docs):
                break
            inside = np.flatnonzero(top)
            a, z = self.first[k], self.first[k + 1]
            at = np.minimum(a + np.searchsorted(self.doc[a:z], docs[inside]), z - 1)
            hit = self.doc[at] == docs[inside]
            scores[inside[hit]] += self.share[at[hit]] * times
            self.read += len(inside)
        return docs, scores

    def top(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best, equal scores by document; ``query`` has terms with how often."""
        query = [(self.place[t], times) for t, times in query if t in self.place]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not query:
            return docs, scores
        lists = sorted(((t, times, int(self.list_max[t]) * times) for t, times in query), key=lambda x: -x[2])
        first, last, bound = self.runs(query)
        order = np.argsort(-bound, kind="stable")
        first, last, bound = first[order], last[order], bound[order]
        size = np.cumsum(last - first + 1)
        at, wanted = 0, FIRST_DOCS
        while at < len(bound):
            least = int(scores[-1]) if len(scores) == k else 1
            upto = min(int(np.searchsorted(size, wanted)) + 1, int(np.searchsorted(-bound, -least, side="right")))
            if upto <= at:
                break
            d, s = self.scored(lists, first[at:upto], last[at:upto], least)
            good = s >= least
            docs, scores = np.concatenate([docs, d[good]]), np.concatenate([scores, s[good]])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            at, wanted = upto, size[upto - 1] * GROWTH
        return docs, scores


def _best_of_shards(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, queries: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """query (its place), doc_id, score: the k best of each shard; a shard is made of what a task reads."""
    sent = counts.sparkSession.sparkContext.broadcast((weights, queries))  # of one batch of queries
    id_type = to_arrow_type(counts.schema["doc_id"].dataType)

    def best(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = sent.value
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")]))
        ids = rows.column("doc_id").combine_chunks()
        lists = rows.column("terms").combine_chunks()
        term = lists.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = 75 + 25 * rows.column("n").to_numpy() * n_docs // n_terms
        share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        some = share > 0
        shard = Shard(len(rows), doc[some], term[some], share[some])
        own, docs, scores = [], [], []
        for q, query in enumerate(queries):
            d, s = shard.top(query, k)
            own.append(np.full(len(d), q))
            docs.append(d)
            scores.append(s)
        if own:
            docs = ids.take(pa.array(np.concatenate(docs).astype(np.int64))).cast(id_type)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own), pa.int32()), docs, pa.array(np.concatenate(scores), pa.int64())], ["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = postings = 0
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield from best(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield from best(held)

    return counts.mapInArrow(run, f"query int, doc_id {dict(counts.dtypes)['doc_id']}, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per query and document found: item_id, text (the query's), rank (from 1), doc_id, score.

    ``queries``: item_id, text. Each row is a query of its own, so null and repeated ids are kept; queries without terms find nothing.
    Documents with null or termless texts are in no list and no count; null doc_ids come last among equal scores,
    repeated rows are documents of their own, and other columns are left out.
    """
    spark = docs.sparkSession
    id_kind, doc_kind = dict(queries.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    asked = queries.filter(F.col("text").isNotNull()).select("item_id", "text").withColumn("_h", F.xxhash64("item_id", "text"))
    # Whole batches by a running sum of sizes, so that none passes the bound by more than its last query.
    n = asked.count()
    size = (F.octet_length("text") + 16).cast("long")
    bucket = F.floor(F.shiftright("_h", 32) * C.buckets(n) / (1 << 32))  # rises with the hash
    asked = C.materialise(C.numbered(asked, [], [F.col("_h"), F.col("item_id"), F.col("text")], bucket, "_before", size).withColumn("_batch", F.floor(F.col("_before") / max_bytes)), "queries")
    out = None
    for b in range((asked.agg(F.max("_batch")).first()[0] or 0) + 1 if n else 0):
        rows = asked.filter(F.col("_batch") == b).select("item_id", "text").collect()  # at most max_bytes and one query
        bags = [Counter(terms_of(r["text"].encode())) for r in rows]
        terms = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}
        counts = C.materialise(counted(docs, terms), "term-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not terms:
            continue
        weights = np.full(len(terms), weight(n_docs, 0), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # at most the batch's terms
            weights[r["t"]] = weight(n_docs, r["df"])
        found = _best_of_shards(counts, weights, n_docs, n_terms, [[(terms[t], c) for t, c in bag.items()] for bag in bags], top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(q, r["item_id"], r["text"]) for q, r in enumerate(rows)], f"query int, item_id {id_kind}, text string")
        part = ranked.join(F.broadcast(names), "query").select("item_id", "text", "rank", "doc_id", "score")
        out = part if out is None else C.materialise(out, "ranked").unionByName(part)
    return spark.createDataFrame([], f"item_id {id_kind}, text string, rank int, doc_id {doc_kind}, score long") if out is None else out


def op13_variable_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("text")


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM k),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark), w AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, g GROUP BY term, docs),
s AS (SELECT q, item_id, r, k.doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN df USING (term) JOIN k USING (r), g GROUP BY q, item_id, r, k.doc_id)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= {TOP}"""
