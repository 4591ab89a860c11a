"""N-gram Jaccard self-join by prefix trees.

1. A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets are one
   class, which one of its rows stands for.
2. Shingles have one global order, by how often their bucket of a count sketch of constant size was
   hit in the whole corpus, then by hash. Two sets that link share a shingle among the first
   ``n - ceil(t * n) + 1`` of each, counted from the rare end.
3. Each such shingle names the smallest row that has it as leader. Classes are sent once to each
   distinct leader, whatever number of shingles they share with it: any two that can link meet at
   the leader of a shingle that they share. Groups beyond ``GROUP_SHINGLES`` are cut into chunks by hash.
4. Before sets are sent, parity bitmaps of about one bit a shingle stand in for them: the bits that differ
   never outnumber the shingles that do, so pairs further apart than a link allows are ruled out,
   and so are pairs that meet at a smaller leader as well. Members without a possible partner go.
5. In a chunk the sets, from the frequent end, form a compressed trie. A set walks down the trie with the
   overlap so far, shared by all sets below, and leaves a subtree when the shingles left on either
   side can no longer reach the wanted overlap, or when it is already connected to all of it.
6. Each chunk is joined with itself and with its group's leader first. Connected components of these links
   leave little to do between chunks: only members outside a group's largest component meet the
   group's other chunks, so that a large cluster of near copies costs in proportion to its size.
7. The links kept are a spanning forest of each group; connected components of all of them are classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SKETCH_BITS = 20
SKETCH_PARTS = 16
GROUP_SHINGLES = 500_000
#: A shingle is frequent if its bucket of the sketch has more hits than this, and than so many times the mean.
HOT_SHINGLES, HOT_TIMES = 20_000, 64
#: Groups of up to so many members are compared pair by pair.
SMALL = 12
SMALLER_LEADERS = 4
TOKEN_BITS = 40


class WordHashes(dict):
    """64-bit hashes of words as they come up; starts anew beyond ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingle_set(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z is lower-cased, words end at ASCII white space."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(words.__getitem__, own)), dtype=np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = C.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def global_order(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set from its rare end."""
    return s[np.lexsort((s, sketch[(s & np.uint64(len(sketch) - 1)).astype(np.int64)]))]


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^k buckets, k the least that gives a bucket to each shingle, 64 at least."""
    size = max(64, 1 << max(len(s) - 1, 0).bit_length())
    bits = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits that differ; a bitmap of twice the width is folded onto the narrower one, as far as both have one."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    if len(a) > len(b):
        x = (x >> (8 * len(b))) ^ (x & ((1 << (8 * len(b))) - 1))
    elif len(b) > len(a):
        y = (y >> (8 * len(a))) ^ (y & ((1 << (8 * len(a))) - 1))
    return (x ^ y).bit_count()


def possible(part: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Which rows of a chunk may link to another one of it that they are not connected to.

    Arrays: n, side, comp (component so far), bits, leaders (some smaller leaders of each member); all of one ``leader``.
    With rows of both sides, only pairs of one of each count.
    """
    n = part["n"].astype(np.int64)
    side, comp = part["side"], part["comp"]
    two = bool((side == 1).any())
    alive = np.zeros(len(n), bool)
    if len(n) < 2 or (comp == comp[0]).all():
        return alive
    if len(n) <= SMALL:
        bits, lists = part["bits"], [set(x) for x in part["leaders"]]
        for i in range(len(n)):
            for j in range(i + 1, len(n)):
                total = int(n[i] + n[j])
                if comp[i] == comp[j] or (two and side[i] == side[j]) or 100 * min(n[i], n[j]) < percent * max(n[i], n[j]) or lists[i] & lists[j]:
                    continue
                if max(len(bits[i]), len(bits[j])) > 2 * min(len(bits[i]), len(bits[j])):
                    continue
                if apart(bits[i], bits[j]) <= total - 2 * -(-percent * total // (100 + percent)):
                    alive[i] = alive[j] = True
        return alive
    smaller: dict[int, int] = {}
    lists = [set(x) for x in part["leaders"]]
    for own in lists:
        for x in own:
            smaller[x] = smaller.get(x, 0) + 1
    # Pairs whose both ends meet at this smaller leader too are decided there.
    best = max(smaller, key=lambda x: (smaller[x], -x), default=None)
    there = np.array([best in own for own in lists]) if best is not None else np.zeros(len(n), bool)
    raw = [np.frombuffer(b, np.uint64) for b in part["bits"]]
    width = np.array([len(r) for r in raw])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        wide = np.flatnonzero(width == 2 * w)
        others = np.concatenate([own, wide])
        bits = np.stack([raw[i] for i in own] + [raw[i][:w] ^ raw[i][w:] for i in wide])
        start = np.argsort(n[others], kind="stable")
        others, bits = others[start], bits[start]
        sizes = n[others]
        ends = np.searchsorted(sizes, 100 * sizes // percent, side="right")
        for k in range(len(others) - 1):
            i = others[k]
            # Partners that are no smaller, as far as the sizes allow.
            j = others[k + 1 : ends[k]]
            if not len(j):
                continue
            ok = (comp[j] != comp[i]) & ((width[i] == w) | (width[j] == w))
            if there[i]:
                ok &= ~there[j]
            if two:
                ok &= side[j] != side[i]
            on = np.flatnonzero(ok)
            if not len(on):
                continue
            j = j[on]
            far = np.bitwise_count(bits[k + 1 + on] ^ bits[k]).sum(axis=1)
            total = n[i] + n[j]
            hit = far <= total - 2 * -(-percent * total // (100 + percent))
            if hit.any():
                alive[i] = True
                alive[j[hit]] = True
    return alive


class Trie:
    """A compressed trie over distinct ascending integer sequences, sorted; a node covers a range of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        lcp = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[:m] != b[:m])
            lcp.append(int(diff[0]) if len(diff) else m)
        # A node: first and last leaf, edge from depth a to depth z of its first leaf, children.
        self.nodes: list[list] = []
        self.root = self._build(lcp)

    def _build(self, lcp: list[int]) -> list[int]:
        """Top nodes; splits ranges at their least common prefix, without recursion."""
        top: list[int] = []
        work = [(0, len(self.sets), 0, top)]
        arr = np.array(lcp)
        while work:
            lo, hi, depth, into = work.pop()
            # Children of one node start where the common prefix falls back to ``depth``.
            cuts = np.flatnonzero(arr[lo + 1 : hi] <= depth) + lo + 1
            starts, ends = [lo, *cuts.tolist()], [*cuts.tolist(), hi]
            for s, e in zip(starts, ends, strict=True):
                end = int(arr[s + 1 : e].min()) if e - s > 1 else len(self.sets[s])
                size = self.size[s:e]
                children: list[int] = []
                into.append(len(self.nodes))
                leaf = s if len(self.sets[s]) == end else -1
                self.nodes.append([s, e, depth, end, int(size.min()), int(size.max()), leaf, children])
                if e - s > 1:
                    work.append((s + (leaf >= 0), e, end, children))
        return top


def _links(sets: list[np.ndarray], sizes: np.ndarray, left: list[int], right: list[int], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and of ``right`` that connect what was not connected: a spanning forest.

    ``group`` has the component of each set so far and is kept up to date.
    """
    trie = Trie([sets[i] for i in left])
    below = np.array([left[i] for i in trie.order])
    mark = np.zeros(1 + max(int(s[-1]) for s in sets), bool)
    out = []
    for x in sorted(right, key=lambda i: (-sizes[i], i)):
        own = sets[x]
        n = len(own)
        mark[own] = True
        work = [(k, 0) for k in trie.root]
        while work:
            k, o = work.pop()
            lo, hi, a, z, low, high, leaf, children = trie.nodes[k]
            if 100 * min(n, high) < percent * max(n, low) and (high < n or low > n):
                continue
            if not (group[below[lo:hi]] != group[x]).any():
                continue
            edge = trie.sets[lo][a:z]
            o += int(np.count_nonzero(mark[edge]))
            if (100 + percent) * (o + high - z) < percent * (n + high):
                continue
            rest = n - int(np.searchsorted(own, edge[-1], side="right")) if z > a else n
            if (100 + percent) * (o + rest) < percent * (n + low):
                continue
            if leaf >= 0 and (100 + percent) * o >= percent * (n + z):
                y = below[leaf]
                if group[y] != group[x]:
                    out.append((int(y), x))
                    group[group == group[y]] = group[x]
            work.extend((c, o) for c in children)
        mark[own] = False
    return out


def group_links(part: dict[str, np.ndarray], sketch: np.ndarray, percent: int, sets_of: Callable[[str], np.ndarray]) -> list[tuple[int, int]]:
    """(a, b) links of one chunk: arrays cls, side (0 or 1), comp and text, whose sets ``sets_of`` gives; one side joins itself."""
    cls, side = part["cls"], part["side"]
    if len(cls) < 2:
        return []
    raw = [sets_of(text) for text in part["text"]]
    tokens, inv = np.unique(np.concatenate(raw), return_inverse=True)
    count = sketch[(tokens & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.int64)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -count))] = np.arange(len(tokens))
    ends = np.cumsum([len(r) for r in raw])
    sets = [np.sort(r) for r in np.split(rank[inv], ends[:-1])]
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(side == 0).tolist()
    right = np.flatnonzero(side == 1).tolist() if (side == 1).any() else left
    _, group = np.unique(part["comp"], return_inverse=True)
    found = _links(sets, sizes, left, right, group, percent) if left else []
    return [(int(cls[i]), int(cls[j])) for i, j in found]


def _linked(keyed: DataFrame, n: int, percent: int, group_shingles: int) -> DataFrame:
    """uid, n, component (the smallest linked uid; the row's own without links) of rows uid and text."""
    spark = keyed.sparkSession
    keyed = keyed.select("uid", "text")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in parts:
            got = []
            for text in part["text"]:
                s = shingle_set(text, n, words)
                np.add.at(sketch, (s & np.uint64(len(sketch) - 1)).astype(np.int64), 1)
                got.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bitmap(s)))
            yield pd.DataFrame({"uid": part["uid"], "n": [g[0] for g in got], "fp": [g[1] for g in got], "bits": [g[2] for g in got], "part": -1})
        for k, piece in enumerate(np.split(sketch, SKETCH_PARTS)):
            yield pd.DataFrame({"uid": [-1], "n": [0], "fp": [piece.tobytes()], "bits": [b""], "part": [k]})

    first = C.materialise(keyed.mapInPandas(scan, "uid long, n long, fp binary, bits binary, part int"), "trie-sets")
    rows = first.filter("part < 0").select("uid", "n", "fp")
    bits = first.filter("part < 0 and n > 0").select("uid", "n", "bits")

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for b in part["fp"]:
            total += np.frombuffer(b, np.uint32)
        return pd.DataFrame({"part": [int(key[0])], "fp": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    pieces = first.filter("part >= 0").select("part", "fp").groupBy("part").applyInPandas(add, "part int, fp binary").collect()
    sketch = np.concatenate([np.frombuffer(r["fp"], np.uint32) for r in sorted(pieces)]) if pieces else np.zeros(1 << SKETCH_BITS, np.uint32)
    shared = spark.sparkContext.broadcast(sketch)  # 4 MB whatever the corpus

    # Only sets that several rows have need a join to find who stands for them; written out, so that a hot one can be split.
    several = rows.filter("n > 0").groupBy("fp", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("c")).filter("c > 1").drop("c")
    several = C.materialise(several, "trie-several")
    rows = C.materialise(rows.join(several, ["fp", "n"], "left").select("uid", "n", F.coalesce("rep", "uid").alias("rep")), "trie-classes")

    # Shingles whose bucket is hit far more often than others may fill a task by themselves; they take a way of their own.
    hot = max(HOT_SHINGLES, HOT_TIMES * int(sketch.astype(np.uint64).sum()) // len(sketch))

    def post(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sketch = WordHashes(), shared.value
        for part in parts:
            tokens, owner = [], []
            for uid, text in zip(part["uid"], part["text"], strict=True):
                s = shingle_set(text, n, words)
                if len(s):
                    own = global_order(s, sketch)[: len(s) - -(-percent * len(s) // 100) + 1]
                    tokens.append(own)
                    owner.append(np.full(len(own), uid, np.int64))
            if tokens:
                token = np.concatenate(tokens)
                often = sketch[(token & np.uint64(len(sketch) - 1)).astype(np.int64)] > hot
                # Forty bits do to name those that meet; what else shares them is told apart by the sets.
                yield pd.DataFrame({"uid": np.concatenate(owner), "token": (token >> np.uint64(64 - TOKEN_BITS)).view(np.int64), "often": often})

    posts = C.materialise(keyed.mapInPandas(post, "uid long, token long, often boolean"), "trie-posts")
    leads = lambda p: p.groupBy("token").agg(F.min("uid").alias("leader"), F.max("uid").alias("last")).filter("leader < last").select("token", "leader")
    # The copies of one text have its smallest row as leader, which stands for them. Rare shingles are dealt out once: what finds the
    # leaders and what meets them read the same shuffle. Of frequent ones the leaders are combined before the shuffle, and the join can be split.
    rare = posts.filter("not often and token is not null and uid is not null").select("uid", "token").repartition("token")
    frequent = posts.filter("often").select("token", "uid")
    meets = lambda p, lead: p.join(lead, "token").filter("leader <> uid").select("leader", "uid")
    pairs = meets(rare, leads(rare)).unionByName(meets(frequent, C.materialise(leads(frequent), "trie-leaders"))).distinct()
    members = pairs.join(rows.select("uid", "rep"), "uid").filter("rep <> leader").select("leader", F.col("rep").alias("cls")).distinct()
    members = members.join(bits.select(F.col("uid").alias("cls"), "n"), "cls")
    # Some smaller leaders of each class: pairs that share one are decided there.
    per_class = members.groupBy("cls").agg(F.collect_set("leader").alias("leaders"))
    per_class = per_class.select("cls", F.slice(F.array_sort("leaders"), 1, SMALLER_LEADERS).alias("leaders"))
    members = C.materialise(members.join(per_class, "cls").select("leader", "cls", "n", F.filter("leaders", lambda x: x < F.col("leader")).alias("leaders")), "trie-members")
    sizes = members.groupBy("leader").agg(F.sum("n").alias("total"), F.count("*").alias("m")).join(bits.select(F.col("uid").alias("leader"), "n"), "leader")
    sizes = C.materialise(sizes.select("leader", "n", "m", F.ceil(F.col("total") / group_shingles).cast("int").alias("c")), "trie-sizes")
    m, tasks = members.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-m // 20_000))
    chunk = F.pmod(F.xxhash64("cls"), F.col("c")).cast("int")
    no_leaders = F.array().cast("array<long>")
    at = members.join(sizes.select("leader", "c"), "leader").select("leader", chunk.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "cls", F.col("cls").alias("comp"), "leaders")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("leader").alias("cls"), F.col("leader").alias("comp"), no_leaders.alias("leaders"))

    def sift(part: dict[str, np.ndarray]) -> list[tuple]:
        on = np.flatnonzero(possible(part, percent))
        return [(part["leader"][k], part["i"][k], part["j"][k], part["side"][k], part["cls"][k], part["comp"][k]) for k in on]

    words = WordHashes()  # each task has its own

    def link(part: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        return group_links(part, shared.value, percent, lambda text: shingle_set(text, n, words))

    def joined(at: DataFrame, name: str) -> DataFrame:
        """Links (a, b) of chunks: leader, i, j, side, cls, comp, leaders."""
        keys = ["leader", "i", "j"]
        with_bits = at.join(bits.withColumnRenamed("uid", "cls"), "cls")
        left = C.by_group(with_bits, keys, sift, "leader long, i int, j int, side int, cls long, comp long", tasks)
        left = C.materialise(left, f"{name}-partners")
        # Texts are sent and not their sets: they are shorter, and compress.
        wanted = left.select(F.col("cls").alias("uid")).distinct()
        # Few texts are wanted, and only those and what the bitmap cannot tell from them are shuffled, at any size.
        texts = C.marked(keyed, "uid", wanted).filter("_maybe").join(wanted.hint("merge"), "uid", "left_semi").select(F.col("uid").alias("cls"), "text")
        links = C.by_group(left.join(texts, "cls"), keys, link, "a long, b long", tasks)
        return C.materialise(links.distinct(), f"{name}-links")

    links = joined(at.unionByName(heads), "trie-inner")
    found = components(links)
    large = sizes.filter("c > 1")
    if large.limit(1).count():
        # Between the chunks of a group: its members outside its largest component against all.
        inside = members.join(large.select("leader", "c"), "leader").select("leader", "cls", "n", "c", "leaders")
        inside = inside.unionByName(large.select("leader", F.col("leader").alias("cls"), "n", "c", no_leaders.alias("leaders")))
        inside = inside.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        inside = C.materialise(inside, "trie-inside")
        most = inside.groupBy("leader", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        most = most.groupBy("leader").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.max_by("total", F.struct("k", "comp")).alias("main_n"), F.sum("total").alias("all_n"))
        most = C.materialise(most.filter("main_n < all_n").withColumn("r", F.ceil((F.col("all_n") - F.col("main_n")) / group_shingles).cast("int")).select("leader", "main", "r"), "trie-most")
        inside = inside.join(most, "leader")
        cols = ["leader", "i", "j", "side", "cls", "comp", "leaders"]
        some = inside.filter("comp <> main").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("r")).cast("int")).withColumn("side", F.lit(0))
        some = some.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(*cols)
        every = inside.withColumn("j", chunk).withColumn("side", F.lit(1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).select(*cols)
        links = links.unionByName(joined(some.unionByName(every), "trie-outer"))
        found = components(links)
    return rows.join(found, F.col("rep") == F.col("node"), "left").select("uid", "n", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when ``100 * |intersection| >= percent * |union|`` of their distinct n-word shingles.
    Null and empty texts and texts without words have no shingles and no links; a text of fewer words is
    one shingle. Every row is linked by its own text, also where ids are null or repeat; its component_id
    is the smallest doc_id among the rows that it reaches, null if none of them has one. An empty table
    gives no rows; extra columns are ignored.
    """
    keyed, unique = C.identified(docs.select("doc_id", "text"), "trie-keyed")
    found = _linked(keyed, n, percent, group_shingles)
    if unique:
        return found.select(F.col("uid").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    found = C.materialise(found.join(keyed.select("uid", "doc_id"), "uid"), "trie-found")
    least = C.materialise(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "trie-least")
    return found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int, percent: int, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does: its row with the smallest doc_id, rows without id last.

    Columns are those of ``docs``. Rows without shingles are components of their own, so all of them stay.
    """
    keyed, _ = C.identified(docs, "trie-keyed")
    found = _linked(keyed, n, percent, group_shingles)
    # Numbers follow doc_id, nulls last, so the smallest number of a component is the row that stays.
    kept = C.materialise(found.filter("uid = component").select("uid"), "trie-kept")
    # Nearly every row stays, so that their numbers grow with the table: a shuffle at any size.
    return keyed.join(kept.hint("merge"), "uid", "left_semi").select(*docs.columns)


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
