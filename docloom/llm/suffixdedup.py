"""Exact removal of repeated 100-byte strings by sparse suffix arrays with deep-shallow sorting.

Two equal strings of ``LENGTH`` bytes contain the same anchors: positions whose hashed ``GRAM`` bytes
are the least in some stretch of ``LENGTH - GRAM + 1`` positions. So only suffixes at anchors are compared:
an anchor with ``LEFT`` bytes before and ``LENGTH`` bytes from it on holds every string around it.

1. Anchors of all documents are dealt by hash. One that occurs once is dropped. Of those with equal
   surroundings (128 bits of hash over all bytes and the lengths at the document's ends; their bytes are not
   compared) the earliest remains and the strings around the others all start earlier. Batches combine
   equal surroundings before they are sent. An anchor that a batch of ``BATCH_ANCHORS`` has with more than
   ``HOT_ROWS`` differing surroundings is dealt by these instead, so that no task has to hold it.
2. The anchors that remain with differing surroundings are sorted twice, by the bytes from them on and by those
   before them read backwards: multikey quicksort on eight-byte words down to ``SHALLOW`` bytes, then
   blind tries for groups whose common prefix is deeper.
   An anchor with more than ``HOT_KINDS`` differing surroundings, or dealt by them, is not sorted in one task: the
   strings around its occurrences are dealt by 128 bits of hash over their bytes, and all but the earliest of a hash are repeats.
3. The common prefixes of neighbours in both orders give the classes of equal strings at every
   offset, and in each class all but the earliest string are repeats.
4. Repeats are joined to their documents and their bytes removed.

No step compares all pairs of a group. A task of step 1 holds at most ``HOT_ROWS`` rows of 33 bytes of an anchor for
each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
GRAM = 32
LEFT = LENGTH - GRAM
SHALLOW = 48
PART_BYTES = 12_000_000
HOT_KINDS = 10_000
BATCH_ANCHORS = 200_000
HOT_ROWS = 32

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every stretch of ``width`` values, by doubling."""
    n, cur, span = len(a) - width + 1, a, 1
    while span * 2 <= width:
        cur = op(cur[:-span], cur[span:])
        span *= 2
    return op(cur[:n], cur[width - span : width - span + n])


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position on."""
    n = len(b) - GRAM + 1
    raw = np.lib.stride_tricks.sliding_window_view(b, 8)
    words = np.ascontiguousarray(raw).view("<u8")[:, 0]
    h = np.zeros(n, np.uint64)
    for i, odd in enumerate(_ODD[: GRAM // 8]):
        h = (h ^ (words[8 * i : 8 * i + n] * odd)) * _ODD[0]
        h ^= h >> np.uint64(29)
    return C.mix64(h)


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one document."""
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b)
    least = _slide(h, LEFT + 1, np.minimum)
    pad = np.zeros(LEFT, np.uint64)
    pos = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum) == h)
    return pos, h[pos]


def surroundings(b: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """LEFT + LENGTH bytes around each position, zeros beyond the ends."""
    wide = np.concatenate([np.zeros(LEFT, np.uint8), b, np.zeros(LENGTH, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, LEFT + LENGTH)[pos])


def _around(b: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """64-bit hashes of the surroundings and of their lengths."""
    words = surroundings(b, pos).view("<u8")
    h = np.minimum(pos, LEFT).astype(np.uint64) * np.uint64(1009) + np.minimum(len(b) - pos, LENGTH).astype(np.uint64)
    for i in range(words.shape[1]):
        h = C.mix64(h * _ODD[0] + words[:, i])
    return h


def string_hashes(b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the LENGTH bytes from each start on."""
    raw = np.lib.stride_tricks.sliding_window_view(b, 8)
    words = np.ascontiguousarray(raw).view("<u8")[:, 0]
    one, two = np.full(len(start), _ODD[2]), np.full(len(start), _ODD[3])
    for i in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        w = words[start + i]
        one = C.mix64(one * _ODD[0] + w)
        two = C.mix64(two * _ODD[1] ^ w)
    return one, two


# --- deep-shallow sorting ---------------------------------------------------------------------


def _first_difference(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie_sort(strings: list[bytes]) -> list[int]:
    """Indices of equal-length strings in order; equal strings keep theirs.

    The trie branches at distinguishing positions only. A string first walks down comparing just the
    branching bytes, is compared once with the leaf it meets, and goes in where the two first differ.
    """
    root: list | None = None  # [depth, {byte: child}] or [-1, [indices]]
    for i, s in enumerate(strings):
        if root is None:
            root = [-1, [i]]
            continue
        node = root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if other == s:
            node[1].append(i)
            continue
        d = _first_difference(s, other)
        parent, node = None, root
        while 0 <= node[0] < d:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == d:
            node[1][s[d]] = [-1, [i]]
        else:
            fresh = [d, {other[d]: node, s[d]: [-1, [i]]}]
            if parent is None:
                root = fresh
            else:
                parent[1][s[parent[0]]] = fresh
    out: list[int] = []
    work = [root] if root else []
    while work:
        node = work.pop()
        if node[0] < 0:
            out.extend(node[1])
        else:
            work.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def deep_shallow_sort(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix."""
    n, width = rows.shape
    order = np.arange(n)
    shallow = min(SHALLOW, width) // 8 * 8
    words = np.ascontiguousarray(rows[:, :shallow]).view(">u8").astype(np.uint64)
    # Multikey quicksort, all its groups at once: a word orders rows inside groups that agree so far.
    group = np.zeros(n, np.int64)
    live = order
    for k in range(words.shape[1]):
        if not len(live):
            break
        own = live[np.lexsort((words[order[live], k], group[live]))]
        order[live] = order[own]
        group[live] = group[own]
        new = np.ones(n, bool)
        key = words[order, k]
        new[1:] = (group[1:] != group[:-1])
        inside = np.zeros(n, bool)
        inside[live] = True
        new[1:] |= (key[1:] != key[:-1]) & inside[1:]
        group = np.cumsum(new) - 1
        sizes = np.bincount(group, minlength=1)
        live = np.flatnonzero(sizes[group] > 1)
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if n else np.zeros(0, int)
    for s, e in zip(starts, np.append(starts[1:], n), strict=True):
        if e - s > 1 and shallow < width:
            own = order[s:e]
            order[s:e] = own[blind_trie_sort([r.tobytes() for r in rows[own, shallow:]])]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in the order."""
    a = rows[order]
    differ = a[1:] != a[:-1]
    out = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], out])


def repeats(around: np.ndarray, doc: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (index, start, end): bytes of repeated strings around each anchor.

    ``around`` are surroundings, ``size`` the documents' lengths; rows may come in any order.
    """
    by_place = np.lexsort((pos, doc))
    around, doc, pos, size = around[by_place], doc[by_place], pos[by_place], size[by_place]
    before, behind = np.minimum(pos, LEFT), np.minimum(size - pos, LENGTH)
    right = around[:, LEFT:]
    left = np.ascontiguousarray(around[:, :LEFT][:, ::-1])
    right_order, left_order = deep_shallow_sort(right), deep_shallow_sort(left)
    right_lcp, left_lcp = common_prefixes(right, right_order), common_prefixes(left, left_order)
    n = len(pos)
    least = np.full(n, LENGTH)
    most = np.full(n, -1)
    for a in range(LEFT + 1):
        on = np.flatnonzero((before >= a) & (behind >= LENGTH - a))
        if len(on) < 2:
            continue
        # Classes of equal bytes on either side, from the sorted orders.
        rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
        rc[right_order] = np.cumsum(right_lcp < LENGTH - a)
        lc[left_order] = np.cumsum(left_lcp < a)
        key = rc[on] * (n + 1) + lc[on]
        _, first, inv = np.unique(key, return_index=True, return_inverse=True)
        head = on[first[inv]]
        again = on[(doc[on] != doc[head]) | (pos[on] != pos[head])]
        least[again] = np.minimum(least[again], a)
        most[again] = a
    hit = np.flatnonzero(most >= 0)
    return np.stack([by_place[hit], pos[hit] - most[hit], pos[hit] - least[hit] + LENGTH], axis=1)


# --- jobs -------------------------------------------------------------------------------------

#: ``k`` is one of these.
PLAIN, KNOWN_REPEAT, HOT, HOT_MARK = range(4)
_ANCHOR = np.dtype([("h", "<u8"), ("a", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("k", "u1")])
_AROUND = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("size", "<u4"), ("s", "u1", (LEFT + LENGTH,))])


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)


def _dealt(rows: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    heads = part[np.concatenate([[0], cuts])]
    return pd.DataFrame({"part": heads.astype(np.int64), "rows": [_packed(x) for x in np.split(rows, cuts)]})


def _packed(rows: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        one = kind[f]
        out[f] = np.frombuffer(data, one.base, n * one.itemsize // one.base.itemsize, at).reshape(n, *one.shape)
        at += n * one.itemsize
    return out


def _combined(x: np.ndarray, parts: int, hot_rows: int) -> pd.DataFrame:
    """The anchors of a batch, dealt: repeats inside it are marked, and hot anchors dealt by their surroundings."""
    x = x[np.lexsort((x["pos"], x["doc"], x["a"], x["h"]))]
    new_h = np.ones(len(x), bool)
    new_h[1:] = x["h"][1:] != x["h"][:-1]
    new_a = new_h.copy()
    new_a[1:] |= x["a"][1:] != x["a"][:-1]
    h_of = np.cumsum(new_h) - 1
    hot = np.bincount(h_of, weights=new_a)[h_of] > hot_rows
    x["k"][hot] = HOT
    x["k"][~new_a] = KNOWN_REPEAT
    mark = x[hot & new_h].copy()
    mark["k"] = HOT_MARK
    x = np.concatenate([x, mark])
    key = np.where(x["k"] == HOT, C.mix64(x["h"] * _ODD[0] + x["a"]), np.where(x["k"] == KNOWN_REPEAT, C.mix64(x["doc"].astype(np.uint64)), x["h"] >> np.uint64(32)))
    return _dealt(x, key % np.uint64(parts))


def _compared(x: np.ndarray, hot_kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and codes, position * 3 + kind, of the anchors of a part: 0 is a repeat, 1 is to be sorted, 2 is around a hot anchor."""
    known, marked = x[x["k"] == KNOWN_REPEAT], np.unique(x["h"][x["k"] == HOT_MARK])
    x = x[(x["k"] == PLAIN) | (x["k"] == HOT)]
    x = x[np.lexsort((x["pos"], x["doc"], x["a"], x["h"]))]
    new_h = np.ones(len(x), bool)
    new_h[1:] = x["h"][1:] != x["h"][:-1]
    new_a = new_h.copy()
    new_a[1:] |= x["a"][1:] != x["a"][:-1]
    kinds = np.bincount(np.cumsum(new_h) - 1, weights=new_a)[np.cumsum(new_h) - 1] if len(x) else np.zeros(0)
    hot = (kinds > hot_kinds) | (x["k"] == HOT) | np.isin(x["h"], marked)
    sort = new_a & ((kinds > 1) | hot)
    both = np.concatenate([known, x[~new_a], x[sort]])
    kind = np.concatenate([np.zeros(len(known) + (~new_a).sum(), np.int64), np.where(hot[sort], 2, 1)])
    return both["doc"], both["pos"].astype(np.int64) * 3 + kind


def remove_repeats(docs: DataFrame, hot_kinds: int = HOT_KINDS, hot_rows: int = HOT_ROWS, with_bytes: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_bytes``, kept (the remaining bytes).

    Null and empty texts have no bytes. Rows with a null doc_id have no place in the order of
    documents: they lose nothing and cause no loss. Rows that repeat a doc_id and its text are one
    document and get the same result; texts that share an id are documents of their own, in the order
    of a hash. An empty table gives no rows; extra columns are ignored.
    """
    keyed, unique = C.identified(docs.select("doc_id", "text"), "suffix-keyed")
    if unique:
        named, rows = keyed.select("uid", "text"), keyed
    else:
        first = keyed.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.min("uid").alias("first"))
        first = C.materialise(first.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"), "first"), "suffix-first")
        named = first.select(F.col("first").alias("uid"), F.col("_t").alias("text"))
        rows = keyed.join(first, (F.col("doc_id") == F.col("_d")) & F.col("text").eqNullSafe(F.col("_t")), "left").select(F.col("first").alias("uid"), "doc_id", "text")
    marks = _marks(named, hot_kinds, hot_rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own, ranges in zip(batch["text"], batch["codes"], batch["found"], strict=True):
                b = _bytes(text)
                steps = np.zeros(len(b) + 1, np.int64)
                if own is not None and len(own):
                    pos = np.asarray(own, np.int64) // 3
                    a, z = np.maximum(pos - LEFT, 0), np.minimum(pos + LENGTH, len(b))
                    far = z - a >= LENGTH
                    np.add.at(steps, a[far], 1)
                    np.add.at(steps, z[far], -1)
                if ranges is not None and len(ranges):
                    np.add.at(steps, np.minimum([r["start"] for r in ranges], len(b)), 1)
                    np.add.at(steps, np.minimum([r["end"] for r in ranges], len(b)), -1)
                gone = np.cumsum(steps[:-1]) > 0
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
                kept = b[~gone].tobytes()
                out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *((kept,) if with_bytes else ())))
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept",) if with_bytes else ())])
            got.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield got

    rows = rows.join(marks, "uid", "left").select("doc_id", "text", "codes", "found")
    return rows.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def _marks(named: DataFrame, hot_kinds: int, hot_rows: int) -> DataFrame:
    """What goes of each document (uid, text; earlier ones have smaller numbers): uid, codes of repeated anchors, found (ranges)."""
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch["uid"], batch["text"], strict=True):
                b = _bytes(text)
                pos, h = anchors(b)
                if not len(pos):
                    continue
                rows = np.zeros(len(pos), _ANCHOR)
                rows["h"], rows["a"], rows["doc"], rows["pos"] = h, _around(b, pos), doc, pos
                out.append(rows)
                held += len(rows)
                if held > BATCH_ANCHORS:
                    yield _combined(np.concatenate(out), parts, hot_rows)
                    out, held = [], 0
            if out:
                yield _combined(np.concatenate(out), parts, hot_rows)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        doc, code = _compared(np.concatenate([_unpacked(b, _ANCHOR) for b in part["rows"]]), hot_kinds)
        return pd.DataFrame({"uid": doc, "code": code})

    codes = named.mapInPandas(find, "part long, rows binary").groupBy("part").applyInPandas(compare, "uid long, code long")
    codes = C.materialise(codes.groupBy("uid").agg(F.collect_list("code").alias("codes")), "suffix-anchors")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, keys, held = [], [], 0
            for doc, text, own in zip(batch["uid"], batch["text"], batch["codes"], strict=True):
                b = _bytes(text)
                pos = np.unique(np.asarray(own, np.int64))
                pos = pos[pos % 3 == 1] // 3
                pos = pos[pos + GRAM <= len(b)]
                rows = np.zeros(len(pos), _AROUND)
                rows["doc"], rows["pos"], rows["size"], rows["s"] = doc, pos, len(b), surroundings(b, pos)
                out.append(rows)
                grams = np.ascontiguousarray(rows["s"][:, LEFT : LEFT + GRAM]).view("<u8")
                h = np.zeros(len(pos), np.uint64)
                for i in range(grams.shape[1]):
                    h = C.mix64(h * _ODD[0] + grams[:, i])
                keys.append(h % np.uint64(parts))
                held += rows.nbytes
                if held > 8_000_000:
                    yield _dealt(np.concatenate(out), np.concatenate(keys))
                    out, keys, held = [], [], 0
            if held:
                yield _dealt(np.concatenate(out), np.concatenate(keys))

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([_unpacked(b, _AROUND) for b in part["rows"]])
        got = repeats(x["s"], x["doc"], x["pos"].astype(np.int64), x["size"].astype(np.int64))
        return pd.DataFrame({"uid": x["doc"][got[:, 0]], "start": got[:, 1], "end": got[:, 2]})

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc, text, own in zip(batch["uid"], batch["text"], batch["codes"], strict=True):
                b = _bytes(text)
                pos = np.unique(np.asarray(own, np.int64))
                pos = pos[pos % 3 == 2] // 3
                start = np.unique((pos[:, None] - np.arange(LEFT + 1)).ravel())
                start = start[(start >= 0) & (start + LENGTH <= len(b))]
                if len(start):
                    one, two = string_hashes(b, start)
                    out.append(np.stack([one.view(np.int64), two.view(np.int64), np.full(len(start), doc), start], axis=1))
                    held += len(start)
                if held > 200_000:
                    yield pd.DataFrame(np.concatenate(out), columns=["one", "two", "uid", "start"])
                    out, held = [], 0
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["one", "two", "uid", "start"])

    unsorted = codes.filter(F.exists("codes", lambda c: c % 3 == 1))
    found = named.join(unsorted, "uid").mapInPandas(extract, "part long, rows binary").groupBy("part").applyInPandas(sort, "uid long, start long, end long")
    hot = codes.filter(F.exists("codes", lambda c: c % 3 == 2))
    hot = C.materialise(named.join(hot, "uid").mapInPandas(strings, "one long, two long, uid long, start long"), "suffix-hot")
    least = hot.groupBy("one", "two").agg(F.min(F.struct("uid", "start")).alias("head"), F.max(F.struct("uid", "start")).alias("tail"))
    least = C.materialise(least.filter("head != tail").select("one", "two", "head"), "suffix-least")  # written out, so that a hot string can be split
    again = hot.join(least, ["one", "two"]).filter(F.struct("uid", "start") != F.col("head"))
    found = found.unionByName(again.select("uid", "start", (F.col("start") + LENGTH).alias("end")))
    found = found.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    marks = codes.select("uid", F.filter("codes", lambda c: c % 3 == 0).alias("codes")).join(found, "uid", "full")
    return C.materialise(marks, "suffix-marks")


def op7_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"), with_bytes=False)
