"""Packing into few sequences: Martello-Toth dominance reduction, then best fit.

Documents become token ids and an end mark; only those longer than a sequence are cut. What is packed is a histogram: a
sequence of ``LENGTH`` tokens has room for pieces of at most so many lengths, so the driver plans for all documents at
once from at most ``LENGTH`` counts, whatever their number. The plan gives runs of sequence numbers to runs of pieces of one length;
Spark numbers the pieces of each length and joins them to the plan.

The reduction looks at the lengths from the longest on. It fixes a set of at most three pieces if no other set with the
first of them can be better (each such set could be exchanged, piece by piece or pieces for a piece, against the fixed
one), as often as the counts allow, and starts again until nothing can be fixed. The rest is packed best-fit decreasing.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import common as C

LENGTH = 4096
END = 1
#: Encoded parts of texts that a Python worker keeps; it forgets all when there are more. Longer parts are not kept.
KEPT_WORDS, KEPT_SIGNS = 500_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these signs alone are cut here: lower-casing and composing them is the same for every tool, and no special token is in them.
_LETTERS, _NUMBERS, _SPACES = r"a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \u00a0"
_UNSURE = re.compile(r"[^\t-\r -~\u00a0-\u012f\u0131-\u0148\u014a-\u017e]|<\|").search
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+").findall
#: How a vocabulary must cut texts for ``_PARTS`` to do the same.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Words(dict):
    """Ids (little-endian unsigned 32 bits) by part of a text; parts are merged each on its own, so most of them are found here.

    Texts with other signs, or with what may be a special token, go to the tokenizer whole, and so do all with another kind of vocabulary.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.known = (spec["normalizer"] or {}).get("normalizers") == _NORMAL and cut[0].get("pattern") == {"Regex": _CUTS} and cut[0].get("behavior") == "Removed" and cut[1].get("type") == "ByteLevel" and len(cut) == 2
        self.merged = self.tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.merged(part if part.isascii() else "".join(map(_BYTE.__getitem__, part.encode())))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= KEPT_SIGNS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[part] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.known and not _UNSURE(text):
            return b"".join(map(self.__getitem__, _PARTS(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_WORDS: dict[int, Words] = {}


def _words(vocabulary: str) -> Words:
    """One for each Python worker."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _WORDS:
        _WORDS[key] = Words(vocabulary)
    return _WORDS[key]


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, where wanted, ids; part and k number the pieces of one length.

    Null and empty texts are the end mark alone. Ids may be null or repeat; repeated rows are cut each; other columns are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_text())  # one vocabulary file
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length int, ids_crc32 long, part int, k long" + (", ids array<int>" if with_ids else "")
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _words(sent.value), TaskContext.get().partitionId(), Counter()
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, 1000):
                own: list[list] = [[] for _ in range(6)]
                ids = []
                for r in range(at, min(at + 1000, b.num_rows)):
                    raw = words.encode(texts[r].as_py()) + mark
                    for p in range(0, len(raw), 4 * length):
                        cut = raw[p : p + 4 * length]
                        n = len(cut) // 4
                        for col, value in zip(own, (r, p // (4 * length), p // 4, n, zlib.crc32(cut), seen[n]), strict=True):
                            col.append(value)
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                rows, piece, start, size, crc, k = own
                arrays = [
                    b.column("doc_id").take(pa.array(rows, pa.int32())).cast(id_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()),
                    pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(k, pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Counts:
    """How many pieces of each length are left, and these lengths, rising."""

    def __init__(self, sizes: dict[int, int]):
        self.left = {s: n for s, n in sizes.items() if n}
        self.lengths = np.array(sorted(self.left), dtype=np.int64)

    def take(self, group: tuple[int, ...]) -> int:
        """Takes the group as often as it is there; how often."""
        need = Counter(group)
        times = min(self.left.get(s, 0) // c for s, c in need.items())
        for s, c in need.items():
            self.left[s] -= times * c
            if not self.left[s]:
                del self.left[s]
                self.lengths = self.lengths[self.lengths != s]
        return times


def dominating(left: dict[int, int], lengths: np.ndarray, first: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``first`` that dominates all others with it, or None. ``lengths`` are those of ``left``, rising."""

    def there(size: int, used: tuple[int, ...] = ()) -> int:
        return left.get(size, 0) - (size == first) - used.count(size)

    room = capacity - first
    # How many of the smallest other pieces fit, up to three.
    fits, used = 0, 0
    for s in lengths.tolist():
        if fits >= 3 or used + s > room:
            break
        n = min(there(s), 3 - fits, (room - used) // s)
        fits, used = fits + n, used + n * s
    if not fits:
        return (first,)
    at = int(np.searchsorted(lengths, room, side="right")) - 1
    while there(int(lengths[at])) < 1:
        at -= 1
    best = int(lengths[at])
    if fits == 1 or best == room:
        return (first, best)
    if fits > 2:
        return None
    # The two pieces with the largest sum that fit: for each size the largest other one.
    partner = np.searchsorted(lengths, room - lengths, side="right") - 1
    pair: tuple[int, int] | None = None
    for i, p in enumerate(partner.tolist()):
        a = int(lengths[i])
        if p < 0 or there(a) < 1:
            continue
        while p >= 0 and there(int(lengths[p]), (a,)) < 1:
            p -= 1
        if p >= 0 and (pair is None or a + int(lengths[p]) > sum(pair)):
            pair = (a, int(lengths[p]))
    a, b = max(pair), min(pair)
    if best >= a + b:
        return (first, best)
    if best != a:
        return None
    # Between the last piece as long as a and the first as long as b: at most one, or no two of them fit.
    between: list[int] = []
    for s in lengths[(lengths > b) & (lengths < a)].tolist():
        between += [s] * min(there(s), 2 - len(between))
        if len(between) == 2:
            break
    if a == b or len(between) < 2 or sum(between) > room:
        return (first, a, b)
    return None


def reduce(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets that are fixed with how often, what is left)."""
    counts, fixed = Counts(sizes), []
    again = True
    while again:
        again = False
        for first in sorted(counts.left, reverse=True):
            while counts.left.get(first):
                group = dominating(counts.left, counts.lengths, first, capacity)
                if group is None:
                    break
                fixed.append((group, counts.take(group)))
                again = True
    return fixed, counts.left


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, first, last, sequence, each, offset) rows and the number of sequences.

    The pieces of a length, numbered from 0: those from ``first`` to before ``last`` go to sequences from ``sequence`` on, ``each`` of
    them one behind the other in a sequence, from ``offset``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    given: Counter = Counter()
    n_sequences = 0

    def put(size: int, count: int, sequence: int, each: int, offset: int) -> None:
        rows.append((size, given[size], given[size] + count * each, sequence, each, offset))
        given[size] += count * each

    fixed, left = reduce(sizes, capacity)
    for group, times in fixed:
        offset = 0
        for size, each in sorted(Counter(group).items(), reverse=True):
            put(size, times, n_sequences, each, offset)
            offset += size * each
        n_sequences += times
    # Best fit decreasing: runs of sequences by their room; a piece goes where the least room is left.
    rooms: dict[int, list[tuple[int, int]]] = {}
    for size in sorted(left, reverse=True):
        todo = left[size]
        for room in sorted(r for r in rooms if r >= size):
            each = room // size
            runs, rooms[room] = rooms[room], []
            while runs and todo:
                start, count = runs.pop()
                full = min(count, todo // each)
                if full:
                    put(size, full, start, each, capacity - room)
                    rooms.setdefault(room - each * size, []).append((start, full))
                    todo -= full * each
                    start, count = start + full, count - full
                if count and todo and todo < each:
                    put(size, 1, start, todo, capacity - room)
                    rooms.setdefault(room - todo * size, []).append((start, 1))
                    todo, start, count = 0, start + 1, count - 1
                if count:
                    runs.append((start, count))
            rooms[room] += runs
            if not rooms[room]:
                del rooms[room]
            if not todo:
                break
        if todo:
            each = capacity // size
            for count, own in ((todo // each, each), (1 if todo % each else 0, todo % each)):
                if count:
                    put(size, count, n_sequences, own, 0)
                    rooms.setdefault(capacity - own * size, []).append((n_sequences, count))
                    n_sequences += count
        rooms.pop(0, None)
    return rows, n_sequences


def pack(cut: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """The rows of ``pieces``, written out, with sequence_id and offset (the tokens before the piece in its sequence) instead of part and k."""
    spark = cut.sparkSession
    cut = C.materialise(cut, "pieces")
    counts = C.materialise(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows, _ = plan(sizes, capacity)
    # A sequence holds fewer than a hundred different lengths, so the plan has a bounded number of rows for each length.
    runs = F.broadcast(spark.createDataFrame(rows, "_size int, _first long, _last long, _sequence long, _each long, _offset long"))
    at = F.col("k") + F.col("_before")
    placed = cut.join(starts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("_at", at)
    placed = placed.join(runs, (F.col("length") == F.col("_size")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_last")))
    nth = F.col("_at") - F.col("_first")
    kept = [c for c in cut.columns if c not in ("part", "k")]
    return placed.select(*kept, (F.col("_sequence") + F.floor(nth / F.col("_each")).cast("long")).alias("sequence_id"), (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``packed`` pieces with ids: sequence_id, input_ids, cu_seqlens, doc_ids, starts."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    rows = packed.groupBy("sequence_id").agg(own.alias("s"))
    ends = F.transform("s", lambda x: (x["offset"] + F.size(x["ids"])).cast("int"))
    return rows.select(
        "sequence_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("input_ids"), F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"),
        F.transform("s", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("s", lambda x: x["start"]).alias("starts"),
    )


def op12_martello_toth_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(pieces(C.table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
