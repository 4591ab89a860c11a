"""Token-id output by best-fit-decreasing packing.

Texts are tokenised with a public byte-level BPE vocabulary. A document of more than ``length`` tokens
is split without loss: whole rows of ``length`` tokens and a rest. Rests and short documents are
packed best-fit decreasing: longest first, each into the open row with the least room that still holds
it. A segment tree over room sizes, 0 to ``length``, finds that row in logarithmic time.

Rows are packed inside a task, from buffers of at most ``BUFFER_TOKENS`` tokens, so that token ids never
cross the network; only the last rows of a task's buffer stay partly empty (``fill_rate`` tells how much).

``write_matrices`` writes packed rows as binary: blocks of a row-major int32 matrix of ids, the rows'
cumulative segment lengths and the positions, which restart with each segment.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

LENGTH = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END, PAD = 50256, 50256
BUFFER_TOKENS = 4_000_000

#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Token ids of whole texts."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text) if text else [], np.int32)

    def decode(self, ids) -> str:
        return self.encoding.decode([int(i) for i in ids])


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    """One for each Python worker: the vocabulary is read once, not by each task."""
    return Tokenizer(path)


class RoomTree:
    """Open rows by free room; ``take`` finds the least room that is large enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, d: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += d
            k >>= 1

    def put(self, room: int, row: int) -> None:
        heapq.heappush(self.rows[room], row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= need, the lowest row of these."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and not (k % 2 == 0 and self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return room, heapq.heappop(self.rows[room])


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices; every size is between 1 and ``length``."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        if got is None:
            rows.append([i])
            room = length - sizes[i]
            row = len(rows) - 1
        else:
            rows[got[1]].append(i)
            room, row = got[0] - sizes[i], got[1]
        if room:
            tree.put(room, row)
    return rows


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per packed row: input_ids (padded to ``length``), n_tokens, cu_seqlens, position_ids, doc_ids, starts.

    Segment k of a row is ``input_ids[cu_seqlens[k]:cu_seqlens[k + 1]]``; it holds the tokens of document
    ``doc_ids[k]`` from ``starts[k]`` on, and ``position_ids`` restart at 0 with each segment and in the padding. A
    document's tokens end with an end mark. Null and empty texts are the end mark alone. Null ids stay
    null; repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    ids_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"input_ids array<int>, n_tokens int, cu_seqlens array<int>, position_ids array<int>, doc_ids array<{kind}>, starts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(vocabulary)
        positions = np.arange(length, dtype=np.int32)
        pieces: list[tuple] = []
        held = 0

        def written(rows: list[list[tuple]]) -> pa.RecordBatch:
            ids = np.full((len(rows), length), PAD, np.int32)
            pos = np.zeros((len(rows), length), np.int32)
            ends = []
            for r, segments in enumerate(rows):
                at = [0]
                for _, _, own in segments:
                    a, z = at[-1], at[-1] + len(own)
                    ids[r, a:z], pos[r, a:z] = own, positions[: z - a]
                    at.append(z)
                pos[r, at[-1] :] = positions[: length - at[-1]]
                ends.append(at)
            cuts = pa.array(np.arange(0, (len(rows) + 1) * length, length, dtype=np.int32))
            arrays = [
                pa.ListArray.from_arrays(cuts, pa.array(ids.reshape(-1), pa.int32())),
                pa.array([at[-1] for at in ends], pa.int32()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(cuts, pa.array(pos.reshape(-1), pa.int32())),
                pa.array([[d for d, _, _ in row] for row in rows], pa.list_(ids_type)),
                pa.array([[s for _, s, _ in row] for row in rows], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"])

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [[pieces[i] for i in row] for row in best_fit_decreasing([len(p[2]) for p in pieces], length)]
            for k in range(0, len(rows), 512):
                yield written(rows[k : k + 512])
            pieces.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(tokenizer.encode(text), np.int32(END))
                for a in range(0, len(ids), length):
                    pieces.append((doc, a, ids[a : a + length]))
                held += len(ids)
                if held >= buffer_tokens:
                    yield from flush()
                    held = 0
        if pieces:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fill_rate(packed: DataFrame) -> float | None:
    """Tokens by places of the packed rows; None without rows."""
    return packed.agg((F.sum("n_tokens") / F.sum(F.size("input_ids"))).alias("r")).first()["r"]


_LE = np.dtype("<i4")


def write_matrices(packed: DataFrame, path: str, block_rows: int = 512) -> None:
    """Write packed rows as Parquet of binary blocks, one file per task, by Spark so that any file system works.

    Of a block: n_rows, length, input_ids and position_ids (n_rows x length little-endian int32, row after row), cu_seqlens
    (int32, the rows' lists one after the other), segments (int32, how many each row has), and doc_ids and starts by segment.
    """
    kind = dict(packed.dtypes)["doc_ids"]
    schema = f"n_rows int, length int, input_ids binary, position_ids binary, cu_seqlens binary, segments binary, doc_ids {kind}, starts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                b = whole.slice(at, block_rows)
                flat = lambda c, b=b: b.column(c).flatten()
                plain = lambda c, flat=flat: flat(c).to_numpy(zero_copy_only=False).astype(_LE).tobytes()
                sizes = b.column("doc_ids").value_lengths().to_numpy(zero_copy_only=False).astype(_LE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.num_rows], pa.int32()), pa.array([len(flat("input_ids")) // b.num_rows], pa.int32()),
                        pa.array([plain("input_ids")], pa.binary()), pa.array([plain("position_ids")], pa.binary()),
                        pa.array([plain("cu_seqlens")], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(flat("doc_ids"))], pa.int32()), flat("doc_ids")),
                        pa.ListArray.from_arrays(pa.array([0, len(flat("starts"))], pa.int32()), flat("starts")),
                    ],
                    ["n_rows", "length", "input_ids", "position_ids", "cu_seqlens", "segments", "doc_ids", "starts"],
                )

    packed.select("input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """What ``pack`` gave, from ``write_matrices``."""
    blocks = spark.read.parquet(path)
    kind = dict(blocks.dtypes)["doc_ids"]
    ids_type = to_arrow_type(blocks.schema["doc_ids"].dataType)
    schema = f"input_ids array<int>, n_tokens int, cu_seqlens array<int>, position_ids array<int>, doc_ids {kind}, starts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                n, length = b.column("n_rows")[r].as_py(), b.column("length")[r].as_py()
                ints = lambda c, b=b, r=r: np.frombuffer(b.column(c)[r].as_py(), _LE)
                per_row = lambda flat, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                sizes, cu = ints("segments"), ints("cu_seqlens")
                yield pa.RecordBatch.from_arrays(
                    [
                        per_row(pa.array(ints("input_ids"), pa.int32()), np.full(n, length)),
                        pa.array(cu[np.cumsum(sizes + 1) - 1], pa.int32()),
                        per_row(pa.array(cu, pa.int32()), sizes + 1),
                        per_row(pa.array(ints("position_ids"), pa.int32()), np.full(n, length)),
                        per_row(b.column("doc_ids")[r].values.cast(ids_type.value_type), sizes),
                        per_row(b.column("starts")[r].values, sizes),
                    ],
                    ["input_ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "starts"],
                )

    return blocks.mapInArrow(run, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
