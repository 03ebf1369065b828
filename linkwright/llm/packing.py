"""Best-fit packing with large-item matching.

Pieces of over a third of the capacity share a sequence with one other such piece at most: the largest free piece is
matched with the largest one that fits beside it. Smaller pieces, longest first, then fill the smallest gap that takes
them; a new sequence opens only where none does.

Only the number of pieces of each length matters to that plan, so it is made from a histogram of at most as many rows as
the capacity (its proven bound, whatever the corpus holds) and says, for each length, which ranks go where. Pieces find
their place by their rank among those of equal length; ranks come from small hashed blocks and the sums of the counts of
earlier blocks, so one very common length burdens no task.

Defined results: a null or empty text is the closing id alone; a null doc_id is kept; repeated rows are packed each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialise, table, tune, worker_cache

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces in one block of ranks.
BLOCK_ROWS = 4_000
#: Entries that a worker keeps, and the longest chunk it keeps.
CACHE_ENTRIES = 500_000
CACHE_BYTES = 64
OUT_ROWS = 20_000


class ChunkIds(dict):
    """Chunk of a text between ASCII white space -> its ids, packed as little-endian unsigned 32-bit integers.

    The tokenizer never joins characters across white space, so the ids of a text are those of its chunks. The chunks
    met first, the frequent ones, stay known; others are encoded each time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk[-1] in b",." and chunk[-2:-1].isalpha():
            ids = self[chunk[:-1]] + self[chunk[-1:]]  # a letter and one mark after it are cut apart anyway
        else:
            ids = array("I", self.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()
            if sys.byteorder == "big":
                ids = np.frombuffer(ids, ">u4").astype("<u4").tobytes()
        if len(self) < CACHE_ENTRIES and len(chunk) <= CACHE_BYTES:
            self[chunk] = ids
        return ids

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The packed ids of each text."""
        for text in texts:
            raw = (text or "").encode()
            if b"<|" not in raw:  # the vocabulary has no capitals but in its special tokens' names
                raw = raw.lower()
            yield b"".join(map(self.__getitem__, raw.split()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids with end_id, cut where they exceed the capacity."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_cache(f"chunks {path}", lambda: ChunkIds(path))
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), ids_of.texts(batch.column(1).to_pylist()), strict=True):
                ids = own + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                for at in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(at, OUT_ROWS)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, number of pieces, first sequence, pieces a sequence, first offset).

    Piece number r of a row stands in sequence first + r // per, at offset + (r % per) * length.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, number of sequences)
    free: list[int] = []  # the keys of gaps, ascending
    opened = 0

    def place(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        rows.append((length, rank[length], count, sequence, per, offset))
        rank[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    def offer(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(free, gap)
            gaps[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        if length not in left:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - length) - 1
        while at >= 0 and (large[at] not in left or large[at] == length and left[length] == 1):
            at -= 1
        if at < 0:
            n = left[length]
            place(length, n, opened, 1, 0)
            offer(capacity - length, opened, n)
            opened += n
            continue
        partner = large[at]
        n = left[length] // 2 if partner == length else min(left[length], left[partner])
        place(length, n, opened, 1, 0)
        place(partner, n, opened, 1, length)
        offer(capacity - length - partner, opened, n)
        opened += n
    for length in sorted(left, reverse=True):
        while length in left:
            count = left[length]
            at = bisect.bisect_left(free, length)
            if at == len(free):
                per = capacity // length
                whole = count // per
                if whole:
                    place(length, whole * per, opened, per, 0)
                    offer(capacity - per * length, opened, whole)
                    opened += whole
                if rest := count - whole * per:
                    place(length, rest, opened, rest, 0)
                    offer(capacity - rest * length, opened, 1)
                    opened += 1
                continue
            gap = free[at]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                free.pop(at)
            per = gap // length
            if whole := min(n, count // per):
                place(length, whole * per, sequence, per, capacity - gap)
                offer(gap - per * length, sequence, whole)
                offer(gap, sequence + whole, n - whole)
            else:
                place(length, count, sequence, count, capacity - gap)
                offer(gap - count * length, sequence, 1)
                offer(gap, sequence + 1, n - 1)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    tune(spark)
    # pieces are dealt to blocks by their place, which is written with them, so that equal rows part too
    cut = pieces(docs, path or public_tokenizers.path(VOCABULARY), capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    cut = materialise(spark, cut, "pieces", gather=True)
    # at most one row for each length up to the capacity
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = max(1, -(-sum(histogram.values()) // BLOCK_ROWS))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    counts = dealt.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = counts.select("block", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("block", "length").orderBy("row"))
    ranked = dealt.withColumn("own", own).join(before, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    where = spark.sparkContext.broadcast(plan(histogram, capacity))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = where.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            own = rows[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            arrays = [*(batch.column(i) for i in range(5)), pa.array(own[:, 3] + nth // own[:, 4]), pa.array(own[:, 5] + nth % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
