"""Line deduplication over a range-partitioned stream of line hashes.

Each document posts (hash of line key, document, position) for its long lines. The postings are range-partitioned by
(hash, document) and sorted by hash, document descending and position; one pass over each partition then sees the
documents of a line in order and says which postings go. A line that fills a third of the corpus spreads over many
partitions; what a partition cannot decide about the lines at its two ends is settled from two summary rows each.
The result is a compressed keep bitmap for every document that loses a line; texts are not shuffled to decide.

Defined results: a null or empty text is one empty line; a null doc_id is a document of its own that ranks below all
ids; rows that repeat a doc_id count as one document, and each such row loses its lines by its own text; short keys
never go; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, materialise, partitions, table, tune

#: What a key loses at both ends.
BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Rows that one Arrow batch returns at most.
OUT_ROWS = 50_000

_POSTING = "hi bigint, lo bigint, doc_id bigint, text_key bigint, n_lines int, pos int"
_STREAMED = f"{_POSTING}, kind string, n_docs bigint"


def text_key(text: str | None) -> int:
    """A 64-bit key that tells rows with one doc_id and different texts apart."""
    return xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line whose key has min_chars code points or more."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])
        for batch in batches:
            digests, ids, keys, counts, places = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lines = text.split("\n")
                n, own = len(lines), None
                for i, line in enumerate(lines):
                    line = line.strip(BLANKS)
                    if len(line) >= min_chars:
                        own = text_key(text) if own is None else own
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        ids.append(doc)
                        keys.append(own)
                        counts.append(n)
                        places.append(i)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(places, pa.int32())], schema=schema)
            for at in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(at, OUT_ROWS)

    return docs.select("doc_id", "text").mapInArrow(post, _POSTING)


def _stream(min_docs: int):
    """The pass over one sorted partition.

    It returns 'drop' rows; 'open' rows, whose fate hangs on other partitions; and 'sum' rows with the count and the
    largest document of the first and the last line of the partition. It holds the postings of min_docs documents of
    one line at most.
    """
    names = ["hi", "lo", "doc_id", "text_key", "n_lines", "pos"]
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        line, doc, n_docs, first, held, opening = None, None, 0, None, [], True

        def close(last: bool) -> None:
            """End the run of the line at hand."""
            if line is None:
                return
            if opening or last:
                out.append((*line, first, None, None, None, "sum", n_docs))
                if n_docs < min_docs:
                    out.extend((*r, "open", None) for r in held)
                elif opening:
                    out.extend((*r, "open", None) for r in held if r[2] == first)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # lines that stand once in the batch, away from its ends, cannot repeat: most rows end here
            change = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            starts = np.concatenate([[0], change]) if len(hi) else change
            sizes = np.diff(np.append(starts, len(hi)))
            keep = np.repeat((sizes >= min_docs) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1), sizes)
            rows = batch.filter(pa.array(keep))
            for r in zip(*(rows.column(i).to_pylist() for i in range(len(names))), strict=True):
                if r[:2] != line:
                    if line is not None:
                        close(False)
                        opening = False
                    line, doc, n_docs, first, held = r[:2], object(), 0, r[2], []
                if r[2] != doc:
                    doc = r[2]
                    n_docs += 1
                    if n_docs == min_docs:
                        out.extend((*x, "drop", None) for x in held if x[2] != first)
                        held = [x for x in held if x[2] == first]
                if n_docs < min_docs or doc == first:
                    held.append(r)
                else:
                    out.append((*r, "drop", None))
                if len(out) >= OUT_ROWS:
                    yield flush()
        close(True)
        if out:
            yield flush()

    return run


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep): for each document that loses a line, which lines stay.

    keep is a zlib-compressed bitmap, least significant bit first.
    """
    postings = materialise(spark, line_postings(docs, min_chars), "line-postings", gather=True)
    dealt = postings.repartitionByRange(partitions(spark), "hi", "lo", F.col("doc_id").desc()).sortWithinPartitions("hi", "lo", F.col("doc_id").desc_nulls_last(), "text_key", "pos")
    streamed = materialise(spark, dealt.mapInArrow(_stream(min_docs), _STREAMED), "line-stream", gather=True)
    # two summaries for each partition: their totals settle the lines that cross its ends
    totals = streamed.where("kind = 'sum'").groupBy("hi", "lo").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("largest"))
    settled = streamed.where("kind = 'open'").join(totals, ["hi", "lo"]).where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest")))
    columns = ["doc_id", "text_key", "n_lines", "pos"]
    drops = streamed.where("kind = 'drop'").select(columns).union(settled.select(columns))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, dropped = [], []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, dtype=bool)
                keep[places] = False
                dropped.append(int(n - keep.sum()))
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "n_lines", "n_dropped", "keep"])

    by_doc = drops.groupBy("doc_id", "text_key", "n_lines").agg(F.collect_list("pos").alias("places"))
    return by_doc.mapInArrow(pack, "doc_id bigint, text_key bigint, n_lines int, n_dropped int, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[list[str], int]:
    """The lines of a text that its bitmap keeps, and the number of its lines."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for x, b in zip(lines, bits[: len(lines)], strict=True) if b], len(lines)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with a last column of the bitmaps of their doc_id, a few where the id repeats, else null."""
    doc, maps = fresh(docs, "_doc"), fresh(docs, "_maps")
    of_doc = bitmaps.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("text_key", "keep")).alias(maps))
    return docs.join(of_doc, F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(doc)


def pick(text: str | None, maps: list[dict] | None) -> bytes | None:
    """The bitmap of this very text."""
    if not maps:
        return None
    own = text_key(text)
    return next((m["keep"] for m in maps if m["text_key"] == own), None)


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with shortened texts; all columns stay, and n_chars follows the text where there is one."""
    tune(spark)
    bitmaps = keep_bitmaps(spark, docs, min_chars, min_docs)
    joined = with_bitmaps(docs, bitmaps)
    at, maps_at = docs.columns.index("text"), len(docs.columns)
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(i) for i in range(maps_at)]
            texts = []
            for text, maps in zip(arrays[at].to_pylist(), batch.column(maps_at).to_pylist(), strict=True):
                keep = pick(text, maps)
                texts.append(text if keep is None else "\n".join(kept_lines(text, keep)[0]))
            arrays[at] = pa.array(texts, pa.string())
            if chars_at is not None:
                arrays[chars_at] = pa.array([old if keep is None else None if t is None else len(t) for t, old, keep in zip(texts, arrays[chars_at].to_pylist(), batch.column(maps_at).to_pylist(), strict=True)], arrays[chars_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:maps_at])

    return joined.mapInArrow(cut, schema)


def digests(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    tune(spark)
    docs = docs.select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(spark, docs, min_chars, min_docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, maps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keep = pick(text, maps)
                if keep is None:
                    n.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    sha.append(hashlib.sha256((text or "").encode()).hexdigest())
                else:
                    lines, total = kept_lines(text, keep)
                    n.append(total)
                    dropped.append(total - len(lines))
                    sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.select("doc_id", "text", "_maps").mapInArrow(digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, row_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
hot AS (SELECT k, max(doc_id) AS largest FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.largest AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_id
"""
