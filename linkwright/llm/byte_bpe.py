"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the vocabulary's pattern; every distinct word of a stretch of texts becomes token-position rows, one
for each byte. A recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of
least rank, until no pair of any word is in the table. Ids become bytes again by a join with the vocabulary and an
ordered aggregation. Words met before are taken from a bounded cache of the Python worker.

A long word is cut where no token of the vocabulary that stands in the word spans: no merge can cross such a place, so
its parts are contracted apart, equal ones once. What is still long is mostly one sign repeated. A pair whose token
stands in no earlier token of the vocabulary can form no pair of a lower rank; all its occurrences are contracted in one
step, with the same result. A query makes STEPS steps at most and keeps the rows of each; parts that are not done by then
go into the next query with their last rows only. A part of over HUGE bytes without any such place (a long run of a few
signs) can take as many steps as it has bytes, more than a query does in time or holds in memory: it is contracted over
an array, in each step all pairs of the least rank up to the first one whose contraction makes a pair of a lower rank.

Defined results: a null or empty text has no tokens; a null doc_id is kept; repeated rows are encoded each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, tune, worker_cache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of text whose new words go into one query.
STRETCH_CHARS = 4_000_000
#: Words that a worker keeps, and the longest word it keeps.
CACHE_ENTRIES = 800_000
CACHE_CHARS = 64
MEMORY = "400MB"
#: Steps of one recursive query over long parts.
STEPS = 12

#: The leftmost pair of least rank: rank, position and next position in one integer, so that one minimum finds it.
_ONE = """
WITH RECURSIVE state(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM words
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.word, s.pos, s.tok, s.step, (m.rank::BIGINT << 32) | (s.pos << 16) | s.after AS pair
     FROM (SELECT *, lead(tok) OVER w AS nxt, lead(pos) OVER w AS after FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) s
     LEFT JOIN merges m ON s.tok = m.l AND s.nxt = m.r),
   best AS (SELECT word, min(pair) AS pair FROM pairs WHERE pair IS NOT NULL GROUP BY word)
   SELECT p.word, p.pos, CASE WHEN p.pos = (b.pair >> 16) & 65535 THEN (b.pair >> 32)::INTEGER ELSE p.tok END, p.step + 1
   FROM pairs p JOIN best b ON p.word = b.word WHERE p.pos <> b.pair & 65535)
)
SELECT s.word, s.tok FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON s.word = l.word AND s.step = l.step ORDER BY s.word, s.pos
"""
#: For long words: all pairs of the least rank that do not overlap with one before, where that is safe; else the leftmost.
_ALL = f"""
WITH RECURSIVE state(word, pos, tok, step) AS (
  SELECT word, pos, tok, 0 FROM words
  UNION ALL
  (WITH pairs AS (
     SELECT s.word, s.pos, s.tok, s.step, m.rank, m.apart
     FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM state WHERE step < {STEPS}) s
     LEFT JOIN merges m ON s.tok = m.l AND s.nxt = m.r),
   best AS (SELECT word, min(rank) AS rank, min_by(pos, (rank::BIGINT << 32) + pos) AS pos FROM pairs WHERE rank IS NOT NULL GROUP BY word),
   near AS (
     SELECT p.word, p.pos, p.tok, p.step, b.rank, p.rank IS NOT NULL AND p.rank = b.rank AS candidate, p.pos = b.pos AS leftmost, coalesce(p.apart, false) AS apart
     FROM pairs p JOIN best b ON p.word = b.word),
   taken AS (
     SELECT *, CASE WHEN apart THEN candidate AND (row_number() OVER (PARTITION BY word, candidate, run ORDER BY pos)) % 2 = 1 ELSE leftmost END AS take
     FROM (SELECT *, nth - row_number() OVER (PARTITION BY word, candidate ORDER BY pos) AS run
           FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth FROM near)))
   SELECT word, pos, CASE WHEN take THEN rank ELSE tok END, step + 1
   FROM (SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM taken)
   WHERE NOT eaten)
)
SELECT s.word, s.pos, s.tok, s.step FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON s.word = l.word AND s.step = l.step ORDER BY s.word, s.pos
"""
#: Bytes from which on a word counts as long.
LONG = 48
#: Bytes from which on a part is contracted as an array.
HUGE = 1_000
#: Bytes whose tokens are looked up at once, and more than any token has.
PIECE = 250_000
LONGEST = 1_000
#: Over every rank.
NONE = np.iinfo(np.int32).max

_DECODE = "SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v ON t.tok = v.tok GROUP BY t.word ORDER BY t.word"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Bpe:
    """The vocabulary and the merge table in a DuckDB of one Python worker."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        merges = [(ranks[a], ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
        early = {part for l, r, rank in merges for part in (l, r) if rank < part}
        left, right, rank = zip(*merges, strict=True)
        self.db = duckdb.connect()
        for setting in ("threads = 1", f"memory_limit = '{MEMORY}'", "preserve_insertion_order = false", "temp_directory = ''"):
            self.db.execute(f"SET {setting}")
        self._keep("merges", {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32()), "apart": pa.array([x not in early for x in rank])})
        self._keep("vocabulary", {"tok": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        self.spans = None
        order = np.argsort(keys := np.array(left, np.int64) << 32 | np.array(right, np.int64))
        self.pairs, self.pair_ranks = keys[order], np.array(rank, np.int32)[order]
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[bytes, bytes] = {b"": b""}

    def _keep(self, name: str, columns: dict[str, pa.Array]) -> None:
        rows = pa.table(columns)  # noqa: F841  read by name
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids, packed as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        rest = []
        for i, w in enumerate(raw):
            if (whole := self.ranks.get(w)) is None:
                rest.append(i)
            else:
                found[i] = whole.to_bytes(4, "little")  # a word that is a token is not merged from its bytes
        parts = {i: self.parts(raw[i]) if len(raw[i]) >= LONG else [raw[i]] for i in rest}
        merged = self.merge(list(dict.fromkeys(p for own in parts.values() for p in own)))
        for i, own in parts.items():
            found[i] = b"".join([merged[p] for p in own])
        return found

    def parts(self, word: bytes) -> list[bytes]:
        """word cut at all places that no token which stands in it spans."""
        if self.spans is None:
            self.spans = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.spans.add_word(token.decode("latin-1"), len(token))
            self.spans.make_automaton()
        spanned = np.zeros(len(word) + 1, np.int32)
        for at in range(0, len(word), PIECE):  # a bounded stretch of matches at once; each ends in its own stretch
            before = max(0, at - LONGEST)
            both = [(e + before, n) for e, n in self.spans.iter(word[before : at + PIECE].decode("latin-1")) if e + before >= at]
            if both:
                end, n = np.array(both).T
                np.add.at(spanned, end - n + 2, 1)
                np.add.at(spanned, end + 1, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(spanned)[1 : len(word)] == 0) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The packed ids of each part, contracted from its bytes."""
        out: dict[bytes, bytes] = {}

        def rows(chosen: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lengths = np.array([len(p) for p in chosen])
            word = np.repeat(np.arange(len(chosen), dtype=np.int32), lengths)
            pos = np.arange(len(word), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
            return word, pos, self.bytes[np.frombuffer(b"".join(chosen), np.uint8)]

        def run(query: str, word: np.ndarray, pos: np.ndarray, tok: np.ndarray) -> dict[str, np.ndarray]:
            self._keep("words", {"word": pa.array(word), "pos": pa.array(pos), "tok": pa.array(tok)})
            return {k: np.asarray(v) for k, v in self.db.execute(query).fetchnumpy().items()}

        def keep(chosen: list[bytes], done: dict[str, np.ndarray]) -> None:
            ids, numbers = done["tok"].astype("<u4"), np.unique(done["word"])
            starts, ends = np.searchsorted(done["word"], numbers), np.searchsorted(done["word"], numbers, side="right")
            out.update((chosen[k], ids[a:b].tobytes()) for k, a, b in zip(numbers.tolist(), starts.tolist(), ends.tolist(), strict=True))

        if short := [p for p in parts if len(p) < LONG]:
            keep(short, run(_ONE, *rows(short)))
        out.update((p, self.contract(p)) for p in parts if len(p) > HUGE)
        if long := [p for p in parts if LONG <= len(p) <= HUGE]:
            state = rows(long)
            while len(state[0]):
                got = run(_ALL, *state)
                over = got["step"] < STEPS
                keep(long, {k: v[over] for k, v in got.items()})
                state = tuple(got[k][~over].astype(np.int32) for k in ("word", "pos", "tok"))
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens; NONE where the table has none."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def contract(self, part: bytes) -> bytes:
        """The packed ids of one part."""
        tok = self.bytes[np.frombuffer(part, np.uint8)]
        while len(tok) > 1:
            rank = self.rank_of(tok[:-1], tok[1:])
            least = rank.min()
            if least == NONE:
                break
            hits = np.flatnonzero(rank == least)
            # of a run of overlapping pairs every second one
            first = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hits) > 1]), hits, 0))
            hits = hits[(hits - first) % 2 == 0]
            # what stands beside a pair when its turn comes: before it what is contracted already, after it what is not
            before, after = tok[np.maximum(hits - 1, 0)], tok[np.minimum(hits + 2, len(tok) - 1)]
            before[1:][np.diff(hits) == 2] = least
            made = np.full(len(hits), least, tok.dtype)
            lower = (hits > 0) & (self.rank_of(before, made) < least) | (hits + 2 < len(tok)) & (self.rank_of(made, after) < least)
            if lower.any():
                hits = hits[: int(lower.argmax()) + 1]
            tok[hits] = least
            tok = np.delete(tok, hits + 1)
        return tok.astype("<u4").tobytes()

    def decode_words(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that each list of packed ids stands for."""
        lengths = np.array([len(p) // 4 for p in packed])
        word = np.repeat(np.arange(len(packed), dtype=np.int32), lengths)
        self._keep("tokens", {"word": pa.array(word), "pos": pa.array(np.arange(len(word), dtype=np.int32)), "tok": pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))})
        found = [b""] * len(packed)
        for k, text in self.db.execute(_DECODE).fetchall():
            found[k] = bytes.fromhex(text)
        return found

    def learn(self, words: set[str]) -> tuple[dict[str, bytes], dict[bytes, bytes]]:
        """The ids of words, and the bytes of those ids: the caches, with what they lacked."""
        fresh = [w for w in words if w not in self.ids]
        if not fresh:
            return self.ids, self.decoded
        ids = dict(zip(fresh, self.encode_words(fresh), strict=True))
        new = list({p for p in ids.values() if p not in self.decoded})
        decoded = dict(zip(new, self.decode_words(new), strict=True)) if new else {}
        room = max(0, CACHE_ENTRIES - len(self.ids))  # once it is full the words met first, the frequent ones, stay
        for w, p in islice(((w, p) for w, p in ids.items() if len(w) <= CACHE_CHARS), room):
            self.ids[w] = p
            self.decoded[p] = decoded.get(p) or self.decoded[p]
        if all(w in self.ids for w in fresh):
            return self.ids, self.decoded
        own = {w: self.ids.get(w) or ids[w] for w in words}
        return own, {p: self.decoded.get(p) or decoded[p] for p in own.values()}


def worker_bpe(path: str) -> Bpe:
    return worker_cache(f"bpe {path}", lambda: Bpe(path))


def stretches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """texts in order, in lists of about STRETCH_CHARS characters."""
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text or "")
        if chars >= STRETCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_texts(texts: list[str | None], path: str, pattern: str = public_tokenizers.PATTERN) -> Iterator[tuple[bytes, bytes]]:
    """The packed ids of each text, and the bytes that these ids decode to."""
    bpe, cut = worker_bpe(path), regex.compile(pattern).findall
    for part in stretches(texts):
        words = [cut(t or "") for t in part]
        ids, decoded = bpe.learn(set().union(*words))
        for own in words:
            packed = [ids[w] for w in own]
            yield b"".join(packed), b"".join([decoded[p] for p in packed])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    tune(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(encode_texts(batch.column(1).to_pylist(), path))
            ids = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p, _ in both], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([d for _, d in both], pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    tune(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, decoded = [], [], []
            for packed, text in encode_texts(batch.column(1).to_pylist(), path):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
