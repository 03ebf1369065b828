"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents with equal shingle sets form a class, and one signature of COORDINATES minima stands for each class. A class
is posted under its coordinate-value pairs. Two classes whose signatures agree in at least MATCHES coordinates share one
of the rarest pairs of each (all but MATCHES - 1 of the pairs it shares with anyone): only this prefix is posted, and
the longer lists are skipped and only compared. Collisions of a pair are counted where it first meets, and pairs that
reach MATCHES are confirmed on their full shingle sets. Fewer than 14 of 32 coordinates agree with a probability of about
1e-6 at a similarity of 0.80, and 1e-8 at 0.85.

Short lists give pairs. Members of a long list are first dealt out as blocks, by a hash that differs from list to list,
and each block returns a spanning forest of its confirmed links (a product of shingle incidence matrices); the few lists
that a class stands in first are enough for that. What these links join needs no more comparison: afterwards only members
of different components meet, a large component in blocks of its own that never meet one another. There the signatures
are compared first, and full sets go only to members that agree with one of another component. So a group of near copies
costs rows in proportion to its size, and no list emits its square. Links become components by star contraction; copies
of a text are never expanded into pairs.

Defined results: texts without words have no shingles and are linked with nothing; a null doc_id is kept and is linked
by its text, but is no component_id while another id is there; rows that repeat a doc_id and text have one result;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import fresh, materialise, partitions, table, tune, worker_cache
from .components import components
from .line_dedup import text_key

WORDS = 5
#: The similarity that links, by default and in the query, whose contract sets its own.
PERCENT = 80
QUERY_PERCENT = 85
COORDINATES = 32
MATCHES = 14
#: Members from which a list is dealt out as blocks, and members of a block.
LONG_LIST = 64
BLOCK = 512
#: Long lists of a class, the shortest ones, whose blocks are linked before members of different components meet.
PILOTS = 3
#: Shingles whose coordinates are computed at once, and cells of one incidence matrix.
CHUNK = 400_000
CELLS = 16_000_000
CACHE_ENTRIES = 250_000

_RNG = np.random.default_rng(20240607)
_SALTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64 and len(self) < CACHE_ENTRIES:  # the words met first, the frequent ones, stay
            self[word] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("words", WordHashes).__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    one = word_hashes(found)
    if len(found) < words:
        one = np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    else:
        n = len(found) - words + 1
        mixed = one[:n].copy()
        for k in range(1, words):
            mixed = mixed * _STEP + one[k : k + n]
        one = mixed
    one = (one ^ (one >> np.uint64(32))) * _MIX
    return np.unique(one ^ (one >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 32-bit minima for each non-empty set."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for k in range(COORDINATES):
            out[at:end, k] = np.minimum.reduceat(((joined ^ _SALTS[k]) * _FACTORS[k]) >> np.uint64(32), starts)
        at = end
    return out


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n, class, signature): class is a 128-bit fingerprint of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, words) for t in texts]
            full = [s for s in sets if len(s)]
            made = iter(signatures(full).astype(np.int64) if full else ())
            rows = [next(made).astype(np.uint32).view(np.int32) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(rows, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "n", "class", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, class binary, signature array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(class, items): the shingle hashes of the documents in wanted (class, doc, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            own = [i for i, (t, k) in enumerate(zip(texts, keys, strict=True)) if text_key(t) == k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array([shingles(texts[i], words).tobytes() for i in own], pa.binary())], names=["class", "items"])

    return docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("doc"))).select("class", "text", "key").mapInArrow(run, "class binary, items binary")


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the intersection is at least percent of the union, for sets of a and b items that share some."""
    return 100 * shared >= percent * (a + b - shared)


def _signature_column(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, COORDINATES)


def _meets_first(matches: np.ndarray, both: np.ndarray, coordinate: np.ndarray) -> np.ndarray:
    """Whether coordinate is the first that both have posted and agree in. matches: bits of the coordinates that agree."""
    common = matches & both
    return (common & -common) == (np.int64(1) << coordinate)


_BITS = np.int64(1) << np.arange(COORDINATES, dtype=np.int64)


def pairs_of_short_lists(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs that agree in MATCHES coordinates, from postings sorted by token within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            token = rows.column("token").to_numpy()
            if not len(token):
                continue
            # lists that the next batch may continue are held back, and the members before them are not compared again
            fresh = rows.num_rows - batch.num_rows
            yield from compare(rows, token, fresh)
            others = np.flatnonzero(token != token[-1])
            held = rows.slice(int(others[-1]) + 1 if len(others) else 0)

    def compare(rows: pa.Table, token: np.ndarray, fresh: int) -> Iterator[pa.RecordBatch]:
        signature = _signature_column(rows.column("signature").chunk(0))
        mask, n, names = rows.column("mask").to_numpy(), rows.column("n").to_numpy(), rows.column("class")
        coordinate = token >> 32
        for lag in range(1, LONG_LIST + 1):
            left = np.flatnonzero(token[lag:] == token[:-lag]) if lag < len(token) else np.empty(0, int)
            if not len(left):
                break
            left = left[left + lag >= fresh]
            right = left + lag
            near = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            left, right = left[near], right[near]
            for at in range(0, len(left), 100_000):
                x, y = left[at : at + 100_000], right[at : at + 100_000]
                agree = signature[x] == signature[y]
                good = agree.sum(1) >= MATCHES
                good &= _meets_first(agree @ _BITS, mask[x] & mask[y], coordinate[x])
                if good.any():
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(x[good])).combine_chunks().cast(pa.binary()), names.take(pa.array(y[good])).combine_chunks().cast(pa.binary())], names=["a", "b"])

    return postings.select("token", "class", "signature", "mask", "n").mapInArrow(run, "a binary, b binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(u, v, assume_unique=True))
                good.append(bool(linked(shared, len(u), len(v), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def shared_items(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of incidence matrices of the items that more than one set holds."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    use = count[place] > 1
    owner, column, total = owner[use], rank[place[use]], int((count > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(1, CELLS // len(sets))
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), min(width, total - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(adjacent)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(rows: pa.Table) -> np.ndarray:
    """Which pairs of a list's rows are to be confirmed: near in size, in MATCHES coordinates, and first met in this list.

    Rows of one component (comp), and of one block (own) where two blocks meet, are not to be.
    """
    signature = _signature_column(rows.column("signature").chunk(0))
    mask, n, own = (rows.column(c).to_numpy() for c in ("mask", "n", "own"))
    comp = np.unique(rows.column("comp").to_pylist(), return_inverse=True)[1]
    coordinate = int(rows.column("token")[0].as_py()) >> 32
    agree = np.zeros((len(n), len(n)), np.uint8)
    earlier = np.zeros_like(agree, dtype=bool)
    for k in range(COORDINATES):
        same = signature[:, k][:, None] == signature[:, k][None, :]
        agree += same
        if k < coordinate:
            posted = (mask >> k & 1).astype(bool)
            earlier |= same & posted[:, None] & posted[None, :]
    near = 100 * np.minimum(n[:, None], n[None, :]) >= rows.column("percent")[0].as_py() * np.maximum(n[:, None], n[None, :])
    chosen = near & (agree >= MATCHES) & ~earlier & (comp[:, None] != comp[None, :])
    if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
        chosen &= own[:, None] != own[None, :]
    return chosen


def with_candidates(rows: pa.Table) -> pa.Table:
    """The rows of a pair of blocks that have a candidate there."""
    rows = rows.combine_chunks()
    return rows.filter(pa.array(_candidates(rows).any(1))) if rows.num_rows > 1 else rows.slice(0, 0)


def links_of_blocks(rows: pa.Table) -> pa.Table:
    """For a block, or two, of a long list: a spanning forest of the confirmed links between components."""
    rows = rows.combine_chunks()
    empty = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    if rows.num_rows < 2:
        return empty
    chosen = _candidates(rows)
    use = np.flatnonzero(chosen.any(1))
    if not len(use):
        return empty
    names, size = rows.column("class").to_pylist(), rows.column("n").to_numpy()[use]
    sets = [np.frombuffer(rows.column("items")[int(i)].as_py(), np.uint64) for i in use]
    link = chosen[np.ix_(use, use)] & linked(shared_items(sets), size[:, None], size[None, :], rows.column("percent")[0].as_py())
    root = forest(link)
    below = np.flatnonzero(root != np.arange(len(use)))
    return pa.table({"a": pa.array([names[use[i]] for i in below], pa.binary()), "b": pa.array([names[use[root[i]]] for i in below], pa.binary())})


_ROW = ["token", "i", "j", "own", "class", "comp", "signature", "mask", "n", "percent"]
_LINK = "a binary, b binary"


def links_within_blocks(long: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links within the blocks of the PILOTS shortest long lists of each class."""
    first = F.row_number().over(Window.partitionBy("class").orderBy("m", "token"))
    some = long.withColumn("rank", first).where(F.col("rank") <= PILOTS)
    blocks = some.withColumn("own", F.pmod(F.xxhash64("class", "token"), F.ceil(F.col("m") / BLOCK))).withColumn("i", F.col("own")).withColumn("j", F.col("own"))
    return blocks.withColumn("comp", F.col("class")).join(sets, "class").select(*_ROW, "items").groupBy("token", "i", "j").applyInArrow(links_of_blocks, _LINK)


def links_across_components(spark: SparkSession, long: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(a, b): links between members of long lists that are not in one component yet; None if there are no such lists."""
    named = long.join(roots, F.col("class") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "class")).drop("node", "root")
    sizes = named.groupBy("token", "comp").agg(F.count("*").alias("s"))
    large = F.collect_list(F.when(F.col("s") * 2 >= BLOCK, F.struct("comp", "s")))
    lists = sizes.groupBy("token").agg(F.sum(F.when(F.col("s") * 2 < BLOCK, F.col("s")).otherwise(0)).alias("rest"), large.alias("large"), F.count("*").alias("comps")).where("comps > 1")
    lists = materialise(spark, lists.select("token", "rest", "large"), "mixed-lists")
    if lists.isEmpty():
        return None
    # block number: which large component, counted from 1, or 0 for all small ones; and a part of it
    blocks = F.concat(F.array(F.ceil(F.col("rest") / BLOCK)), F.transform("large", lambda x: F.ceil(x.s / BLOCK)))
    every = F.flatten(F.transform(blocks, lambda n, c: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: c.cast("bigint") * (1 << 32) + k)))
    of = F.array_position(F.transform("large", lambda x: x.comp), F.col("comp")).cast("int")
    placed = named.join(lists, "token").withColumn("of", of).withColumn("own", F.col("of").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("class", "token"), F.greatest(F.get(blocks, "of"), F.lit(1))))
    others = F.filter(every, lambda o: (F.shiftright(o, 32) != F.col("of")) | (F.col("of") == 0))
    dealt = placed.withColumn("other", F.explode(others)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    few = dealt.select(*_ROW).groupBy("token", "i", "j").applyInArrow(with_candidates, dealt.select(*_ROW).schema)
    return few.join(sets, "class").select(*_ROW, "items").groupBy("token", "i", "j").applyInArrow(links_of_blocks, _LINK)


def classes_and_links(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches, the classes (class, doc, doc_key, n, least) and confirmed links (a, b) between classes.

    The links have the components of all links; of those within a component some may be left out.
    """
    tune(spark)
    docs = docs.select("doc_id", "text")
    sketch = materialise(spark, sketches(docs, words), "sketches", gather=True)
    rows = sketch.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "n", "signature")).alias("rep"), F.min("doc_id").alias("least"))
    classes = materialise(spark, rows.select("class", "least", F.col("rep.doc_id").alias("doc"), F.col("rep.text_key").alias("key"), "rep.n", "rep.signature"), "classes")
    tokens = classes.select("class", F.posexplode("signature").alias("k", "v")).select("class", (F.shiftleft(F.col("k").cast("bigint"), 32) + (F.col("v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("token"))
    lengths = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(lengths, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("lists")).where(F.size("lists") >= MATCHES)
    prefix = ordered.select("class", F.expr(f"transform(slice(lists, 1, size(lists) - {MATCHES - 1}), x -> x.token)").alias("tokens"))
    prefix = prefix.withColumn("mask", F.expr("aggregate(tokens, 0L, (m, t) -> m | shiftleft(1L, cast(shiftright(t, 32) as int)))"))
    posted = materialise(spark, prefix.join(classes.select("class", "doc", "key", "n", "signature"), "class"), "prefixes")
    sets = materialise(spark, full_sets(docs, posted.select("class", "doc", "key"), words), "sets")
    postings = posted.select(F.explode("tokens").alias("token"), "class", "signature", "mask", "n")
    members = posted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(spark, members, "list-sizes", gather=True)
    met = postings.join(members, "token")
    short = met.where(F.col("m") <= LONG_LIST).repartition(partitions(spark), "token").sortWithinPartitions("token", "class")
    links = confirm(pairs_of_short_lists(short, percent), sets, percent)
    if members.where(F.col("m") > LONG_LIST).isEmpty():
        return sketch, classes, links
    long = materialise(spark, met.where(F.col("m") > LONG_LIST).withColumn("percent", F.lit(percent)), "long-lists")
    links = materialise(spark, links.union(links_within_blocks(long, sets)), "first-links", gather=True)
    more = links_across_components(spark, long, components(spark, links), sets)
    return sketch, classes, links if more is None else links.union(more)


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row of docs."""
    sketch, classes, links = classes_and_links(spark, docs, words, percent)
    roots = components(spark, links)
    own = classes.select("class", "least").join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = own.join(least, "root").select("class", "component_id")
    found = sketch.select("doc_id", "text_key", "n", "class").join(of_class, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay.

    Rows that repeat a doc_id and text are one document, and stay or go together.
    """
    doc, keys = fresh(docs, "_doc"), fresh(docs, "_gone")
    gone = near_duplicates(spark, docs, words, percent).where("NOT kept").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("text_key").alias(keys))
    at, gone_at = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [not keys or text_key(text) not in keys for text, keys in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_())).select(docs_columns)

    docs_columns = docs.columns
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(doc)
    return joined.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), percent=QUERY_PERCENT).drop("text_key")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT i.a, i.b FROM inter i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * i.i >= 85 * (p.n + q.n - i.i)),
reach AS (
  WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN link l ON l.a = r.doc_id)
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, r.c AS component_id, n.doc_id = r.c AS kept FROM n JOIN reach r ON r.doc_id = n.doc_id
"""
