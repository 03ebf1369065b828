"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A fixed random rotation spreads a unit vector over BLOCKS blocks of coordinates; each block has a random code of unit
directions, and every tuple of code words is a filter. A vector is posted to all filters whose inner product with it
reaches a cap; list decoding finds them without trying all tuples, by half sums that bound the rest. A vector that
reaches fewer than LEAST is posted to its LEAST best filters, so none is hard to find. The codes grow with the number of
vectors of a label and the cap with the codes, so that a filter holds about as many strangers and a vector is posted
about as often at every size. Vectors are joined on filter and label and verified in double precision.

Equal vectors of a label form a class before the join. Members of a short list are paired in one pass over sorted
postings, if their sign sketches are near enough (at the limit they are, but for one pair in a billion); pairs are made
distinct and verified on their vectors. A long list is dealt out as pairs of blocks; one task verifies two blocks and
returns, for each class, how many rows it is linked with there, and a spanning forest of the links: no list of all pairs
is ever made. A pair counts under the first long list that both share, or else as a short one. Links become components
by star contraction.

Defined results: a null label, a null, empty or zero vector and one with a null or non-finite component link with
nothing; vectors of different length never link; a null vec_id is kept and counts as a linked row, but is no
component_id while another id is there; repeated rows link with one another; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, partitions, table, tune
from .components import components
from .minhash import forest

COSINE = 0.98
BLOCKS = 4
#: Words of a block's code: WORDS, or as many powers of GROWTH more as it takes for ROOM filters for each vector of a label.
WORDS = 24
GROWTH = 1.25
ROOM = 32
#: Filters that exceed the cap on the average, and filters that a vector is posted to at least: the best ones.
EXCEEDING = 12
LEAST = 32
#: Members from which a filter's list is dealt out as blocks, and members of a block.
LONG_LIST = 64
BLOCK = 512
#: Signs of a sketch, and how many may differ: at a cosine of 0.98 an expected 16 of 256 differ, with a deviation of 4.
SIGNS = 256
DIFFERENT = 42
SEED = 4711


def code_size(vectors: int) -> int:
    """Words of a block's code for a label of so many vectors."""
    words = WORDS
    while words**BLOCKS < ROOM * vectors:
        words = int(words * GROWTH)
    return words


@lru_cache(32)
def codes(dimension: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A rotation of the space, padded to whole blocks; the code of each block (BLOCKS, size, width); the sketch's directions; the cap."""
    rng = np.random.default_rng(SEED + dimension)
    width = -(-dimension // BLOCKS)
    rotation = np.linalg.qr(rng.standard_normal((width * BLOCKS, width * BLOCKS)))[0][:dimension]
    words = rng.standard_normal((BLOCKS, size, width))
    signs = np.random.default_rng(SEED).standard_normal((dimension, SIGNS))
    # an inner product of a random vector and a filter is nearly normal, with a deviation of 1 / sqrt(dimension)
    cap = NormalDist().inv_cdf(1 - EXCEEDING / size**BLOCKS) / np.sqrt(width * BLOCKS)
    return rotation, words / np.linalg.norm(words, axis=2, keepdims=True) / np.sqrt(BLOCKS), signs, cap


def filters(vector: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The ascending numbers of the filters that a unit vector is posted to."""
    rotation, words, _, cap = codes(len(vector), size)
    scores = np.einsum("bwd,bd->bw", words, (vector @ rotation).reshape(BLOCKS, -1))
    left = (scores[0][:, None] + scores[1][None, :]).ravel()
    right = (scores[2][:, None] + scores[3][None, :]).ravel()
    few = min(LEAST, len(left))
    # halves that can exceed the cap with the best other half, and the best of all
    by_left = np.flatnonzero(left >= min(cap - right.max(), np.partition(left, -few)[-few]))
    by_right = np.flatnonzero(right >= min(cap - left.max(), np.partition(right, -few)[-few]))
    by_left, by_right = by_left[np.argsort(-left[by_left])], by_right[np.argsort(-right[by_right])]
    one, two = left[by_left], right[by_right]
    # each left half exceeds the cap with a prefix of the right ones
    reach = np.searchsorted(-two, one - cap, side="right")
    if reach.sum() < LEAST:
        # the left half number i can be among the LEAST best with the first LEAST / (i + 1) right ones only
        reach = np.minimum(len(two), LEAST // np.arange(1, few + 1))
    reach = reach[reach > 0]
    i = np.repeat(np.arange(len(reach)), reach)
    j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
    total = one[i] + two[j]
    n = max(LEAST, int((total >= cap).sum()))
    best = np.argsort(-total, kind="stable")[:n]
    return np.sort(by_left[i[best]].astype(np.int64) * len(right) + by_right[j[best]])


def sketch(vector: np.ndarray) -> bytes:
    """On which side of SIGNS random planes a vector lies."""
    return np.packbits(vector @ codes(len(vector), WORDS)[2] > 0).tobytes()


def usable(values: list | None) -> bool:
    return bool(values) and None not in values and bool(np.isfinite(values).all()) and any(values)


def posted(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, class, filters, sketch): class is the vector's bytes, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, signs = [], [], []
            for values, label, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if label is None or not usable(values):
                    for column in (names, found, signs):
                        column.append(None)
                    continue
                v = np.array(values, np.float64) + 0.0  # no negative zeros
                names.append(v.tobytes())
                scaled = v / np.abs(v).max()
                unit = scaled / np.linalg.norm(scaled)
                found.append(filters(unit, code_size(n)))
                signs.append(sketch(unit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["vec_id", "label", "class", "filters", "sketch"])

    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = own.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return own.join(sizes, "label", "left").select("vec_id", "label", "embedding", "n").mapInArrow(run, "vec_id bigint, label bigint, class binary, filters array<bigint>, sketch binary")


def _matrix(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.abs(x).max(1, keepdims=True)


def pairs_of_short_lists(postings: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of one list with near sketches, from postings sorted by list within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if not rows.num_rows:
                continue
            lists = np.stack([rows.column("label").to_numpy(), rows.column("filter").to_numpy()], 1)
            # the last list may go on in the next batch: it is held back, and its members are not compared again
            yield from compare(rows, lists, rows.num_rows - batch.num_rows)
            others = np.flatnonzero((lists != lists[-1]).any(1))
            held = rows.slice(int(others[-1]) + 1 if len(others) else 0)

    def compare(rows: pa.Table, lists: np.ndarray, fresh: int) -> Iterator[pa.RecordBatch]:
        node, long = rows.column("node").to_numpy(), rows.column("long").to_pylist()
        signs = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, SIGNS // 64)
        for lag in range(1, LONG_LIST + 1):
            left = np.flatnonzero((lists[lag:] == lists[:-lag]).all(1)) if lag < len(lists) else np.empty(0, int)
            if not len(left):
                break
            left = left[left + lag >= fresh]
            left = left[np.bitwise_count(signs[left] ^ signs[left + lag]).sum(1) <= DIFFERENT]
            # what shares a long list is verified there
            left = np.array([i for i in left.tolist() if not (long[i] and long[i + lag] and set(long[i]) & set(long[i + lag]))], int)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[left], node[left + lag])), pa.array(np.maximum(node[left], node[left + lag]))], names=["a", "b"])

    return postings.select("label", "filter", "node", "sketch", "long").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, root, links) of both sides of the pairs (a, b, size_a, size_b, x, y) whose vectors x and y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size_a, size_b = (batch.column(c).to_numpy() for c in ("a", "b", "size_a", "size_b"))
            raw = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good, width = np.zeros(len(a), bool), np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(*raw, strict=True)])
            for w in np.unique(width[width > 0]):
                of = np.flatnonzero(width == w)
                x, y = (_matrix([side[k] for k in of]) for side in raw)
                dot = lambda u, v: np.einsum("ij,ij->i", u, v)
                good[of] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))) >= cosine
            node, root = np.concatenate([a[good], b[good]]), np.concatenate([a[good], a[good]])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.concatenate([size_b[good], size_a[good]]))], names=["node", "root", "links"])

    return pairs.select("a", "b", "size_a", "size_b", "x", "y").mapInArrow(run, "node bigint, root bigint, links bigint")


def verify(cosine: float = COSINE):
    """For two blocks of a long list: (node, root, links), links counted once for each pair."""
    empty = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())]).empty_table()

    def run(rows: pa.Table) -> pa.Table:
        if rows.num_rows < 2:
            return empty
        ids, size, own = (rows.column(c).to_numpy() for c in ("node", "size", "own"))
        number = rows.column("filter")[0].as_py()
        raw = rows.column("class").to_pylist()
        width = np.array([len(r) for r in raw])
        cross = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        link = np.zeros((len(ids), len(ids)), bool)
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            x = _matrix([raw[k] for k in of])
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            link[np.ix_(of, of)] = x @ x.T / (norm[:, None] * norm[None, :]) >= cosine
        if cross:
            link &= own[:, None] != own[None, :]
        np.fill_diagonal(link, False)
        use = np.flatnonzero(link.any(1))
        if not len(use):
            return empty
        link = link[np.ix_(use, use)]
        # pairs that meet in an earlier long list count there
        lists = [np.array([f for f in rows.column("long")[int(k)].as_py() if f < number], np.int64) for k in use]
        owner = np.repeat(np.arange(len(use)), [len(x) for x in lists])
        names, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        if (count > 1).any():
            column = (np.cumsum(count > 1) - 1)[place]
            held = count[place] > 1
            member = np.zeros((len(use), int((count > 1).sum())), np.float32)
            member[owner[held], column[held]] = 1
            link &= member @ member.T == 0
        links = link @ size[use]
        root = forest(link)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[use[some]]), "root": pa.array(ids[use[root[some]]]), "links": pa.array(links[some].astype(np.int64))})

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    tune(spark)
    rows = materialise(spark, posted(vectors), "posted-vectors", gather=True)
    classes = rows.where("class IS NOT NULL").groupBy("label", "class").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("filters").alias("filters"), F.first("sketch").alias("sketch"))
    classes = materialise(spark, classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    postings = classes.select("node", "label", F.explode("filters").alias("filter"))
    members = postings.groupBy("label", "filter").agg(F.count("*").alias("m")).where("m > 1")
    met = materialise(spark, postings.join(members, ["label", "filter"]), "filter-lists")
    long = met.where(F.col("m") > LONG_LIST)
    nodes = classes.join(long.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("long")), "node", "left").select("node", "size", "class", "sketch", "long")
    short = met.where(F.col("m") <= LONG_LIST).join(nodes.select("node", "sketch", "long"), "node").repartition(partitions(spark), "label", "filter").sortWithinPartitions("label", "filter", "node")
    side = lambda name, vector: classes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("class").alias(vector))
    of_pairs = verified(pairs_of_short_lists(short).distinct().join(side("a", "x"), "a").join(side("b", "y"), "b"), cosine)
    dealt = long.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    blocks = dealt.join(nodes, "node").select("label", "filter", "i", "j", "own", "node", "size", "class", "long")
    of_blocks = blocks.groupBy("label", "filter", "i", "j").applyInArrow(verify(cosine), "node bigint, root bigint, links bigint")
    found = materialise(spark, of_pairs.union(of_blocks), "vector-links", gather=True)
    roots = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.select("node", "label", "class", "least", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = own.join(least, "root").select("label", "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    joined = rows.select("vec_id", "label", "class").join(of_class, ["label", "class"], "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  WITH RECURSIVE r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN link l ON l.a = r.vec_id)
  SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, v.vec_id = r.c AS kept
FROM v JOIN reach r ON r.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
