"""Quality rules: counts of every text, and robust multivariate outliers per language and source.

The counts become a vector of transformed statistics. Location and scatter of each (language, source) are estimated by
the minimum covariance determinant in nested subsets: the rows of a group are dealt into chunks of about CHUNK_ROWS,
concentration steps run from several starts in every chunk, the chunks' estimates are merged, and further concentration
steps over all rows of the group follow, in which every chunk keeps the nearest half of its rows. Then the scatter, made
consistent for normal rows, weighs the rows: those within NEAR give the last estimate. All rows take part; a group may
hold any share of the corpus, as only chunks meet in a task. Small groups lean on the merged scatter of all groups. A row
is rejected if its squared Mahalanobis distance exceeds CUTOFF. Rows that fail the base rules take no part in the
estimates.

The estimate sets the scale where the ordinary rows of a group vary. The three shares are nought in most texts, so their
scatter is often nought too; RESOLUTION is added to the deviations there and keeps the scatter invertible.

Defined results: a null or empty text has no words and fails the base rules; a null language or source is the group of
the empty name; a null doc_id is kept; repeated rows are judged each; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, table, tune
from .minhash import word_hashes

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
CHUNK_ROWS = 2_000
STEPS = 30
FULL_STEPS = 2
#: Rows that the scatter of all groups weighs in a group.
PRIOR_ROWS = 100
#: Half of normal rows in five dimensions have a scatter smaller than all of them by this factor.
CONSISTENCY = 1.9122
#: Chi-squared with 5 degrees of freedom: the quantile that rows of the last estimate lie within, and the one of a rejection,
#: which a normal row exceeds with a probability of 1e-6.
NEAR = 12.833
CUTOFF = 35.888
STATISTICS = ("log words", "log word length", "symbol share", "repeated share", "doubled lines")
#: Deviations that are no signal even where a group is uniform: a percent of words; the sampling error of a mean word length
#: over a hundred words; one symbol in 400 characters; one window of three or one line that a text of 45 lines repeats.
RESOLUTION = np.array([0.01, 0.05, 0.05, 0.15, 0.15])
_P = len(STATISTICS)

_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(found: list[bytes], window: int = 3) -> int:
    """Words that stand in a window of words found twice or more."""
    n = len(found) - window + 1
    if n < 2:
        return 0
    one = word_hashes(found)
    mixed = one[:n].copy()
    for k in range(1, window):
        mixed = mixed * _STEP + one[k : k + n]
    _, place, count = np.unique(mixed, return_inverse=True, return_counts=True)
    hit = count[place] > 1
    covered = np.zeros(len(found), bool)
    for k in range(window):
        covered[k : k + n] |= hit
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, characters in words, symbols, doubled lines, repeated words, lines with a word."""
    text = text or ""
    found = text.encode().split()
    seen: set[str] = set()
    doubled = lines = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            doubled += line in seen
            seen.add(line)
    return len(found), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), doubled, repeated_words(found), lines


def vector(c: tuple[int, ...]) -> list[float]:
    """The transformed statistics."""
    n, chars, symbols, doubled, repeated, lines = c
    return [float(np.log1p(n)), float(np.log(max(chars, 1) / max(n, 1))), float(np.sqrt(symbols / max(chars, 1))), float(np.sqrt(repeated / max(n, 1))), float(np.sqrt(doubled / max(lines, 1)))]


def base_failed(c: tuple[int, ...]) -> bool:
    return c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEATED_PERCENT * c[0]


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of each row with its language, source and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:5]] if found else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([base_failed(c) for c in found], pa.bool_()), batch.column(2), batch.column(3), pa.array([vector(c) for c in found], pa.list_(pa.float64()))], names=_NAMES)

    named = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return named.mapInArrow(run, _SCHEMA)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lang", "source", "x"]
_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, lang string, source string, x array<double>"
_ESTIMATE = "lang string, source string, kept bigint, total array<double>, products array<double>"


def _matrix(rows: pa.Table) -> np.ndarray:
    return np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, _P)


def distances(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances."""
    apart = x - mean
    return np.einsum("ij,ij->i", apart @ np.linalg.inv(scatter + np.diag(RESOLUTION**2)), apart)


def half(n: int) -> int:
    """The rows that an estimate of least determinant rests on: the fewest that stand for most of n rows."""
    return min(n, (n + _P + 1) // 2)


def concentrate(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Concentration steps: the nearest rows give the next estimate, until the rows stay the same."""
    h, before = half(len(x)), None
    for _ in range(steps):
        near = np.argpartition(distances(x, mean, scatter), h - 1)[:h]
        near.sort()
        if before is not None and np.array_equal(near, before):
            break
        before, mean = near, x[near].mean(0)
        scatter = (x[near] - mean).T @ (x[near] - mean) / h
    return mean, scatter, float(np.linalg.slogdet(scatter + np.diag(RESOLUTION**2))[1])


def minimum_determinant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate of least determinant from three starts: medians and deviations, spatial signs, all rows."""
    middle = np.median(x, 0)
    spread = np.median(np.abs(x - middle), 0) * 1.4826
    scaled = (x - middle) / np.maximum(spread, RESOLUTION)
    signs = scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    unit = np.maximum(spread, RESOLUTION)
    starts = [(middle, np.diag(spread**2)), (middle, signs.T @ signs / len(x) * _P * np.outer(unit, unit)), (x.mean(0), np.cov(x, rowvar=False, bias=True))]
    best = min((concentrate(x, *s) for s in starts), key=lambda e: e[2])
    return best[0], best[1]


def _sums(lang: str, source: str, x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, last: bool = False) -> pa.Table:
    """One row: the sums over the nearest half of the rows, or over all that lie within NEAR."""
    if last:
        near = x[distances(x, mean, scatter * CONSISTENCY) <= NEAR]
    else:
        h = half(len(x))
        near = x[np.argpartition(distances(x, mean, scatter), h - 1)[:h]]
    return pa.table({"lang": [lang], "source": [source], "kept": pa.array([len(near)], pa.int64()), "total": [near.sum(0).tolist()], "products": [(near.T @ near).ravel().tolist()]})


def _nothing() -> pa.Table:
    return pa.schema([("lang", pa.string()), ("source", pa.string()), ("kept", pa.int64()), ("total", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))]).empty_table()


def _first(key: tuple, rows: pa.Table) -> pa.Table:
    x = _matrix(rows.filter(pa.compute.invert(rows.column("base_failed"))))
    return _sums(key[0].as_py(), key[1].as_py(), x, *minimum_determinant(x)) if len(x) else _nothing()


def _unpack(estimate: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    row = estimate.slice(0, 1).to_pylist()[0]
    return np.array(row["mean"]), np.array(row["scatter"]).reshape(_P, _P)


def _step(last: bool):
    def step(key: tuple, rows: pa.Table, estimate: pa.Table) -> pa.Table:
        x = _matrix(rows.filter(pa.compute.invert(rows.column("base_failed"))))
        if not len(x) or not estimate.num_rows:
            return _nothing()
        return _sums(key[0].as_py(), key[1].as_py(), x, *_unpack(estimate), last)

    return step


def _judge(_key: tuple, rows: pa.Table, estimate: pa.Table) -> pa.Table:
    failed = rows.column("base_failed").to_numpy()
    d = np.zeros(rows.num_rows)
    if estimate.num_rows and rows.num_rows:
        d = distances(_matrix(rows), *_unpack(estimate))
    kept = ~failed & (d <= CUTOFF)
    return rows.select(_NAMES[:7]).append_column("kept", pa.array(kept)).append_column("distance", pa.array(d))


def merged(estimates: DataFrame) -> DataFrame:
    """(lang, source, mean, scatter) of each group from its chunks' sums, small groups drawn to all groups' scatter."""
    items = lambda column, n: [F.sum(F.col(column)[i]).alias(f"{column}{i}") for i in range(n)]
    sums = estimates.groupBy("lang", "source").agg(F.sum("kept").alias("kept"), *items("total", _P), *items("products", _P * _P)).where("kept > 0")
    mean = [F.col(f"total{i}") / F.col("kept") for i in range(_P)]
    own = [F.col(f"products{i * _P + j}") / F.col("kept") - mean[i] * mean[j] for i in range(_P) for j in range(_P)]
    groups = sums.select("lang", "source", "kept", F.array(*mean).alias("mean"), *(c.alias(f"s{k}") for k, c in enumerate(own)))
    pooled = groups.agg(*(F.coalesce(F.sum(F.col(f"s{k}") * F.col("kept")) / F.sum("kept"), F.lit(0.0)).alias(f"p{k}") for k in range(_P * _P)))
    # one row of scatter meets one row for each group
    both = groups.join(F.broadcast(pooled))
    scatter = F.array(*((F.col(f"s{k}") * F.col("kept") + F.col(f"p{k}") * PRIOR_ROWS) / (F.col("kept") + PRIOR_ROWS) for k in range(_P * _P)))
    return both.select("lang", "source", "mean", scatter.alias("scatter"))


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every row."""
    tune(spark)
    rows = materialise(spark, statistics(docs), "statistics", gather=True)
    sizes = rows.groupBy("lang", "source").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    # rows are dealt by their place in the table, so that equal rows part too; the table is written, so their places stay
    rows = materialise(spark, rows.join(sizes, ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("chunks"))).drop("chunks"), "chunks")
    keys = ["lang", "source", "chunk"]
    names = materialise(spark, rows.select(*keys).distinct(), "chunk-names")
    estimates = rows.groupBy(*keys).applyInArrow(_first, _ESTIMATE)

    def by_chunk(estimates: DataFrame, tag: str) -> DataFrame:
        """The estimate of its group for each chunk."""
        return names.join(materialise(spark, merged(estimates), tag), ["lang", "source"])

    for last in [False] * FULL_STEPS + [True]:
        estimates = rows.groupBy(*keys).cogroup(by_chunk(estimates, "estimates").groupBy(*keys)).applyInArrow(_step(last), _ESTIMATE)
    schema = ", ".join(_SCHEMA.split(", ")[:7]) + ", kept boolean, distance double"
    return rows.groupBy(*keys).cogroup(by_chunk(estimates, "estimates").groupBy(*keys)).applyInArrow(_judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))
