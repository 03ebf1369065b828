"""TF-IDF cosines of paired texts over exact terms, and language-free word features."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .. import storage
from ..functions import text as T

#: Terms of a chunk of records, each as often as it occurs: what a Python worker holds at a time.
OCCURRENCES = 2_000_000
#: Buckets of terms for each shuffle partition.
BUCKETS = 4
#: Bytes of pool vectors that a round of cosines exchanges, for each record of all.
BYTES_A_RECORD = 1_500


def char_terms(text: Column, n: int = 3) -> Column:
    """Character n-grams of each word with a blank on either side."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))
    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), grams))


def word_terms(text: Column) -> Column:
    """Words, and pairs of neighbouring words."""
    w = F.filter(F.split(text, " "), lambda x: x != "")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers of one width, sorted by their bytes' places and compressed."""
    planes = x.view(np.uint8).reshape(len(x), -1).T if len(x) else np.empty((0, 0), np.uint8)
    return len(x).to_bytes(8, "little") + bytes([x.dtype.itemsize]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(x: bytes) -> np.ndarray:
    n, width = int.from_bytes(x[:8], "little"), x[8]
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(x[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"u{width}").reshape(n).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """pack() of numbers from 0 on, in as few bytes as the largest takes."""
    top = int(x.max()) if len(x) else 0
    return pack(x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)))


def _steps(x: np.ndarray) -> bytes:
    """_small() of the steps between ascending numbers from 0 on."""
    return _small(np.diff(x, prepend=0))


def _cut(buckets: int):
    """Chunks of records: one row of their terms' places in the chunk's list, and one for each bucket of that list."""

    def chunk(batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        lists, asks = t["terms"].combine_chunks(), t["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        keys = pc.fill_null(t["key"], np.iinfo(np.int64).min).to_numpy()
        doc = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        at = (pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) % buckets).astype(np.int64) if len(words) else np.empty(0, np.int64)
        order = np.argsort(at, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found, tf = np.unique(doc * max(1, len(words)) + place[coded.indices.to_numpy()], return_counts=True)
        doc, term = np.divmod(found, max(1, len(words)))
        n_pool, n_asks = (np.bincount(term[asks[doc] == x], minlength=len(words)) for x in (False, True))
        name, rows = uuid.uuid4().hex, []
        first = np.diff(term, prepend=0) % max(1, len(words))
        rows.append((name, -1, [pack(keys.view(np.uint64)), _small(asks.astype(np.int64)), _small(np.bincount(doc, minlength=len(keys))), _small(first), _small(tf), _small(np.array([len(words)]))]))
        words, at = words.take(pa.array(order)).cast(pa.large_string()), at[order]
        offsets, text = (np.frombuffer(x or b"", kind) for x, kind in zip(words.buffers()[1:], (np.int64, np.uint8), strict=True))
        ends = np.searchsorted(at, np.arange(buckets + 1))
        for i in np.unique(at):
            x, y = ends[i], ends[i + 1]
            rows.append((name, int(i), [pack(text[offsets[x] : offsets[y]]), _small(np.diff(offsets[x : y + 1])), _small(n_pool[x:y]), _small(n_asks[x:y])]))
        for x in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[x : x + 256], strict=True), (pa.string(), pa.int32(), pa.list_(pa.binary())), strict=True)], ["chunk", "bucket", "parts"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column("terms").flatten())
            if n >= OCCURRENCES:
                yield from chunk(held)
                held, n = [], 0
        if sum(map(len, held)):
            yield from chunk(held)

    return run


def _number(buckets: int):
    """The chunks' lists of one bucket side by side: each term's frequency in the pool, and a number if both sides have it."""

    def run(t: pa.Table) -> pa.Table:
        bucket, lists, pools, queries = t["bucket"][0].as_py(), [], [], []
        for parts in t["parts"].to_pylist():
            text, sizes, n_pool, n_asks = map(unpack, parts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            lists.append(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text.astype(np.uint8))))
            pools.append(n_pool)
            queries.append(n_asks)
        codes = pa.concat_arrays(lists).dictionary_encode().indices.to_numpy()
        # whole numbers below 2^53: sums of doubles are exact
        df, asked = (np.bincount(codes, np.concatenate(x)).astype(np.int64) for x in (pools, queries))
        both = np.flatnonzero((df > 0) & (asked > 0))
        number = np.zeros(len(df), np.int64)
        number[both[np.argsort(-df[both], kind="stable")]] = np.arange(len(both)) * buckets + bucket + 1
        out, ends = [], np.cumsum([len(x) for x in lists])
        for end, x in zip(ends, lists, strict=True):
            own = codes[end - len(x) : end]
            out.append([_small(df[own]), _small(number[own])])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "parts": pa.array(out, pa.list_(pa.binary()))})

    return run


def _inverse(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 1


def _vector(n: int):
    """The records of one chunk: norms over all terms, numbers of the terms that both sides have (a pool record's as often as they occur)."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["bucket"].to_pylist(), t["parts"].to_pylist(), strict=True))
        keys, asks, sizes, term, tf, (words,) = map(unpack, rows[0][1])
        doc = np.repeat(np.arange(len(keys)), sizes)
        term = np.cumsum(term) % max(1, words)
        lists = [list(map(unpack, parts)) for _, parts in rows[1:]]
        df, number = (np.concatenate([x[i] for x in lists])[term] if lists else term for i in (0, 1))
        norm = np.sqrt(np.bincount(doc, (tf * _inverse(n, df)) ** 2, minlength=len(keys)))
        order = np.lexsort((number, doc))
        order = order[number[order] > 0]
        doc, tf, df, number = doc[order], tf[order], df[order], number[order]
        ends = np.searchsorted(doc, np.arange(len(keys) + 1))
        out = []
        for i, ask in enumerate(asks):
            own = slice(ends[i], ends[i + 1])
            out.append((_steps(number[own]), _small(tf[own]), _small(df[own])) if ask else (_steps(np.repeat(number[own], tf[own])), None, None))
        numbers, tfs, dfs = (pa.array(c, pa.binary()) for c in zip(*out, strict=True))
        return pa.table({"is_query": pa.array(asks.astype(bool)), "key": pa.array(keys), "numbers": numbers, "tf": tfs, "df": dfs, "norm": pa.array(norm)})

    return run


def _dots(n: int):
    """Queries with the pool records that they are paired with."""

    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            qs, pids, cosines = [], [], []
            for q, numbers, tf, df, norm, pool in zip(*(rows[c] for c in ("q", "numbers", "tf", "df", "norm", "pool")), strict=True):
                own = np.cumsum(unpack(numbers))
                qs += [q] * len(pool)
                pids += [x["pid"] for x in pool]
                if not len(own):
                    cosines.append(np.zeros(len(pool)))
                    continue
                w = unpack(tf) * _inverse(n, unpack(df)) ** 2 / norm
                lists = [np.cumsum(unpack(x["numbers"])) for x in pool]
                every = np.concatenate(lists)
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                dots = np.bincount(np.repeat(np.arange(len(pool)), [len(x) for x in lists]), np.where(own[at] == every, w[at], 0.0), minlength=len(pool))
                cosines.append(dots / np.array([x["norm"] or 1.0 for x in pool]))
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(pids, pa.int64()), pa.array(np.concatenate(cosines) if cosines else [], pa.float64())], ["q", "pid", "cos"])

    return run


def vectors(queries: DataFrame, pool: DataFrame, terms: Column, n_pool: int, repeated: bool = False) -> DataFrame:
    """(is_query, key, numbers, tf, df, norm) of all records, stored. repeated: rows of equal keys are one record.

    Terms are not exchanged by record. Chunks of records list their distinct terms, the lists meet in buckets by hash, and
    frequencies and numbers come back to the chunks: a term of all records is one entry for each chunk.
    """
    spark = pool.sparkSession
    records = [d.select(F.lit(ask).alias("is_query"), F.col(key).cast("bigint").alias("key"), terms.alias("terms")) for d, key, ask in ((queries, "q", True), (pool, "pid", False))]
    records = records[0].union(records[1])
    if repeated:
        records = records.groupBy("is_query", "key").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "chunk string, bucket int, parts array<binary>"
    chunks = storage.materialise(spark, records.mapInArrow(_cut(buckets), schema), "term-chunks")
    numbered = storage.materialise(spark, chunks.where("bucket >= 0").groupBy("bucket").applyInArrow(_number(buckets), schema), "term-numbers")
    of_chunks = chunks.where("bucket < 0").union(numbered).groupBy("chunk").applyInArrow(_vector(n_pool), "is_query boolean, key bigint, numbers binary, tf binary, df binary, norm double")
    found = storage.materialise(spark, of_chunks, "term-vectors")
    storage.drop(spark, *{f.rsplit("/", 1)[0] for d in (chunks, numbered) for f in d.inputFiles()})
    return found


def cosine(pairs: DataFrame, queries: DataFrame, pool: DataFrame, terms: Column, name: str) -> DataFrame:
    """pairs (q, pid) with the cosine of their texts' terms; 0 where they share none.

    Weights are tf * (ln((N + 1) / (df + 1)) + 1), with df and N of the pool. Pool vectors meet their queries in rounds of
    about BYTES_A_RECORD for each record of all, so that what is exchanged at a time stays in proportion to the records;
    every query is in one round.
    """
    spark = pairs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))
    keys = queries.select(F.lit(True).alias("ask"), F.col("q").alias("key")).union(pool.select(F.lit(False), "pid")).groupBy("ask", "key").count()
    seen = keys.agg(F.coalesce(F.sum(F.when(~F.col("ask"), F.col("count"))), F.lit(0)).alias("pool"), F.count("*").alias("records"), F.max("count").alias("most")).first()
    since = storage.mark()
    every = vectors(queries, pool, terms, seen["pool"], (seen["most"] or 0) > 1)
    asked = storage.materialise(spark, pairs.select("q", "pid").distinct(), "term-pairs")
    a = every.where("is_query").select(F.col("key").alias("q"), "numbers", "tf", "df", "norm")
    b = every.where("NOT is_query").select(F.col("key").alias("pid"), "numbers", "norm")
    # a vector goes with its norm, its key and its query
    size = asked.join(b.select("pid", (F.octet_length("numbers") + 32).alias("n")), "pid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, -(-size // max(1, BYTES_A_RECORD * seen["records"])))
    turn = F.pmod(F.xxhash64("q", F.lit("round")), F.lit(rounds))
    found = []
    for i in range(rounds):
        met = asked.where(turn == i).join(b, "pid").groupBy("q").agg(F.collect_list(F.struct("pid", "numbers", "norm")).alias("pool")).join(a, "q")
        found.append(storage.materialise(spark, met.select("q", "numbers", "tf", "df", "norm", "pool").mapInArrow(_dots(seen["pool"]), "q bigint, pid bigint, cos double"), f"term-cosines{i}"))
    dots = reduce(DataFrame.union, found)
    storage.drop_since(spark, since, dots)
    return pairs.join(dots.withColumnRenamed("cos", name), ["q", "pid"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def language_free(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Ten lf_* features of a pair from word frequencies of its country.

    queries (q, core1, name1, legal, ctry), pool (pid, core1, name1, legal, ctry).
    """
    words = lambda d: d.select("ctry", F.explode(F.array_distinct(F.split("core1", " "))).alias("w")).groupBy("ctry", "w").agg(F.count("*").alias("n"))
    total = lambda d, name: d.groupBy("ctry").agg(F.count("*").alias(name))
    st = words(queries).withColumnRenamed("n", "n1").join(words(pool).withColumnRenamed("n", "n2"), ["ctry", "w"], "full").na.fill(0, ["n1", "n2"]).join(total(queries, "t1"), "ctry").join(total(pool, "t2"), "ctry")
    st = st.select("ctry", "w", F.log(F.col("n1") + 1).alias("ldf"), (F.log((F.col("n2") + 1) / F.col("t2")) - F.log((F.col("n1") + 1) / F.col("t1"))).alias("lratio"), (F.col("n1") > 0).alias("known"))
    same = queries.groupBy("ctry", "core1").agg(F.count("*").alias("n_ns"))
    forms = T.legal_set(F.col("name1"), F.col("legal"))
    a = queries.join(same, ["ctry", "core1"]).select("q", "ctry", F.col("core1").alias("a_core"), forms.alias("la"), "n_ns")
    b = pool.select("pid", F.col("core1").alias("b_core"), forms.alias("lb"))
    wa, wb = F.array_distinct(F.split("a_core", " ")), F.array_distinct(F.split("b_core", " "))
    x = pairs.select("q", "pid").join(a, "q").join(b, "pid").select("*", F.array_except(wa, wb).alias("gone"), F.array_except(wb, wa).alias("new"), F.size(F.array_intersect(wa, wb)).alias("lf_n_common"))
    side = lambda c, *aggs: x.select("q", "pid", "ctry", F.explode(c).alias("w")).join(st, ["ctry", "w"]).groupBy("q", "pid").agg(*aggs)
    x = x.join(side("gone", F.max("ldf").alias("lf_miss_maxdf"), F.min("lratio").alias("lf_miss_minratio")), ["q", "pid"], "left").join(side("new", F.min("ldf").alias("lf_extra_mindf"), F.max("lratio").alias("lf_extra_maxratio")), ["q", "pid"], "left")
    x = x.join(st.where("known").select("ctry", F.col("w").alias("b_core"), F.lit(True).alias("voc")), ["ctry", "b_core"], "left")
    disjoint = (F.size("la") > 0) & (F.size("lb") > 0) & ~F.arrays_overlap("la", "lb")
    return x.select(
        "q", "pid", F.size("gone").alias("lf_n_miss"), F.size("new").alias("lf_n_extra"), "lf_n_common", "lf_miss_maxdf", "lf_miss_minratio", "lf_extra_mindf", "lf_extra_maxratio",
        disjoint.cast("int").alias("lf_legal_disj"), F.log("n_ns").alias("lf_log_ns"), (F.col("b_core").rlike("^[a-z]{6,}$") & F.col("voc").isNull()).cast("int").alias("lf_coined"),
    )
