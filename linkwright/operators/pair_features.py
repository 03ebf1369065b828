"""Features of two records side by side: columns a_* and b_* of names, addresses, legal forms and counts.

string_features returns 48 columns; those that built-in functions express stay in the JVM, the others come from Arrow
passes over the distinct kinds of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as S, text as T


def _int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def number_features(pairs: DataFrame) -> DataFrame:
    """num_common, num_common_frac, house_eq, pin_match, pin_conflict, digits_lev, house_lev of a_addr and b_addr."""
    runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"(\d+)"), F.lit(1))
    pins = lambda ns: F.filter(ns, lambda x: F.length(x) >= 5)
    a, b = runs("a_addr"), runs("b_addr")
    common = F.size(F.array_intersect(a, b))
    ha, hb = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    shared = F.size(F.array_intersect(pins(a), pins(b)))
    only = lambda c: F.regexp_replace(c, r"\D", "")
    return pairs.select(
        "*", common.alias("num_common"), (common / F.greatest(F.size(a), F.size(b), F.lit(1))).alias("num_common_frac"), _int(ha == hb).alias("house_eq"), _int(shared > 0).alias("pin_match"),
        _int((F.size(pins(a)) > 0) & (F.size(pins(b)) > 0) & (shared == 0)).alias("pin_conflict"), F.levenshtein(only("a_addr"), only("b_addr")).alias("digits_lev"),
        F.coalesce(F.levenshtein(ha, hb), F.lit(-1)).alias("house_lev"),
    )


def legal_features(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a_legal"), F.col("b_legal")
    return pairs.select("*", _int((a != "") & (a == b)).alias("legal_eq"), _int((a != "") & (b != "") & (a != b)).alias("legal_conflict"))


def length_features(pairs: DataFrame) -> DataFrame:
    words = lambda c: F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^ ]", "")) + 1).otherwise(0)
    return pairs.select("*", F.length("a_core").alias("len_core_a"), F.length("b_core").alias("len_core_b"), F.length("b_addr").alias("len_addr_b"), _int(F.length("b_addr") == 0).alias("addr_b_empty"), words("a_addr").alias("ntok_addr_a"), words("b_addr").alias("ntok_addr_b"))


def coverage(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """<name>_cov_a, <name>_cov_b: distinct shared words over the words of either side."""
    x, y = F.split(a, " "), F.split(b, " ")
    shared = F.size(F.array_intersect(x, y))
    return pairs.select("*", (shared / F.size(x)).alias(f"{name}_cov_a"), (shared / F.size(y)).alias(f"{name}_cov_b"))


def name_rarity(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """core_eq, and log counts of queries with a's name, pool records with b's name, queries with b's name."""
    in_queries, in_pool = queries.groupBy("core1").agg(F.count("*").alias("n")), pool.groupBy("core1").agg(F.count("*").alias("n"))
    d = pairs
    for key, counts, name in (("a_core", in_queries, "log_cnt_s1_a"), ("b_core", in_pool, "log_cnt_pool_b"), ("b_core", in_queries, "log_cnt_s1_b")):
        d = d.join(counts.select(F.col("core1").alias(key), F.col("n").alias("_n")), key, "left").withColumn(name, F.log1p(F.coalesce("_n", F.lit(0)))).drop("_n")
    return d.withColumn("core_eq", _int((F.col("a_core") != "") & (F.col("a_core") == F.col("b_core"))))


def decoy_features(pairs: DataFrame) -> DataFrame:
    """How two core names differ: edits, insert-delete distance, substitutions, lengths, first letter, word difference."""
    a, b = F.coalesce("a_core", F.lit("")), F.coalesce("b_core", F.lit(""))
    m = S.measures(a, b, "indel", "hamming")
    lev, same = F.levenshtein(a, b).cast("double"), F.length(a) == F.length(b)
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    wa, wb = words(a), words(b)
    first = (a != "") & (b != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    d = pairs.withColumn("_m", m)
    return d.select("*", lev.alias("dc_lev"), F.col("_m.indel").alias("dc_indel"), (F.col("_m.indel") - lev).alias("dc_sub"), F.abs(F.length(a) - F.length(b)).alias("dc_lendiff"), same.cast("int").alias("dc_same_len"), F.when(same, F.col("_m.hamming")).alias("dc_ham"), first.cast("int").alias("dc_first"), (F.size(F.array_except(wa, wb)) + F.size(F.array_except(wb, wa))).alias("dc_wordsym")).drop("_m")


def fuzzy_features(pairs: DataFrame) -> DataFrame:
    """The measures of names, addresses, aliases, joined names, digits, romanised texts and skeletons."""
    c = F.col
    bare = lambda x: F.regexp_replace(x, " ", "")
    only = lambda x: F.regexp_replace(x, r"\D", "")
    d = pairs.select(
        "*", S.measures(c("a_core"), c("b_core"), "ratio", "partial", "tsort", "tset", "jw").alias("_n"), S.measures(c("a_addr"), c("b_addr"), "ratio", "partial", "tsort", "tset").alias("_a"),
        S.measure(c("a_core"), c("b_name2"), "tset").alias("_x"), S.measure(c("a_name2"), c("b_core"), "tset").alias("_y"), S.measures(bare("a_core"), bare("b_core"), "ratio", "partial", "jw").alias("_s"),
        S.measure(only("a_addr"), only("b_addr"), "ratio").alias("digits_ratio"), S.measures(c("a_core_rom"), c("b_core_rom"), "tset", "partial", "jw").alias("_r"),
        S.measure(T.skeleton(c("a_core_rom")), T.skeleton(c("b_core_rom")), "ratio").alias("skel_ratio"), S.measure(c("a_addr_rom"), c("b_addr_rom"), "tset").alias("addr_rom_tset"),
        S.measure(T.skeleton(c("a_addr_rom")), T.skeleton(c("b_addr_rom")), "ratio").alias("addr_skel_ratio"),
    )
    named = [c(f"_n.{k}").alias(f"name_{k}") for k in ("ratio", "partial", "tsort", "tset", "jw")] + [c(f"_a.{k}").alias(f"addr_{k}") for k in ("ratio", "partial", "tsort", "tset")]
    named += [F.greatest("_x", "_y").alias("alias_tset"), c("_s.ratio").alias("name_nospace_ratio"), c("_s.partial").alias("nospace_partial"), c("_s.jw").alias("nospace_jw")]
    named += [c(f"_r.{k}").alias(f"rom_{k}") for k in ("tset", "partial", "jw")]
    named += [S.levenshtein_similarity(c("a_core"), c("b_core")).alias("name_lev"), S.levenshtein_similarity(c("a_addr"), c("b_addr")).alias("addr_lev")]
    return d.select("*", *named).drop("_n", "_a", "_x", "_y", "_s", "_r")


def string_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame, tasks: int | None = None) -> DataFrame:
    """All features of pairs that carry both records' normalised columns as a_* and b_*.

    The measures cost much more than the bytes of a pair tell: tasks deals pairs out where adaptive execution would
    gather them in a few partitions.
    """
    if tasks:
        pairs = pairs.repartition(tasks, "q", "pid")
    d = fuzzy_features(legal_features(length_features(number_features(pairs))))
    d = coverage(coverage(d, "a_core", "b_core", "name"), "a_addr", "b_addr", "addr")
    d = d.select("*", F.col("b_nl_name").alias("nl_name_b"), F.col("b_nl_addr").alias("nl_addr_b"), _int(F.col("a_ctry") == F.col("b_ctry")).alias("same_ctry"))
    return name_rarity(d, queries, pool)


def side_by_side(candidates: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates (q, pid, ...) with the normalised columns of both records."""
    columns = ["core1", "name2", "addr", "legal", "ctry", "nl_name", "nl_addr", "core_rom", "addr_rom"]
    names = {"core1": "core"}
    side = lambda d, key, s: d.select(key, *(F.col(c).alias(f"{s}_{names.get(c, c)}") for c in columns))
    return candidates.join(side(queries, "q", "a"), "q").join(side(pool, "pid", "b"), "pid")
