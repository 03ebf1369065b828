"""Candidate generation with a token index: document frequencies, composite rare tokens, IDF sums, top k per query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import TYPES, BlockParams

#: Pairs of a query and a token's posting that a round of scoring exchanges, for each query of all.
PAIRS_A_QUERY = 500
#: Tokens over the frequency cap that are sent to all tasks.
MOST_FREQUENT = 20_000


def base_tokens(records: DataFrame, id_col: str, prm: BlockParams = BlockParams()) -> DataFrame:
    """Distinct (id, typ, w): name words (n), address words (a) and prefixes of long words (p)."""
    name, addr = F.split(F.concat_ws(" ", "core1", "name2"), " "), F.split("addr", " ")
    long = F.filter(F.concat(name, addr), lambda w: (F.length(w) >= prm.min_prefix_len) & ~w.rlike("^[0-9]+$"))
    words = lambda ws: F.array_distinct(F.filter(ws, lambda w: F.length(w) >= 2))
    tagged = lambda typ, ws: F.transform(ws, lambda w: F.struct(F.lit(typ).alias("typ"), w.alias("w")))
    # a record's tokens are distinct within the row, so that no shuffle is needed
    all_tokens = F.concat(tagged("n", words(name)), tagged("a", words(addr)), tagged("p", F.array_distinct(F.transform(long, lambda w: F.substring(w, 1, prm.prefix_len)))))
    return records.select(F.col(id_col).alias("id"), F.explode(all_tokens).alias("t")).select("id", "t.typ", "t.w")


def tagged(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", "typ", F.concat("typ", F.lit(":"), "w").alias("tok"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(tok, typ, df) of tagged tokens."""
    return tokens.groupBy("tok", "typ").agg(F.count("*").alias("df"))


def composites(base: DataFrame, base_df: DataFrame, prm: BlockParams = BlockParams()) -> DataFrame:
    """(id, typ, w) of pairs of a record's rarest words: name with address (c), names (m), addresses (d), digits with words (h).

    Rarity is the frequency in the pool; a word that the pool lacks takes no part. One window ranks all words of a
    record, and the few words that count are combined within its row.
    """
    digit, known = F.col("w").rlike("[0-9]"), F.col("df").isNotNull()
    # one pass and one exchange by record: words that the pool lacks stay for the digits of h, and rank behind all others
    plain_words, freq = base.where("typ IN ('n', 'a')"), base_df.select("typ", F.expr("substring(tok, 3)").alias("w"), "df")
    # the commonest words get their frequency where they are, and only a record's rarest of them are exchanged; digits go the long way, for h
    most = F.broadcast(freq.where("typ IN ('n', 'a')").where((F.col("df") > prm.cap_df) & ~F.col("w").rlike("[0-9]")).orderBy(F.desc("df"), "typ", "w").limit(MOST_FREQUENT))
    deep = max(prm.comp_name, prm.comp_addr, prm.comp_m, prm.comp_d, prm.comp_h)
    few = F.row_number().over(Window.partitionBy("id", "typ").orderBy("df", "w"))
    common = plain_words.join(most, ["typ", "w"]).withColumn("few", few).where(F.col("few") <= deep).drop("few")
    seen = common.unionByName(plain_words.join(most, ["typ", "w"], "left_anti").join(freq, ["typ", "w"], "left"))
    rare = [F.col("df").asc_nulls_last(), F.col("w")]
    order, plain = Window.partitionBy("id", "typ").orderBy(*rare), Window.partitionBy("id", "typ", digit).orderBy(*rare)
    ranked = seen.withColumn("rk", F.when(known, F.row_number().over(order))).withColumn("rw", F.when(known & ~digit, F.row_number().over(plain)))
    at = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("w"))))
    name, addr = F.col("typ") == "n", F.col("typ") == "a"
    rows = ranked.groupBy("id").agg(
        at(name & (F.col("rk") <= prm.comp_name)).alias("n_c"), at(addr & (F.col("rk") <= prm.comp_addr)).alias("a_c"), at(name & (F.col("rk") <= prm.comp_m)).alias("n_m"),
        at(addr & (F.col("rk") <= prm.comp_d)).alias("a_d"), at(addr & (F.col("rw") <= prm.comp_h)).alias("a_h"), F.collect_list(F.when(addr & digit, F.col("w"))).alias("a_n"),
    )

    def product(typ: str, left: str, right: str, ordered: bool) -> Column:
        one = F.flatten(F.transform(left, lambda x: F.transform(F.filter(right, lambda y: (x < y) if ordered else F.lit(True)), lambda y: F.struct(F.lit(typ).alias("typ"), F.concat(x, F.lit("|"), y).alias("w")))))
        return F.coalesce(one, F.array().cast("array<struct<typ:string,w:string>>"))

    every = F.concat(product("c", "n_c", "a_c", False), product("m", "n_m", "n_m", True), product("d", "a_d", "a_d", True), product("h", "a_n", "a_h", False))
    return rows.select("id", F.explode(every).alias("t")).select("id", "t.typ", "t.w")


def pool_index(pool: DataFrame, prm: BlockParams = BlockParams(), keep: Callable[[str, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (id, typ, tok), frequencies of base tokens, frequencies of all tokens.

    Tokens are read several times. keep(name, df) may store each table and return the stored one, so that texts are cut
    once; without it Spark reuses only the exchanges.
    """
    keep = keep or (lambda _, df: df)
    base = keep("base", base_tokens(pool, "pid", prm))
    base_df = keep("base_df", document_frequency(tagged(base)))
    pairs = keep("pairs", tagged(composites(base, base_df, prm)))
    # no base token is a composite one, so that the frequencies of both stand side by side
    return tagged(base).union(pairs), base_df, base_df.union(keep("pairs_df", document_frequency(pairs)))


def query_tokens(queries: DataFrame, base_df: DataFrame, df: DataFrame, n_pool: int | Column, prm: BlockParams = BlockParams(), base: DataFrame | None = None) -> DataFrame:
    """(q, typ, tok, df, idf): the rarest tokens of each query and type below the frequency cap. base: the queries' base tokens, if stored."""
    base = base or base_tokens(queries, "q", prm)
    every = tagged(base).union(tagged(composites(base, base_df, prm)))
    kept = df.where(F.col("df") <= prm.cap_df)
    limit = reduce(lambda c, k: c.when(F.col("typ") == k, prm.per_type[k]), prm.per_type, F.when(F.lit(False), 0)).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("id", "typ").orderBy("df", "tok"))
    n = F.lit(n_pool) if isinstance(n_pool, int) else n_pool
    idf = F.round(F.log(n.cast("double") / F.col("df")) * prm.scale).cast("bigint")
    every = every.join(over_cap(base_df, prm), "tok", "left_anti").join(kept, ["tok", "typ"])
    return every.withColumn("rk", rank).where(F.col("rk") <= limit).select(F.col("id").alias("q"), "typ", "tok", "df", idf.alias("idf"))


def shared_tokens(qtok: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each token that a query and a pool record share. The cap on frequencies bounds every join key's fan-out."""
    return qtok.select("q", "typ", "tok", "idf").join(postings.select(F.col("id").alias("pid"), "tok"), "tok")


def score(shared: DataFrame) -> DataFrame:
    """(q, pid, score, ns, s_<type>...): IDF sums over shared tokens (q, pid, typ, idf)."""
    by_type = [F.coalesce(F.sum(F.when(F.col("typ") == t, F.col("idf"))), F.lit(0)).alias(f"s_{t}") for t in TYPES]
    return shared.groupBy("q", "pid").agg(F.sum("idf").alias("score"), F.count("*").alias("ns"), *by_type)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query; Spark cuts groups before and after the exchange."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "pid"))
    return scored.withColumn("rk", rank).where(F.col("rk") <= k).drop("rk")


def over_cap(df: DataFrame, prm: BlockParams = BlockParams()) -> DataFrame:
    """The at most MOST_FREQUENT commonest tokens over the cap: sent to all tasks, they save most tokens an exchange that would only drop them."""
    return F.broadcast(df.where(F.col("df") > prm.cap_df).orderBy(F.desc("df"), "tok").limit(MOST_FREQUENT).select("tok"))


def token_lists(qtok: DataFrame, postings: DataFrame, frequent: DataFrame) -> DataFrame:
    """(tok, pids) of the tokens that queries ask for. The cap on frequencies bounds every list."""
    asked = postings.select("id", "tok").join(frequent, "tok", "left_anti").join(qtok.select("tok").distinct(), "tok", "left_semi")
    return asked.groupBy("tok").agg(F.sort_array(F.collect_list("id")).alias("pids"))


def score_lists(qtok: DataFrame, lists: DataFrame) -> DataFrame:
    """What score() returns, of whole lists: they meet at their query before they become rows, and no pair is exchanged."""
    met = qtok.join(lists, "tok").select("q", "typ", "idf", "pids").repartition("q")
    return score(met.select("q", "typ", "idf", F.explode("pids").alias("pid")))


def block(queries: DataFrame, pool: DataFrame, prm: BlockParams = BlockParams(), keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best candidates of each query.

    With keep, queries are scored in rounds of about PAIRS_A_QUERY pairs for each query of all, so that what is exchanged
    at a time stays in proportion to the records; every query is in one round. The cap bounds the number of rounds.
    """
    postings, base_df, df = pool_index(pool, prm, keep)
    n_pool = pool.count()
    own = keep("query_base", base_tokens(queries, "q", prm)) if keep else None
    qtok = query_tokens(queries, base_df, df, n_pool, prm, own).where(F.col("typ").isin(*prm.types))
    if not keep:
        return top_k(score(shared_tokens(qtok, postings)), prm.k)
    qtok = keep("qtok", qtok)
    lists = keep("lists", token_lists(qtok, postings, over_cap(base_df, prm)))
    total = qtok.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("pairs"), F.countDistinct("q").alias("queries")).first()
    rounds = max(1, -(-total["pairs"] // max(1, PAIRS_A_QUERY * total["queries"])))
    turn = F.pmod(F.xxhash64("q", F.lit("round")), F.lit(rounds))
    return reduce(DataFrame.union, [keep(f"best{i}", top_k(score_lists(qtok.where(turn == i), lists), prm.k)) for i in range(rounds)])


def found_pairs(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The true pairs with found, n_matches of their query, and which token types hit."""
    hit = candidates.select("q", "pid", F.lit(True).alias("hit"), *(F.col(f"s_{t}") for t in TYPES))
    n = truth.groupBy("q").agg(F.count("*").alias("n_matches"))
    return truth.join(n, "q").join(hit, ["q", "pid"], "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def recall(found: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of counts: pairs, found pairs, queries all or any of whose pairs are found, candidates, queries with some."""
    by_q = found.groupBy("q").agg(F.min(F.col("found").cast("int")).alias("all_"), F.max(F.col("found").cast("int")).alias("any_"))
    a = found.agg(F.count("*").alias("true_pairs"), F.sum(F.col("found").cast("int")).alias("found_pairs"))
    b = by_q.agg(F.count("*").alias("q_with_truth"), F.sum("all_").alias("q_all_found"), F.sum("any_").alias("q_any_found"))
    c = candidates.agg(F.count("*").alias("candidates"), F.countDistinct("q").alias("q_with_candidates"))
    # single rows of totals
    return a.crossJoin(b).crossJoin(c).crossJoin(queries.agg(F.count("*").alias("queries")))


def recall_by(found: DataFrame, column: str) -> DataFrame:
    return found.groupBy(column).agg(F.count("*").alias("true_pairs"), F.sum(F.col("found").cast("int")).alias("found_pairs"))


def coverage(found: DataFrame) -> DataFrame:
    """For each token type, how many of the found pairs it hits."""
    hits = found.where("found").select(F.explode(F.create_map(*(x for t in TYPES for x in (F.lit(t), F.col(f"s_{t}") > 0)))).alias("typ", "hit"))
    return hits.groupBy("typ").agg(F.count("*").alias("found_pairs"), F.sum(F.col("hit").cast("int")).alias("hits"))


def diagnose(truth: DataFrame, queries: DataFrame, pool: DataFrame, prm: BlockParams = BlockParams(), keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(q, pid, n_shared, min_df) of every true pair, without any frequency cap."""
    postings, base_df, df = pool_index(pool, prm, keep)
    base = base_tokens(queries, "q", prm)
    every = tagged(base).union(tagged(composites(base, base_df, prm))).select(F.col("id").alias("q"), "tok")
    pairs = truth.select("q", "pid")
    left = pairs.join(every, "q")
    right = postings.join(pairs.select(F.col("pid").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("pid"), "tok")
    shared = left.join(right, ["pid", "tok"]).join(df.select("tok", "df"), "tok").groupBy("q", "pid").agg(F.count("*").alias("n_shared"), F.min("df").alias("min_df"))
    return pairs.join(shared, ["q", "pid"], "left").select("q", "pid", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "min_df")


def miss_breakdown(found: DataFrame, reach: DataFrame, cap_df: int) -> DataFrame:
    """Why true pairs are missed: no shared token, only tokens over the cap, or lost to the limits."""
    d = found.select("q", "pid", "found").join(reach, ["q", "pid"])
    lost = ~F.col("found")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.agg(
        F.count("*").alias("true_pairs"), n(lost).alias("missed"), n(lost & (F.col("n_shared") == 0)).alias("unreachable"),
        n(lost & (F.col("n_shared") > 0) & (F.col("min_df") > cap_df)).alias("over_cap"), n(lost & (F.col("n_shared") > 0) & (F.col("min_df") <= cap_df)).alias("truncated"),
    )


def local_features(candidates: DataFrame) -> DataFrame:
    """Features of the pruner: rank, gap, ratio and shared-token gap within the query, number of token types."""
    w = Window.partitionBy("q")
    types = reduce(lambda a, b: a + b, [(F.col(f"s_{t}") > 0).cast("int") for t in TYPES])
    top, ns = F.max("score").over(w), F.max("ns").over(w)
    return candidates.select("*", F.row_number().over(w.orderBy(F.desc("score"), "pid")).alias("rank_q"), (top - F.col("score")).alias("gap_q"), (F.col("score") / F.greatest(top, F.lit(1))).alias("ratio_q"), (ns - F.col("ns")).alias("ns_gap_q"), types.alias("n_types"))


def competition_features(candidates: DataFrame) -> DataFrame:
    """Ranks, gaps and counts within the query and within the pool record, over all queries."""
    q, p = Window.partitionBy("q"), Window.partitionBy("pid")
    d = candidates.select("*", F.row_number().over(q.orderBy(F.desc("score"), "pid")).alias("rank_q"), (F.max("score").over(q) - F.col("score")).alias("gap_q"), F.count("*").over(q).alias("n_cand_q"))
    rank = F.row_number().over(p.orderBy(F.desc("score"), "q"))
    d = d.withColumn("rank_p", rank).withColumn("n_q_for_p", F.count("*").over(p))
    second = F.coalesce(F.max(F.when(F.col("rank_p") == 2, F.col("score"))).over(p), F.lit(0))
    first = F.max(F.when(F.col("rank_p") == 1, F.col("score"))).over(p)
    return d.withColumn("margin_p", F.col("score") - F.when(F.col("rank_p") == 1, second).otherwise(first))
