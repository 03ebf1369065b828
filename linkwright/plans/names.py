"""Queries over names, addresses and their features, with parts and documents as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions import similarity as S, text as T
from ..operators import pair_features as P
from ..operators.blocking import block


def _links(spark, sf_dir):
    return adapters.part_links(spark, sf_dir)


def _address_links(spark, sf_dir):
    return _links(spark, sf_dir).select("q", "pid", "a_addr", "b_addr")


def number_features(spark, sf_dir):
    return P.number_features(_address_links(spark, sf_dir))


def legal_features(spark, sf_dir):
    return P.legal_features(_links(spark, sf_dir).select("q", "pid", "a_legal", "b_legal"))


def length_features(spark, sf_dir):
    return P.length_features(_links(spark, sf_dir).select("q", "pid", "a_core", "b_core", "a_addr", "b_addr"))


def token_coverage(spark, sf_dir):
    """Whole-text word coverage of all candidate pairs of documents."""
    qry, pool = adapters.queries_and_pool(spark, sf_dir)
    found = block(qry, pool, keep=kept).select("q", "pid")
    d = found.join(qry.select("q", F.col("addr").alias("a_addr")), "q").join(pool.select("pid", F.col("addr").alias("b_addr")), "pid")
    return P.coverage(d, "a_addr", "b_addr", "addr").select("q", "pid", "addr_cov_a", "addr_cov_b")


def name_rarity(spark, sf_dir):
    parts = adapters.parts(spark, sf_dir).select("core1")
    d = P.name_rarity(_links(spark, sf_dir).select("q", "pid", "a_core", "b_core"), parts, parts)
    return d.select("q", "pid", "core_eq", *(F.round(c, 9).alias(c) for c in ("log_cnt_s1_a", "log_cnt_pool_b", "log_cnt_s1_b")))


def levenshtein_similarity(spark, sf_dir):
    n = adapters.name_pairs(spark, sf_dir)
    return n.select("a_core", "b_core", F.round(S.levenshtein_similarity(F.col("a_core"), F.col("b_core")), 9).alias("name_lev"), F.levenshtein(T.skeleton(F.col("a_core")), T.skeleton(F.col("b_core"))).alias("skeleton_lev"))


def jaro_winkler(spark, sf_dir):
    return adapters.name_pairs(spark, sf_dir).select("a_core", "b_core", F.round(S.measure(F.col("a_core"), F.col("b_core"), "jw"), 6).alias("name_jw"))


def fuzzy_ratios(spark, sf_dir):
    m = S.measures(F.col("a_core"), F.col("b_core"), "ratio", "partial", "tsort", "tset", "matcher")
    return adapters.name_pairs(spark, sf_dir).select("a_core", "b_core", m.alias("m")).select("a_core", "b_core", *(F.col(f"m.{k}").alias(f"name_{k}") for k in ("ratio", "partial", "tsort", "tset", "matcher")))


def decoy_features(spark, sf_dir):
    return P.decoy_features(adapters.name_pairs(spark, sf_dir))


def normalised_names(spark, sf_dir):
    """Every document's whole text read as a raw name: aliases, domains, leet, abbreviations, legal forms, core."""
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", T.folded("text").alias("t"))
    return T.with_parsed_name(d, "t").select("doc_id", *T.NAME_COLUMNS)


def normalised_addresses(spark, sf_dir):
    """Every document's whole text read as an address of its language's country."""
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", T.folded("text").alias("t"), T.norm_country(F.col("lang")).alias("ctry"))
    return d.select("doc_id", "ctry", T.norm_address(F.col("t"), F.col("ctry")).alias("addr"))


def text_shapes(spark, sf_dir):
    """Digits tagged, non-Latin share, house number, initials and spaced legal forms of whole texts."""
    d = adapters.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.md5(T.tag_digits(t)).alias("tagged_md5"), F.round(T.nonlatin_share(t), 9).alias("nl"), T.house(t).alias("house"), F.md5(T.initials(t)).alias("initials_md5"), F.md5(T.strip_spaced(t)).alias("stripped_md5"))


def domain_labels(spark, sf_dir):
    """The labels of page hosts read as domain names."""
    host = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)
    d = adapters.table(spark, sf_dir, "pages").select("page_id", F.lower(F.coalesce(host, F.lit(""))).alias("t"))
    return T.with_parsed_name(d, "t").select("page_id", "name1", "is_domain")


def string_features(spark, sf_dir):
    """All string features of the distinct pairs of part records that order lines link."""
    r = adapters.parts(spark, sf_dir)
    records = r.select(F.col("rid"), "core1", F.lit("").alias("name2"), "addr", "legal", F.lit("us").alias("ctry"), F.lit(0.0).alias("nl_name"), F.lit(0.0).alias("nl_addr"), F.col("core1").alias("core_rom"), F.col("addr").alias("addr_rom"))
    pairs = _links(spark, sf_dir).select(F.col("a_rid").alias("q"), F.col("b_rid").alias("pid")).distinct()
    qry, pool = records.withColumnRenamed("rid", "q"), records.withColumnRenamed("rid", "pid")
    return P.string_features(P.side_by_side(pairs, qry, pool), qry, pool, int(spark.conf.get("spark.sql.shuffle.partitions"))).drop(*(f"{s}_{c}" for s in "ab" for c in ("core", "name2", "addr", "legal", "ctry", "nl_name", "nl_addr", "core_rom", "addr_rom")))


from .blocking import _QUERY, kept  # noqa: E402

_PARTS = f"WITH {adapters.PARTS}"
_LINKS = f"WITH {adapters.PAIRS}, {adapters.PARTS}, {adapters.LINKS}"
_RUNS = "d AS (SELECT q, pid, a_addr, b_addr, regexp_extract_all(a_addr, '[0-9]+') AS a, regexp_extract_all(b_addr, '[0-9]+') AS b FROM links)"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


def _sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(replace(regexp_replace({text}, '[''’‘`]', '', 'g'), '&', ' and '), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


_LEET = f"CASE WHEN length(w) >= 4 AND length(regexp_replace(w, '[^0-9]', '', 'g')) = 1 AND length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) >= 3 AND regexp_replace(w, '[^0-9]', '', 'g') IN ({_list(T.LEET_FROM)}) THEN translate(w, '{T.LEET_FROM}', '{T.LEET_TO}') ELSE w END"
_NAME = lambda t: f"list_transform(list_transform({_sql_tokens(t)}, lambda w: {_LEET}), lambda w: {_case('w', T.NAME_ABBR)})"
_DOMAIN_SQL = r"(?i)^(?:https?://)?(?:www\.)?([^\s/@]+\.[a-z]{2,})(?:/\S*)?$"
_PARSE = f"""f AS (SELECT id, trim(t, ' ') AS t FROM raw),
  g AS (SELECT id, t, list_filter(list_transform(flatten(list_transform(string_split_regex(t, '\\s*\\|\\s*'), lambda x: string_split_regex(x, '{T.ALIAS_MARKERS}'))), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM f),
  h AS (SELECT id, t, list_filter(parts, lambda x: NOT regexp_matches(trim(x, '[]() '), '{_DOMAIN_SQL}')) AS names,
    list_transform(list_filter(parts, lambda x: regexp_matches(trim(x, '[]() '), '{_DOMAIN_SQL}')), lambda x: translate(regexp_replace(regexp_extract(trim(x, '[]() '), '{_DOMAIN_SQL}', 1), '{T.DOMAIN_ENDING}', ''), '-.', '  ')) AS doms FROM g),
  i AS (SELECT id, names, doms, coalesce(names[1], doms[1], t) AS prim, coalesce(names[2], CASE WHEN len(names) > 0 THEN doms[1] END, '') AS alias FROM h),
  j AS (SELECT id, names, doms, alias, {_NAME('prim')} AS t1, {_NAME('alias')} AS t2 FROM i),
  parsed AS (SELECT id, array_to_string(t1, ' ') AS name1, array_to_string(t2, ' ') AS name2,
    array_to_string(CASE WHEN len(list_filter(t1, lambda w: w NOT IN ({_list(T.LEGAL + T.STOP)}))) > 0 THEN list_filter(t1, lambda w: w NOT IN ({_list(T.LEGAL + T.STOP)})) ELSE t1 END, ' ') AS core1,
    array_to_string(list_sort(list_distinct(list_filter(t1, lambda w: w IN ({_list(T.LEGAL)})))), ' ') AS legal, len(names) = 0 AND len(doms) > 0 AS is_domain, alias <> '' AS has_alias FROM j)"""
_WORDS = lambda c: f"CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[^ ]', '', 'g')) + 1 ELSE 0 END"
_CUT = f"list_filter(list_transform({_sql_tokens('t')}, lambda w: CASE WHEN length(w) > 5 AND ends_with(w, 'cdp') THEN w[:-4] ELSE w END), lambda w: w NOT IN ({_list(T.ADDR_FILLER)}))"
_FOLD = "lower(strip_accents(coalesce(text, '')))"

QUERIES = {f.__name__: f for f in (
    number_features, legal_features, length_features, token_coverage, name_rarity, levenshtein_similarity, jaro_winkler, fuzzy_ratios, decoy_features, normalised_names, normalised_addresses, text_shapes,
    domain_labels, string_features,
)}
ORACLES = {
    "number_features": f"""{_LINKS}, {_RUNS}, e AS (SELECT *, len(list_intersect(a, b)) AS c, list_filter(a, lambda x: length(x) >= 5) AS pa, list_filter(b, lambda x: length(x) >= 5) AS pb FROM d)
      SELECT q, pid, a_addr, b_addr, c AS num_common, c / greatest(len(a), len(b), 1) AS num_common_frac, coalesce(a[1] = b[1], false)::INT AS house_eq, (len(list_intersect(pa, pb)) > 0)::INT AS pin_match,
        (len(pa) > 0 AND len(pb) > 0 AND len(list_intersect(pa, pb)) = 0)::INT AS pin_conflict, levenshtein(regexp_replace(a_addr, '[^0-9]', '', 'g'), regexp_replace(b_addr, '[^0-9]', '', 'g')) AS digits_lev, coalesce(levenshtein(a[1], b[1]), -1) AS house_lev FROM e""",
    "legal_features": f"{_LINKS} SELECT q, pid, a_legal, b_legal, (a_legal <> '' AND a_legal = b_legal)::INT AS legal_eq, (a_legal <> '' AND b_legal <> '' AND a_legal <> b_legal)::INT AS legal_conflict FROM links",
    "length_features": f"{_LINKS} SELECT q, pid, a_core, b_core, a_addr, b_addr, length(a_core) AS len_core_a, length(b_core) AS len_core_b, length(b_addr) AS len_addr_b, (length(b_addr) = 0)::INT AS addr_b_empty, {_WORDS('a_addr')} AS ntok_addr_a, {_WORDS('b_addr')} AS ntok_addr_b FROM links",
    "token_coverage": f"""{_QUERY}, d AS (SELECT c.q, c.pid, string_split(a.addr, ' ') AS x, string_split(b.addr, ' ') AS y FROM cand c JOIN qry a ON a.q = c.q JOIN pool b ON b.pid = c.pid)
      SELECT q, pid, len(list_intersect(x, y)) / len(x) AS addr_cov_a, len(list_intersect(x, y)) / len(y) AS addr_cov_b FROM d""",
    "name_rarity": f"""{_LINKS}, n AS (SELECT core1, count(*)::DOUBLE AS n FROM parts GROUP BY core1)
      SELECT q, pid, (a_core <> '' AND a_core = b_core)::INT AS core_eq, round(ln(1 + a.n), 9) AS log_cnt_s1_a, round(ln(1 + b.n), 9) AS log_cnt_pool_b, round(ln(1 + b.n), 9) AS log_cnt_s1_b FROM links l JOIN n a ON a.core1 = l.a_core JOIN n b ON b.core1 = l.b_core""",
    "levenshtein_similarity": f"{_PARTS} SELECT a_core, b_core, round(1 - levenshtein(a_core, b_core) / greatest(length(a_core), length(b_core)), 9) AS name_lev, levenshtein(regexp_replace(a_core, '[ aeiouy]', '', 'g'), regexp_replace(b_core, '[ aeiouy]', '', 'g')) AS skeleton_lev FROM name_pairs",
    "jaro_winkler": f"{_PARTS} SELECT a_core, b_core, round(jaro_winkler_similarity(a_core, b_core), 6) AS name_jw FROM name_pairs",
    "normalised_names": f"WITH raw AS (SELECT doc_id AS id, {_FOLD} AS t FROM documents), {_PARSE} SELECT id AS doc_id, * EXCLUDE (id) FROM parsed",
    "normalised_addresses": f"""WITH raw AS (SELECT doc_id, {_FOLD} AS t, {_case("trim(coalesce(lang, ''), ' ')", T.COUNTRY_ALIASES)} AS ctry FROM documents), c AS (SELECT doc_id, ctry, {_CUT} AS ws FROM raw)
      SELECT doc_id, ctry, array_to_string(CASE WHEN ctry = 'france' THEN list_transform(list_filter(ws, lambda w: w NOT IN ({_list(T.FR_FILLER)})), lambda w: {_case('w', T.ADDR_ABBR | T.FR_ADDR_ABBR)}) ELSE list_transform(ws, lambda w: {_case('w', T.ADDR_ABBR)}) END, ' ') AS addr FROM c""",
    "domain_labels": f"WITH raw AS (SELECT page_id AS id, lower(coalesce(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '')) AS t FROM pages), {_PARSE} SELECT id AS page_id, name1, is_domain FROM parsed",
}
