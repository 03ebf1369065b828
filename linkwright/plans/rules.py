"""Queries over name relations and the rule engine, with parts as records and order lines as scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..functions import relations as R, similarity as S, text as T
from ..operators import blocking as B, consensus as C, rules as E
from ..operators.decision import assign_exclusive
from .scored_pairs import THRESHOLD

CAPS = {2: 2, 3: 3}
SURE = 0.4
SPEC = "swap_all:0.5,legalhouse:0.45,thrp:0.3,typeswap:1.01:0.5:1,protect:0.28,cap"
#: The rules that part names as they are never meet.
SHAPE_SPECS = {
    "swap_beside_exact": "swap_exact:0.6", "weak_name": "weak:60:0.6:shared", "french_forms": "legalx:0.6", "protected_shapes": "thrpk:0.6:alias", "exact_far": "exactfar:0.6:90", "swap_no_noise": "swapn:0.6",
    "kind_in_band": "kind:other:2:0.55:0.26", "core_differs": "thrx:0.5", "type_inserted": "typeins:0.6:0.5", "external_score": "xfr:other:0.3:0.6", "tiny_name": "tiny:0.6", "legal_and_house": "legalhouse:0.6",
}
EDGES = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.01]


def _shapes(d):
    """Links with names in the shapes that part names lack, by the house of b: a type word or a noise word added, three letters, a noise word swapped in."""
    b, first = F.col("b_core"), F.element_at(F.split("a_core", " "), 1)
    shapes = [b, F.concat_ws(" ", b, "b_legal"), F.substring(b, 1, 3), F.concat_ws(" ", b, F.lit("fils")), F.concat_ws(" ", first, F.lit("groupe"))]
    return d.withColumn("b_core", F.element_at(F.array(*shapes), F.col("b_house") % 5 + 1))


def _features(spark, sf_dir, shape=lambda d: d):
    """Features of every pair: names, legal forms, houses, and the swap flag."""
    d = shape(adapters.part_links(spark, sf_dir))
    df = R.word_frequency(adapters.parts(spark, sf_dir))
    d = R.with_protection(R.swap_flag(d.drop("label"), df))
    conflict = ((F.col("a_legal") != "") & (F.col("b_legal") != "") & (F.col("a_legal") != F.col("b_legal"))).cast("int")
    return d.withColumn("legal_conflict", conflict).withColumn("house_eq", (F.col("a_house") == F.col("b_house")).cast("int")).withColumn("core_eq", F.col("a_core") == F.col("b_core")).withColumn("addr_tset", F.when(F.col("a_house") == F.col("b_house"), 100.0).otherwise(50.0))


def _owned(spark, sf_dir):
    return assign_exclusive(_features(spark, sf_dir)).where(F.col("p") >= THRESHOLD)


def _shaped(spark, sf_dir):
    """Owned pairs of shaped names, with what the other rules look at."""
    d = assign_exclusive(_features(spark, sf_dir, _shapes)).where(F.col("p") >= THRESHOLD)
    exact = d.where(F.col("core_eq") & (F.col("p") >= SURE)).groupBy("q").agg(F.count("*").alias("n_exact"))
    at = C.address_multiplicity(adapters.parts(spark, sf_dir).select("rid", "addr")).select(F.col("rid").alias("a_rid"), "addr_n")
    both = F.size(R.shared()) / F.size(F.array_union(R.word_set(F.col("a_core")), R.word_set(F.col("b_core"))))
    form = lambda c: F.when(c % 7 > 0, F.array(F.element_at(F.array(*map(F.lit, R.FR_FORMS)), c % 10 + 1))).otherwise(F.array().cast("array<string>"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return d.join(exact, "q", "left").na.fill(0, ["n_exact"]).join(at, "a_rid").withColumns({
        "name_tset": 100 * both, "glue": S.measure(bare("a_core"), bare("b_core"), "matcher"), "kind": R.restore_kind(), "a_forms": form(F.col("a_house")), "b_forms": form(F.col("b_house")),
        "score_other": F.pmod(F.col("pid") + F.col("q"), F.lit(100)) / 100,
    })


def _slots(spark, sf_dir):
    return E.slots(_owned(spark, sf_dir), adapters.universe(spark, sf_dir), SURE)


def _words(spark, sf_dir):
    return E.Vocabulary(type_word_vocabulary(spark, sf_dir), R.word_frequency(adapters.parts(spark, sf_dir)))


def _shown(d):
    return d.select("q", "pid", "p", F.array_join("fired", "+").alias("fired"), "dropped")


def word_swap_flag(spark, sf_dir):
    return R.swap_flag(adapters.name_pairs(spark, sf_dir), R.word_frequency(adapters.parts(spark, sf_dir))).select("a_core", "b_core", "xa", "xb", "swap")


def name_relation_kind(spark, sf_dir):
    """Restore kinds of all candidate pairs of documents."""
    qry, pool = adapters.queries_and_pool(spark, sf_dir)
    d = B.block(qry, pool, keep=kept).select("q", "pid").join(qry.select("q", F.col("core1").alias("a_core")), "q").join(pool.select("pid", F.col("core1").alias("b_core")), "pid")
    return d.select("q", "pid", R.restore_kind().alias("kind"))


def band_relation_kind(spark, sf_dir):
    d = adapters.name_pairs(spark, sf_dir).withColumn("b_name", F.col("b_core"))
    return R.name_relation(d).select("a_core", "b_core", "kind")


def spaced_legal_forms(spark, sf_dir):
    """Names with spelt legal forms: stripped, and the set of their forms."""
    forms = F.explode(F.array(*map(F.lit, T.SPACED_LEGAL))).alias("form")
    d = adapters.parts(spark, sf_dir).select("core1").distinct().select("core1", forms).select(F.concat_ws(" ", "core1", "form").alias("name"))
    sets = T.legal_set(F.col("name"), F.lit("sas sarl"))
    return d.select("name", T.strip_spaced(F.col("name")).alias("stripped"), F.array_join(F.array_sort(sets), ",").alias("forms"))


def initials_subsequence(spark, sf_dir):
    d = adapters.name_pairs(spark, sf_dir)
    return d.select("a_core", "b_core", T.is_subsequence(T.initials(F.col("a_core")), F.col("b_core")).alias("inside"))


def type_word_vocabulary(spark, sf_dir):
    d = E.learn_vocabulary(_owned(spark, sf_dir), _slots(spark, sf_dir), 1)
    return d.select("w", "n_full", "n_empty", F.round("ratio", 9).alias("ratio"))


def slot_occupancy(spark, sf_dir):
    d = E.slot_occupancy(_owned(spark, sf_dir).where("swap"), _slots(spark, sf_dir), {2: 5, 3: 6})
    return d.select("src", *(F.round(c, 6).alias(c) for c in ("d", "t", "decoy_share")))


def _one(spec):
    def query(spark, sf_dir):
        return _shown(E.fired(_owned(spark, sf_dir), E.parse(spec), _words(spark, sf_dir) if "type" in spec else None))

    return query


rule_threshold, rule_legal_conflict, rule_swap, rule_noise_spared = _one("thr:0.4"), _one("legal:0.5"), _one("swap_all:0.5"), _one("thrpn:0.4:0.3")
rule_type_swap, rule_type_conflict = _one("typeswap:1.01:0.5:1"), _one("typeconf:1.01:0.5")
rule_any_fired = _one("swap_all:0.5,legalhouse:0.45,thrp:0.3")


def _on_shapes(spec):
    def query(spark, sf_dir):
        total = adapters.parts(spark, sf_dir).groupBy(F.col("legal").alias("w")).agg(F.count("*").alias("n_full"))
        types = total.select("w", "n_full", F.lit(100).alias("n_empty"), F.lit(1.0).alias("ratio")) if "type" in spec else None
        return _shown(E.fired(_shaped(spark, sf_dir), E.parse(spec), E.Vocabulary(types)))

    return query


def rule_alias_protection(spark, sf_dir):
    """A pool alias that holds all words of the query's name: here b's own name, where the houses are even."""
    alias = F.when(F.col("b_house") % 2 == 0, F.col("b_core")).otherwise("")
    return _shown(E.fired(_shaped(spark, sf_dir).withColumn("b_alias", alias), E.parse("thr:0.5")))


def protect_emptied(spark, sf_dir):
    return _shown(E.protect(E.fired(_owned(spark, sf_dir), E.parse("thr:0.4,swap_all:0.5")), 0.28))


def drop_list(spark, sf_dir):
    f = _features(spark, sf_dir)
    listed = f.where(F.col("house_eq") == 0).select("q", "pid")
    return E.decode(adapters.pairs(spark, sf_dir), f, "droplist:away", THRESHOLD, lists={"away": listed}).select("q", "pid", "p")


def restore_unowned(spark, sf_dir):
    f = _features(spark, sf_dir).drop("p", "src", "swap")
    return E.restore(adapters.pairs(spark, sf_dir), 0.45, ["exact"], 0.05, f, CAPS).select("q", "pid", "p")


def add_list(spark, sf_dir):
    listed = adapters.pairs(spark, sf_dir).where("label = 1").select("q", "pid")
    return E.add_list(adapters.pairs(spark, sf_dir), 0.45, listed, CAPS).select("q", "pid", "p")


def rule_cap(spark, sf_dir):
    return E.cap(adapters.pairs(spark, sf_dir), 0.1, {2: 1, 3: 1}).select("q", "pid", "p")


def decode_rules(spark, sf_dir):
    """A whole specification: drop rules, protection, capacity."""
    f = _features(spark, sf_dir).drop("p")
    return E.decode(adapters.pairs(spark, sf_dir), f, SPEC, THRESHOLD, words=_words(spark, sf_dir), caps=CAPS).select("q", "pid", F.round("p", 9).alias("p"))


def cell_rate_excess(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("c_custkey"))
    home = orders.join(adapters.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(adapters.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("ctry")), "n_nationkey").select("q", "ctry")
    cells = _features(spark, sf_dir).join(home, "q").withColumn("kind", R.restore_kind()).withColumn("band", R.band(F.col("p") * 2))
    d = E.cell_excess(E.cell_rates(cells, home), "nation_6", ["nation_8", "nation_18"])
    return d.select("kind", "band", "n", F.round("share_lo", 6).alias("share_lo"), F.round("share_hi", 6).alias("share_hi"))


def score_bins(spark, sf_dir):
    d = E.score_bins(adapters.pairs(spark, sf_dir).withColumn("xs", F.col("p")), EDGES)
    return d.select("bin", "lo", "hi", "n_true", "n_false", F.round("lr", 9).alias("lr"))


def posterior_cuts(spark, sf_dir):
    return E.posterior_cuts(E.score_bins(adapters.pairs(spark, sf_dir).withColumn("xs", F.col("p")), EDGES), 0.5, 0.5, 0.5, 0.5)


def rare_street_words(spark, sf_dir):
    qry, pool = adapters.queries_and_pool(spark, sf_dir)
    return R.rare_words(qry.select("addr"), pool.select("addr"))


def namesakes(spark, sf_dir):
    """Document records with an equal name and a shared rare word."""
    qry, pool = adapters.queries_and_pool(spark, sf_dir)
    streets = R.street_words(qry, "q", R.rare_words(qry.select("addr"), pool.select("addr")))
    return E.namesakes(qry.select("q", "core1").join(streets, "q", "left").withColumn("street", F.coalesce("street", F.array().cast("array<string>"))), "q")


_L = f"WITH {adapters.PAIRS}, {adapters.PARTS}, {adapters.LINKS}"
_SETS = "list_distinct(string_split({0}, ' '))"
_STRIP = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '{T._SPACED}', ' ', 'g'), '{T._SPACED}', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_DIFF = lambda x, y: f"list_filter(list_distinct(string_split({x}, ' ')), lambda w: NOT list_contains(string_split({y}, ' '), w))"
_FREQ = "freq AS (SELECT w, count(*) AS df FROM (SELECT rid, unnest(list_distinct(string_split(core1, ' '))) AS w FROM parts) GROUP BY w)"
_SWAP = lambda t, out: f"""{out}0 AS (SELECT *, {_DIFF('a_core', 'b_core')} AS da, {_DIFF('b_core', 'a_core')} AS db FROM {t}),
  {out}1 AS (SELECT * EXCLUDE (da, db), CASE WHEN len(da) = 1 AND len(db) = 1 THEN da[1] END AS xa, CASE WHEN len(da) = 1 AND len(db) = 1 THEN db[1] END AS xb FROM {out}0),
  {out} AS (SELECT t.*, coalesce(fa.df >= 100 AND fb.df >= 100 AND length(xa) > 2 AND length(xb) > 2, false) AS swap FROM {out}1 t LEFT JOIN freq fa ON fa.w = xa LEFT JOIN freq fb ON fb.w = xb)"""  # noqa: E731
_F = f"""{_L}, {_FREQ}, {_SWAP('links', 'sw')},
  feat AS (SELECT *, a_core = b_core AS eq, (a_legal <> b_legal AND a_legal <> '' AND b_legal <> '') AS conflict, a_house = b_house AS same_house FROM sw),
  own AS (SELECT * FROM (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= {THRESHOLD})"""
_KIND = f"""CASE WHEN a_core = b_core THEN 'exact' WHEN {_STRIP('a_core')} = {_STRIP('b_core')} THEN 'spelled_legal'
  WHEN length(b_core) BETWEEN 2 AND 3 AND NOT contains(b_core, ' ') AND starts_with(array_to_string(list_transform(string_split(a_core, ' '), lambda w: w[1]), ''), b_core) THEN 'initials'
  WHEN replace(a_core, ' ', '') = replace(b_core, ' ', '') THEN 'glued' WHEN len(gone) = 1 AND len(new) = 1 AND new[1] IN ('fils', 'groupe', 'services', 'developpement') THEN 'noise_swap'
  WHEN len(gone) <= 1 AND len(new) >= 1 AND len(list_filter(new, lambda w: w NOT IN ('fils', 'groupe', 'services', 'developpement', 'and', 'et', 'associes'))) = 0
    AND len(list_filter(new, lambda w: w IN ('fils', 'groupe', 'services', 'developpement', 'associes'))) > 0 THEN 'noise_extra' ELSE 'other' END"""
_INITIALS = "array_to_string(list_transform(string_split(a_core, ' '), lambda w: w[1]), '')"
_FORM = lambda c: f"CASE WHEN {c} % 7 > 0 THEN [{R.FR_FORMS}[{c} % 10 + 1]] ELSE [] END"
#: Shapes as the plan makes them, whose noise words are two; a name is spared if it is equal, initials, or noise words apart.
_S = f"""{_L}, {_FREQ}, shaped AS (SELECT * REPLACE ([b_core, b_core || ' ' || b_legal, b_core[1:3], b_core || ' fils', string_split(a_core, ' ')[1] || ' groupe'][b_house % 5 + 1] AS b_core) FROM links), {_SWAP('shaped', 'sw')},
  own0 AS (SELECT * FROM (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= {THRESHOLD}),
  near AS (SELECT addr, count(*) AS addr_n FROM parts GROUP BY addr),
  own1 AS (SELECT o.*, n.addr_n, {_DIFF('a_core', 'b_core')} AS gone, {_DIFF('b_core', 'a_core')} AS new, len({_SETS.format('a_core')}) AS na, count(*) FILTER (WHERE a_core = b_core AND p >= {SURE}) OVER (PARTITION BY q) AS n_exact,
    a_core = b_core AS eq, a_house = b_house AS same_house, a_legal <> b_legal AND a_legal <> '' AND b_legal <> '' AS conflict FROM own0 o JOIN near n ON n.addr = o.a_addr),
  own2 AS (SELECT *, na - len(gone) AS alike, len(gone) <= 1 AND len(new) >= 1 AND len(list_filter(new, lambda w: w NOT IN ('fils', 'groupe'))) = 0 AS noise, {_KIND} AS kind, length(b_core) BETWEEN 2 AND 3 AND NOT contains(b_core, ' ') AND starts_with({_INITIALS}, b_core) AS ini FROM own1),
  own AS (SELECT *, eq OR ini OR noise AS spared FROM own2)"""
_SLOTS = f"""exact AS (SELECT q, src, count(*) AS k FROM own WHERE eq AND p >= {SURE} GROUP BY ALL),
  slot AS (SELECT u.q, s.src, coalesce(k, 0) AS k FROM universe u CROSS JOIN (VALUES (2), (3)) s(src) LEFT JOIN exact e ON e.q = u.q AND e.src = s.src)"""
_VOCAB = f"""{_F}, {_SLOTS}, ns AS (SELECT count(*) FILTER (WHERE k >= 1) AS a, count(*) FILTER (WHERE k = 0) AS b FROM slot),
  vw AS (SELECT xb AS w, count(*) FILTER (WHERE k >= 1) AS n_full, count(*) FILTER (WHERE k = 0) AS n_empty FROM own o JOIN slot s ON s.q = o.q AND s.src = o.src WHERE swap GROUP BY xb),
  vocab AS (SELECT w, n_full, n_empty, round(coalesce((n_full / a) / (n_empty / b + 1e-12::DOUBLE), 0), 9) AS ratio FROM vw, ns)"""


def _fire(*rules: tuple[str, str]) -> str:
    """SQL of pairs with the names of the rules that fire."""
    names = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + "], lambda x: x IS NOT NULL), '+')"
    return f"SELECT q, pid, p, {names} AS fired, {names} <> '' AS dropped FROM own"


#: Part names have neither spaced forms nor noise words, and none is of three letters.
_THRP = lambda t: f"p < {t} AND NOT eq"
_TYPES = "(SELECT w FROM vocab WHERE ratio >= 0.5 AND n_full + n_empty >= {0})"
_RELOW = f"least(p, {THRESHOLD}::DOUBLE - 1e-6::DOUBLE)"
_FREE = lambda thr, cond, join: f"""ow AS (SELECT q, pid, src FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= {thr}),
  us AS (SELECT q, src, count(*) AS used FROM ow GROUP BY ALL),
  fr AS (SELECT x.*, coalesce(used, 0) AS used, CASE x.src WHEN 2 THEN 2 ELSE 3 END AS cap FROM {join} x LEFT JOIN us ON us.q = x.q AND us.src = x.src WHERE x.pid NOT IN (SELECT pid FROM ow)),
  ok AS (SELECT * FROM fr WHERE used < cap AND {cond} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1),
  ad AS (SELECT q, pid FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY p DESC, pid) AS r FROM ok) WHERE r <= cap - used)
  SELECT p.q, p.pid, CASE WHEN a.pid IS NOT NULL THEN greatest(p.p, {thr}::DOUBLE + 1e-4::DOUBLE) ELSE p.p END AS p FROM pairs p LEFT JOIN ad a ON a.q = p.q AND a.pid = p.pid"""  # noqa: E731
_RARE = f"""WITH {adapters.RECORDS}, wc AS (SELECT s, w, count(*) AS n FROM (SELECT 1 AS s, unnest(list_distinct(string_split(addr, ' '))) AS w FROM qry UNION ALL SELECT 2, unnest(list_distinct(string_split(addr, ' '))) FROM pool) GROUP BY ALL),
  rare AS (SELECT w FROM wc GROUP BY w HAVING NOT bool_or(n >= 0.003::DOUBLE * CASE s WHEN 1 THEN (SELECT count(*) FROM qry) ELSE (SELECT count(*) FROM pool) END) AND NOT regexp_matches(w, '[0-9]') AND length(w) >= 3)"""

QUERIES = {
    **{f.__name__: f for f in (word_swap_flag, name_relation_kind, band_relation_kind, spaced_legal_forms, initials_subsequence, type_word_vocabulary, slot_occupancy)},
    "rule_threshold": rule_threshold, "rule_legal_conflict": rule_legal_conflict, "rule_swap": rule_swap, "rule_noise_spared": rule_noise_spared, "rule_type_swap": rule_type_swap,
    "rule_type_conflict": rule_type_conflict, "rule_any_fired": rule_any_fired, "rule_alias_protection": rule_alias_protection,
    **{f"rule_{name}": _on_shapes(spec) for name, spec in SHAPE_SPECS.items()},
    **{f.__name__: f for f in (protect_emptied, drop_list, restore_unowned, add_list, rule_cap, decode_rules, cell_rate_excess, score_bins, posterior_cuts, rare_street_words, namesakes)},
}
ORACLES = {
    "word_swap_flag": f"WITH {adapters.PARTS}, {_FREQ}, {_SWAP('name_pairs', 'sw')} SELECT a_core, b_core, xa, xb, swap FROM sw",
    "spaced_legal_forms": f"""WITH {adapters.PARTS}, n AS (SELECT core1 || ' ' || form AS name FROM names CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in T.SPACED_LEGAL)}) t(form))
      SELECT name, {_STRIP('name')} AS stripped, array_to_string(list_sort(list_distinct(list_concat(['sas', 'sarl'], list_filter([{', '.join(f"CASE WHEN contains(' ' || name || ' ', ' {k} ') THEN '{v}' END" for k, v in T.SPACED_LEGAL.items())}], lambda x: x IS NOT NULL)))), ',') AS forms FROM n""",
    "initials_subsequence": f"""WITH {adapters.PARTS}, n AS (SELECT a_core, b_core, list_transform(string_split(a_core, ' '), lambda w: w[1]) AS i FROM name_pairs)
      SELECT a_core, b_core, regexp_matches(b_core, array_to_string(i, '.*')) AS inside FROM n""",
    "type_word_vocabulary": f"{_VOCAB} SELECT * FROM vocab",
    "slot_occupancy": f"""{_F}, {_SLOTS}, c AS (SELECT q, src, count(*) AS n FROM own WHERE swap GROUP BY ALL),
      per AS (SELECT s.src, (t.cap - k) / t.cap AS x, coalesce(c.n, 0) AS y FROM slot s JOIN (VALUES (2, 5), (3, 6)) t(src, cap) ON t.src = s.src LEFT JOIN c ON c.q = s.q AND c.src = s.src WHERE k <= t.cap),
      g AS (SELECT src, count(*)::DOUBLE AS w, sum(x) AS x, sum(x * x) AS xx, sum(y)::DOUBLE AS y, sum(x * y) AS xy FROM per GROUP BY src),
      h AS (SELECT *, CASE WHEN w * xx - x * x = 0 THEN 0 ELSE (w * xy - x * y) / (w * xx - x * x) END AS t FROM g), i AS (SELECT *, (y - t * x) / w AS d FROM h)
      SELECT src, round(d, 6) AS d, round(t, 6) AS t, round(CASE WHEN y > 0 THEN least(1, greatest(d, 0) * w / y) END, 6) AS decoy_share FROM i""",
    "rule_threshold": f"{_F} {_fire(('thr', 'p < 0.4'))}",
    "rule_legal_conflict": f"{_F} {_fire(('legal', 'conflict AND p < 0.5'))}",
    "rule_swap": f"{_F} {_fire(('swap_all', 'swap AND p < 0.5'))}",
    "rule_noise_spared": f"{_F} {_fire(('thrpn', _THRP(0.4) + ' AND p >= 0.3'))}",
    "rule_type_swap": f"{_VOCAB} {_fire(('typeswap', 'swap AND p < 1.01 AND xb IN ' + _TYPES.format(1)))}",
    "rule_type_conflict": f"{_VOCAB}, tw AS (SELECT coalesce(list(w), []) AS ws FROM vocab WHERE ratio >= 0.5 AND n_full + n_empty >= 100) "
    + _fire(("typeconf", f"p < 1.01 AND len(list_intersect({_DIFF('a_core', 'b_core')}, (SELECT ws FROM tw))) > 0 AND len(list_intersect({_DIFF('b_core', 'a_core')}, (SELECT ws FROM tw))) > 0")),
    "rule_any_fired": f"{_F} {_fire(('swap_all', 'swap AND p < 0.5'), ('legalhouse', 'conflict AND NOT same_house AND p < 0.45'), ('thrp', _THRP(0.3)))}",
    "rule_swap_beside_exact": f"{_S} {_fire(('swap_exact', 'swap AND n_exact >= 1 AND p < 0.6'))}",
    "rule_weak_name": f"{_S} {_fire(('weak', '100.0 * alike / (alike + len(gone) + len(new)) < 60 AND same_house AND p < 0.6 AND addr_n >= 2'))}",
    "rule_french_forms": f"{_S} {_fire(('legalx', f'a_house % 7 > 0 AND b_house % 7 > 0 AND len(list_intersect({_FORM("a_house")}, {_FORM("b_house")})) = 0 AND p < 0.6'))}",
    # no three letters are alike enough to a whole name to count as glued
    "rule_protected_shapes": f"""{_S}, keep AS (SELECT q, pid, spared OR (len(gone) = 0 AND len(list_filter(new, lambda w: w NOT IN ('fils', 'groupe', 'services', 'developpement', 'france', 'and', 'et', 'associes', 'cie'))) = 0)
        OR (length(b_core) BETWEEN 2 AND 4 AND NOT contains(b_core, ' ') AND starts_with({_INITIALS}, b_core)) OR (len(gone) >= 1 AND len(new) = 0) OR (len(gone) + len(new) >= 3 AND alike >= 1) OR (alike = 0 AND addr_n = 1) AS k FROM own)
      """ + _fire(("thrpk", "p < 0.6 AND (SELECT NOT k FROM keep WHERE keep.q = own.q AND keep.pid = own.pid)")),
    "rule_exact_far": f"{_S} {_fire(('exactfar', 'eq AND p < 0.6 AND NOT same_house'))}",
    "rule_swap_no_noise": f"{_S} {_fire(('swapn', 'swap AND NOT noise AND p < 0.6'))}",
    "rule_kind_in_band": f"""{_S} {_fire(('kind', "kind = 'other' AND src = 2 AND p < 0.55 AND p >= 0.26 AND NOT spared"))}""",
    "rule_core_differs": f"{_S} {_fire(('thrx', 'p < 0.5 AND NOT eq'))}",
    "rule_type_inserted": f"{_S} {_fire(('typeins', 'len(gone) = 0 AND len(new) = 1 AND p < 0.6 AND new[1] IN (SELECT legal FROM parts)'))}",
    "rule_external_score": f"{_S} {_fire(('xfr', '((pid + q) % 100) / 100 < 0.3 AND p < 0.6'))}",
    "rule_tiny_name": f"{_S} {_fire(('tiny', "length(b_core) <= 3 AND NOT contains(b_core, ' ') AND p < 0.6 AND NOT ini"))}",
    "rule_legal_and_house": f"{_S} {_fire(('legalhouse', 'conflict AND NOT same_house AND p < 0.6'))}",
    "rule_alias_protection": f"""{_S} SELECT q, pid, p, CASE WHEN p < 0.5 THEN 'thr' ELSE '' END AS fired, p < 0.5 AND NOT (b_house % 2 = 0 AND len(gone) = 0) AS dropped FROM own""",
    "protect_emptied": f"""{_F}, fi AS ({_fire(('thr', 'p < 0.4'), ('swap_all', 'swap AND p < 0.5'))}), al AS (SELECT *, bool_or(NOT dropped) OVER (PARTITION BY q) AS alive FROM fi),
      may AS (SELECT *, dropped AND fired = 'thr' AND p >= 0.28 AND NOT alive AS may FROM al)
      SELECT q, pid, p, fired, dropped AND NOT (may AND row_number() OVER (PARTITION BY q, may ORDER BY p DESC, pid) = 1) AS dropped FROM may""",
    "drop_list": f"{_F} SELECT x.q, x.pid, CASE WHEN o.pid IS NOT NULL THEN least(x.p, {THRESHOLD}::DOUBLE - 1e-6::DOUBLE) ELSE x.p END AS p FROM pairs x LEFT JOIN own o ON o.q = x.q AND o.pid = x.pid AND NOT o.same_house",
    "restore_unowned": f"{_L}, " + _FREE("0.45", "a_core = b_core AND p >= 0.05 AND a_house = b_house", "links"),
    "add_list": f"WITH {adapters.PAIRS}, " + _FREE("0.45", "label = 1", "pairs"),
    "rule_cap": f"""WITH {adapters.PAIRS}, ow AS (SELECT * FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= 0.1),
      ov AS (SELECT q, pid FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY p DESC, pid) AS r FROM ow) WHERE r > 1)
      SELECT x.q, x.pid, CASE WHEN o.pid IS NOT NULL THEN least(x.p, 0.1::DOUBLE - 1e-6::DOUBLE) ELSE x.p END AS p FROM pairs x LEFT JOIN ov o ON o.q = x.q AND o.pid = x.pid""",
    "decode_rules": f"""{_VOCAB}, fi AS ({_fire(('swap_all', 'swap AND p < 0.5'), ('legalhouse', 'conflict AND NOT same_house AND p < 0.45'), ('thrp', _THRP(0.3)), ('typeswap', 'swap AND xb IN ' + _TYPES.format(1)))}),
      al AS (SELECT *, bool_or(NOT dropped) OVER (PARTITION BY q) AS alive FROM fi), may AS (SELECT *, dropped AND fired = 'thrp' AND p >= 0.28 AND NOT alive AS may FROM al),
      dr AS (SELECT q, pid FROM (SELECT *, row_number() OVER (PARTITION BY q, may ORDER BY p DESC, pid) AS r FROM may) WHERE dropped AND NOT (may AND r = 1)),
      lo AS (SELECT x.q, x.pid, x.src, CASE WHEN d.pid IS NOT NULL THEN least(x.p, {THRESHOLD}::DOUBLE - 1e-6::DOUBLE) ELSE x.p END AS p FROM pairs x LEFT JOIN dr d ON d.q = x.q AND d.pid = x.pid),
      ow AS (SELECT * FROM (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= {THRESHOLD}),
      ov AS (SELECT q, pid FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY p DESC, pid) AS r FROM ow) WHERE r > CASE src WHEN 2 THEN 2 ELSE 3 END)
      SELECT x.q, x.pid, round(CASE WHEN o.pid IS NOT NULL THEN least(x.p, {THRESHOLD}::DOUBLE - 1e-6::DOUBLE) ELSE x.p END, 9) AS p FROM lo x LEFT JOIN ov o ON o.q = x.q AND o.pid = x.pid""",
    "cell_rate_excess": f"""{_L}, h AS (SELECT o_orderkey AS q, lower(n_name) AS ctry FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), nq AS (SELECT ctry, count(*) AS n FROM h GROUP BY ctry),
      c AS (SELECT l.*, h.ctry, {_DIFF('a_core', 'b_core')} AS gone, {_DIFF('b_core', 'a_core')} AS new FROM links l JOIN h ON h.q = l.q),
      k AS (SELECT ctry, {_KIND} AS kind, CASE WHEN p * 2 < 0.9 THEN 'a<0.9' WHEN p * 2 < 0.99 THEN 'b<0.99' WHEN p * 2 < 0.995 THEN 'c<0.995' WHEN p * 2 < 0.9999 THEN 'd<0.9999' ELSE 'e>=0.9999' END AS band FROM c),
      r AS (SELECT kind, band, k.ctry, count(*) AS n, count(*) * 1000 / any_value(nq.n) AS rate FROM k JOIN nq ON nq.ctry = k.ctry GROUP BY ALL),
      f AS (SELECT kind, band, max(rate) AS hi, min(rate) AS lo, count(*) AS seen FROM r WHERE ctry IN ('nation_8', 'nation_18') GROUP BY ALL)
      SELECT r.kind, r.band, r.n, round(greatest(rate - coalesce(hi, 0), 0) / rate, 6) AS share_lo, round(greatest(rate - CASE WHEN coalesce(seen, 0) < 2 THEN 0 ELSE lo END, 0) / rate, 6) AS share_hi
      FROM r LEFT JOIN f ON f.kind = r.kind AND f.band = r.band WHERE r.ctry = 'nation_6'""",
    "score_bins": f"""WITH {adapters.PAIRS}, b(bin, lo, hi) AS (VALUES {', '.join(f'({i + 1}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True)))}),
      c AS (SELECT bin, lo, hi, count(*) FILTER (WHERE label = 1) AS n_true, count(*) FILTER (WHERE label = 0) AS n_false FROM b LEFT JOIN pairs ON p >= lo AND p < hi GROUP BY ALL)
      SELECT *, round(((n_true + 1) / ((SELECT sum(label) FROM pairs) + 1)) / ((n_false + 1) / ((SELECT count(*) - sum(label) FROM pairs) + 1)), 9) AS lr FROM c""",
    "posterior_cuts": f"""WITH {adapters.PAIRS}, b(bin, lo, hi) AS (VALUES {', '.join(f'({i + 1}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True)))}),
      c AS (SELECT bin, lo, hi, count(*) FILTER (WHERE label = 1) AS t, count(*) FILTER (WHERE label = 0) AS f FROM b LEFT JOIN pairs ON p >= lo AND p < hi GROUP BY ALL),
      d AS (SELECT *, ((t + 1) / ((SELECT sum(label) FROM pairs) + 1)) / ((f + 1) / ((SELECT count(*) - sum(label) FROM pairs) + 1)) AS lr FROM c),
      e AS (SELECT *, 0.5::DOUBLE * lr / (0.5::DOUBLE * lr + 0.5::DOUBLE) AS post FROM d),
      r AS (SELECT lo, hi, bool_and(post >= 0.5) OVER (ORDER BY bin DESC) AS up, bool_and(post <= 0.5) OVER (ORDER BY bin) AS down FROM e)
      SELECT coalesce(min(lo) FILTER (WHERE up), 1.0::DOUBLE) AS restore_cut, coalesce(max(hi) FILTER (WHERE down), 0.0::DOUBLE) AS drop_cut FROM r""",
    "rare_street_words": f"{_RARE} SELECT w FROM rare",
    "namesakes": f"""{_RARE}, s AS (SELECT q, core1, w FROM (SELECT q, core1, unnest(list_distinct(string_split(addr, ' '))) AS w FROM qry) WHERE w IN (SELECT w FROM rare))
      SELECT qry.q, coalesce(n, 0) AS n_ns FROM qry LEFT JOIN (SELECT a.q, count(DISTINCT b.q) AS n FROM s a JOIN s b ON a.core1 = b.core1 AND a.w = b.w AND a.q <> b.q GROUP BY a.q) t ON t.q = qry.q""",
}

from .blocking import _QUERY, kept  # noqa: E402

ORACLES["name_relation_kind"] = f"""{_QUERY}, d AS (SELECT c.q, c.pid, a.core1 AS a_core, b.core1 AS b_core, {_DIFF('a.core1', 'b.core1')} AS gone, {_DIFF('b.core1', 'a.core1')} AS new FROM cand c JOIN qry a ON a.q = c.q JOIN pool b ON b.pid = c.pid)
  SELECT q, pid, {_KIND} AS kind FROM d"""
