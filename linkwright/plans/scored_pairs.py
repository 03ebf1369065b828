"""Queries over scored pairs, with order lines as pairs and orders as entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import consensus as C, decision as D
from ..params import PID_BASE

THRESHOLD = 0.25
GRID = [round(0.10 + 0.01 * i, 2) for i in range(86)]


def _pairs(spark, sf_dir):
    return adapters.pairs(spark, sf_dir)


def assign_exclusive(spark, sf_dir):
    return D.assign_exclusive(_pairs(spark, sf_dir))


def shortlist(spark, sf_dir):
    return D.shortlist(_pairs(spark, sf_dir), 3, 0.2)


def record_competition(spark, sf_dir):
    return C.record_competition(_pairs(spark, sf_dir))


def entity_consensus(spark, sf_dir):
    return C.entity_consensus(_pairs(spark, sf_dir))


def best_other_record(spark, sf_dir):
    return C.best_other(_pairs(spark, sf_dir))


def consensus_text(spark, sf_dir):
    return C.consensus_text(adapters.part_links(spark, sf_dir))


def refined_competition(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return C.refined_competition(p, p.where(F.pmod("pid", F.lit(2)) == 0).select("q", "pid", (F.lit(1.0) - F.col("p")).alias("xs")))


def name_mate_support(spark, sf_dir):
    links = adapters.part_links(spark, sf_dir).select("q", "pid", "src", "p", "b_core")
    return C.name_mate_support(links, links)


def digit_relations(spark, sf_dir):
    return C.digit_relations(adapters.part_links(spark, sf_dir).select("q", "pid", "p", "a_addr", "b_addr"))


def address_multiplicity(spark, sf_dir):
    return C.address_multiplicity(adapters.parts(spark, sf_dir).select("rid", "addr"))


def address_group_features(spark, sf_dir):
    n = C.address_multiplicity(adapters.parts(spark, sf_dir).select("rid", "addr"))
    links = adapters.part_links(spark, sf_dir).select("q", "pid", "a_rid", "b_rid", "a_addr", "b_addr")
    a, b = n.select(F.col("rid").alias("a_rid"), F.col("addr_n").alias("a_addr_n")), n.select(F.col("rid").alias("b_rid"), F.col("addr_n").alias("b_addr_n"))
    d = C.address_group_features(links.join(a, "a_rid").join(b, "b_rid"))
    return d.select("q", "pid", "a_addr_n", "b_addr_n", "addr_same_exact", *(F.round(c, 9).alias(c) for c in ("s1_addr_n", "pool_addr_n", "addr_n_prod")))


def _owned(spark, sf_dir):
    return D.assign_exclusive(_pairs(spark, sf_dir)).where(F.col("p") >= THRESHOLD)


def entity_f05(spark, sf_dir):
    return D.entity_f(_owned(spark, sf_dir), adapters.universe(spark, sf_dir)).select("q", "n_true", "n_pred", "tp", F.round("f", 9).alias("f"))


def macro_f05(spark, sf_dir):
    return D.macro_f(_owned(spark, sf_dir), adapters.universe(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    return D.threshold_sweep(_pairs(spark, sf_dir), adapters.universe(spark, sf_dir), GRID)


def best_threshold(spark, sf_dir):
    return D.best_threshold(threshold_sweep(spark, sf_dir))


def capacity_cap(spark, sf_dir):
    return D.capacity_cap(_pairs(spark, sf_dir), THRESHOLD, {2: 1, 3: 2})


def country_thresholds(spark, sf_dir):
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("c_custkey"))
    customers = adapters.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = adapters.table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("ctry"))
    home = orders.join(customers, "c_custkey").join(nations, "n_nationkey").select("q", "ctry")
    return D.country_thresholds(_pairs(spark, sf_dir).join(home, "q"), {"nation_8": 0.4, "nation_6": 0.1}, THRESHOLD)


def match_lists(spark, sf_dir):
    return D.lists(_owned(spark, sf_dir), adapters.universe(spark, sf_dir), "matched")


def candidate_lists(spark, sf_dir):
    return D.lists(D.shortlist(_pairs(spark, sf_dir), 3, 0.2), adapters.universe(spark, sf_dir), "candidates")


def fold_hash(spark, sf_dir):
    return adapters.universe(spark, sf_dir).select("q", D.fold_hash(F.col("q")).alias("fold"))


def calibration_bins(spark, sf_dir):
    return D.calibration_bins(_pairs(spark, sf_dir))


def expected_calibration_error(spark, sf_dir):
    return D.ece(_pairs(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


def _second(spark, sf_dir):
    """Another model's scores of the same pairs."""
    return _pairs(spark, sf_dir).withColumn("p", F.lit(0.75) - F.col("p"))


def logit_blend(spark, sf_dir):
    return D.blend([_pairs(spark, sf_dir), _second(spark, sf_dir)]).select("q", "pid", F.round("p", 9).alias("p"), "n")


def score_average(spark, sf_dir):
    return D.average_two(_pairs(spark, sf_dir), _second(spark, sf_dir)).select("q", "pid", F.round("xs", 9).alias("xs"), F.round("xs_gap", 9).alias("xs_gap"))


def partial_rescoring(spark, sf_dir):
    return D.upsert(_pairs(spark, sf_dir), _second(spark, sf_dir).where("src = 3"))


def cross_encoder_band(spark, sf_dir):
    return D.scorer_band(_pairs(spark, sf_dir), 0.2, 0.5)


def paired_model_comparison(spark, sf_dir):
    return D.paired_comparison(_pairs(spark, sf_dir), _second(spark, sf_dir), adapters.universe(spark, sf_dir), THRESHOLD)


def bootstrap_interval(spark, sf_dir):
    d = D.bootstrap(D.entity_f(_owned(spark, sf_dir), adapters.universe(spark, sf_dir)), "f")
    return d.select(*(F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")))


_P = f"WITH {adapters.PAIRS}"
_L = f"{_P}, {adapters.PARTS}, {adapters.LINKS}"
_X = f"{_P}, excl AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1), own AS (SELECT * FROM excl WHERE p >= {THRESHOLD})"
_SHORT = "short AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, pid) AS rk FROM pairs) WHERE rk = 1 OR (rk <= 3 AND p >= 0.2))"


def _f(tp: str, n_pred: str, n_true: str) -> str:
    return f"CASE WHEN {n_pred} = 0 AND {n_true} = 0 THEN 1.0 WHEN {n_pred} = 0 OR {n_true} = 0 OR {tp} = 0 THEN 0.0 ELSE (1.25::DOUBLE * ({tp} / {n_pred}) * ({tp} / {n_true})) / (0.25::DOUBLE * ({tp} / {n_pred}) + ({tp} / {n_true})) END"


def _entity(table: str) -> str:
    return f"SELECT u.q, u.n_true, coalesce(g.n_pred, 0) AS n_pred, coalesce(g.tp, 0) AS tp FROM universe u LEFT JOIN (SELECT q, count(*) AS n_pred, sum(label)::BIGINT AS tp FROM {table} GROUP BY q) g ON g.q = u.q"


_ENT = f"{_X}, e AS (SELECT *, {_f('tp', 'n_pred', 'n_true')} AS f FROM ({_entity('own')}))"
_RECORD = """rc AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) AS rank_p1_pid FROM {t}),
rd AS (SELECT *, sum(p) OVER w AS sum_p_pid, count(*) FILTER (WHERE p > 0.3) OVER w AS n_claim03, count(*) FILTER (WHERE p > 0.5) OVER w AS n_claim05,
  max(p) FILTER (WHERE rank_p1_pid = 1) OVER w AS t0, max(p) FILTER (WHERE rank_p1_pid = 2) OVER w AS t1 FROM rc WINDOW w AS (PARTITION BY pid)),
re AS (SELECT * EXCLUDE (t0, t1), CASE WHEN p >= t0 THEN coalesce(t1, 0) ELSE t0 END AS max_other_pid FROM rd),
record AS (SELECT *, p - max_other_pid AS margin_pid FROM re)"""
_ENTITY = """ea AS (SELECT * REPLACE (pid // 10000000 AS src), CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS hi FROM {t}),
eb AS (SELECT *, sum(p) OVER w AS sum_p_q, sum(hi) OVER w AS n_hi_q, sum(CASE WHEN src = 2 THEN hi ELSE 0 END) OVER w AS n_hi_s2, sum(CASE WHEN src = 3 THEN hi ELSE 0 END) OVER w AS n_hi_s3,
  row_number() OVER (PARTITION BY q ORDER BY p DESC, pid) AS rank_p1_q, row_number() OVER (PARTITION BY q, src ORDER BY p DESC, pid) AS rank_p1_q_src, max(p) OVER w AS top_p_q, sum(p * hi) OVER w AS sum_hi
  FROM ea WINDOW w AS (PARTITION BY q)),
ec AS (SELECT *, top_p_q - p AS gap_top_q, sum_hi - p * hi AS sum_hi_excl, n_hi_q - hi AS n_hi_excl, sum_p_q - p AS sum_p_excl, CASE WHEN src = 2 THEN n_hi_s2 ELSE n_hi_s3 END - hi AS n_hi_same_src_excl FROM eb),
entity AS (SELECT * EXCLUDE (hi, sum_hi), sum_hi_excl / greatest(n_hi_excl, 1) AS mean_hi_excl FROM ec)"""
_XCOLS = "src sum_p_q n_hi_q n_hi_s2 n_hi_s3 rank_p1_q rank_p1_q_src top_p_q gap_top_q sum_hi_excl n_hi_excl sum_p_excl n_hi_same_src_excl mean_hi_excl p rank_p1_pid sum_p_pid n_claim03 n_claim05 max_other_pid margin_pid".split()

QUERIES = {f.__name__: f for f in (
    assign_exclusive, shortlist, record_competition, entity_consensus, best_other_record, consensus_text, refined_competition, name_mate_support, digit_relations, address_multiplicity, address_group_features,
    entity_f05, macro_f05, threshold_sweep, best_threshold, capacity_cap, country_thresholds, match_lists, candidate_lists, fold_hash, calibration_bins, expected_calibration_error, logit_blend,
    score_average, partial_rescoring, cross_encoder_band, paired_model_comparison, bootstrap_interval,
)}

_CLAMP = "greatest(1e-7::DOUBLE, least({p}, 1 - 1e-7::DOUBLE))"
_LOGIT = lambda p: f"ln({_CLAMP.format(p=p)} / (1 - {_CLAMP.format(p=p)}))"
_SWEEP = f"""{_X}, grid AS (SELECT (10 + i) / 100::DOUBLE AS threshold FROM range(86) t(i)),
  sweep AS (SELECT threshold, sum(CAST(round(f * 1000000000) AS BIGINT))::BIGINT / count(*) / 1000000000::DOUBLE AS macro_f FROM (
    SELECT threshold, {_f('tp', 'n_pred', 'n_true')} AS f FROM (
      SELECT g.threshold, u.q, u.n_true, count(x.pid) AS n_pred, coalesce(sum(x.label), 0)::BIGINT AS tp FROM grid g CROSS JOIN universe u LEFT JOIN excl x ON x.q = u.q AND x.p >= g.threshold GROUP BY ALL)) GROUP BY threshold)"""
ORACLES = {
    "assign_exclusive": f"{_X} SELECT * FROM excl",
    "shortlist": f"{_P}, {_SHORT} SELECT * FROM short",
    "record_competition": f"{_P}, {_RECORD.format(t='pairs')} SELECT * FROM record",
    "entity_consensus": f"{_P}, {_ENTITY.format(t='pairs')} SELECT * FROM entity",
    "best_other_record": f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, pid) AS r FROM pairs),
      t AS (SELECT *, CASE WHEN r = 1 THEN max(pid) FILTER (WHERE r = 2) OVER w ELSE max(pid) FILTER (WHERE r = 1) OVER w END AS v, CASE WHEN r = 1 THEN max(p) FILTER (WHERE r = 2) OVER w ELSE max(p) FILTER (WHERE r = 1) OVER w END AS b FROM r WINDOW w AS (PARTITION BY q))
      SELECT q, pid, src, p, label, CASE WHEN b > 0.3 THEN v END AS bo_pid, CASE WHEN b > 0.3 THEN b END AS bo_p FROM t""",
    "refined_competition": f"""{_P}, xp AS (SELECT q, pid, CASE WHEN pid % 2 = 0 THEN 1 - p ELSE p END AS p, 0 AS src FROM pairs), {_ENTITY.format(t='xp')}, {_RECORD.format(t='entity')}
      SELECT q, pid, {', '.join(f'{c} AS {c}_x' for c in _XCOLS)} FROM record""",
    "name_mate_support": f"""{_L}, c AS (SELECT * FROM links WHERE p >= 0.2), g AS (SELECT q, b_core, src, count(*) AS n_src FROM c GROUP BY ALL), t AS (SELECT q, b_core, count(*) AS n_all FROM c GROUP BY ALL)
      SELECT l.q, l.pid, l.src, l.p, l.b_core, CASE WHEN n_src IS NULL THEN 0 ELSE greatest(n_src - 1, 0) END AS sup_same, CASE WHEN n_src IS NULL OR n_all IS NULL THEN 0 ELSE greatest(n_all - n_src, 0) END AS sup_cross
      FROM links l LEFT JOIN g ON g.q = l.q AND g.b_core = l.b_core AND g.src = l.src LEFT JOIN t ON t.q = l.q AND t.b_core = l.b_core""",
    "digit_relations": f"""{_L}, d AS (SELECT q, pid, p, a_addr, b_addr, nullif(regexp_extract(a_addr, '[0-9]+'), '') AS ha, nullif(regexp_extract(b_addr, '[0-9]+'), '') AS hb, regexp_replace(a_addr, '[^0-9]', '', 'g') AS da, regexp_replace(b_addr, '[^0-9]', '', 'g') AS db,
        row_number() OVER (PARTITION BY q ORDER BY p DESC, pid) AS r FROM links),
      e AS (SELECT *, ha IS NOT NULL AND hb IS NOT NULL AS bt, CASE WHEN r = 1 THEN max(hb) FILTER (WHERE r = 2) OVER w ELSE max(hb) FILTER (WHERE r = 1) OVER w END AS o, CASE WHEN hb IS NOT NULL AND p > 0.5 THEN 1 ELSE 0 END AS c FROM d WINDOW w AS (PARTITION BY q)),
      f AS (SELECT *, sum(c) OVER (PARTITION BY q, hb) AS sm, sum(c) OVER (PARTITION BY q) AS cf FROM e),
      g AS (SELECT *, CASE WHEN hb IS NOT NULL THEN sm - CASE WHEN p > 0.5 THEN 1 ELSE 0 END ELSE 0 END AS same FROM f)
      SELECT q, pid, p, a_addr, b_addr, (ha IS NOT NULL)::INT AS has_h_a, (hb IS NOT NULL)::INT AS has_h_b, coalesce(bt AND ha = hb, false)::INT AS h_eq,
        coalesce(bt AND starts_with(hb, ha) AND length(hb) > length(ha), false)::INT AS h_a_prefix_of_b, coalesce(bt AND starts_with(ha, hb) AND length(ha) > length(hb), false)::INT AS h_b_prefix_of_a, length(hb) - length(ha) AS h_len_diff,
        coalesce(bt AND da <> '' AND starts_with(db, da) AND length(db) > length(da), false)::INT AS d_a_prefix_of_b, coalesce(bt AND db <> '' AND starts_with(da, db) AND length(da) > length(db), false)::INT AS d_b_prefix_of_a, coalesce(bt AND da = db, false)::INT AS d_eq,
        ln(abs(hb::DOUBLE - ha::DOUBLE) + 1) AS h_logdiff, coalesce(bt AND contains(b_addr, ha), false)::INT AS h_a_in_addr_b,
        coalesce(hb = o, false)::INT AS h_eq_best_other, coalesce(hb <> o AND (starts_with(o, hb) OR starts_with(hb, o)), false)::INT AS h_prefix_best_other,
        same AS n_conf_same_house, CASE WHEN hb IS NOT NULL THEN greatest(cf - c - same, 0) ELSE 0 END AS n_conf_diff_house FROM g""",
    "address_multiplicity": f"WITH {adapters.PARTS} SELECT rid, addr, CASE WHEN addr = '' THEN 0 ELSE count(*) OVER (PARTITION BY addr) END AS addr_n FROM parts",
    "address_group_features": f"""{_L}, n AS (SELECT rid, CASE WHEN addr = '' THEN 0 ELSE count(*) OVER (PARTITION BY addr) END AS n FROM parts)
      SELECT l.q, l.pid, a.n AS a_addr_n, b.n AS b_addr_n, (a_addr = b_addr AND a.n > 0)::INT AS addr_same_exact, round(ln(1 + a.n::DOUBLE), 9) AS s1_addr_n, round(ln(1 + b.n::DOUBLE), 9) AS pool_addr_n, round(ln(1 + a.n::DOUBLE) + ln(1 + b.n::DOUBLE), 9) AS addr_n_prod
      FROM links l JOIN n a ON a.rid = l.a_rid JOIN n b ON b.rid = l.b_rid""",
    "entity_f05": f"{_ENT} SELECT q, n_true, n_pred, tp, round(f, 9) AS f FROM e",
    "macro_f05": f"{_ENT} SELECT count(*) AS entities, sum(CAST(round(f * 1000000000) AS BIGINT))::BIGINT / count(*) / 1000000000::DOUBLE AS macro_f FROM e",
    "bootstrap_interval": f"""{_ENT}, v AS (SELECT q % {D.FIELD} AS q, CAST(round(f * 1000000000) AS BIGINT) AS v FROM e),
      x AS (SELECT r, r * 48271 % {D.FIELD} AS x FROM range(1, 1001) t(r)), a AS (SELECT *, (x * x + 69621) % {D.FIELD} AS a FROM x), b AS (SELECT *, (a * a + x) % {D.FIELD} AS b FROM a),
      h AS (SELECT r, v, a, b, (q * a + b) % {D.FIELD} AS h FROM v CROSS JOIN b), u AS (SELECT r, v, (((h * h + a) % {D.FIELD}) * b + h) % {D.FIELD} AS u FROM h),
      w AS (SELECT r, v, {' + '.join(f'(u >= {c})::BIGINT' for c in D.CUTS)} AS w FROM u), m AS (SELECT r, sum(w * v)::DOUBLE / sum(w)::DOUBLE / 1000000000::DOUBLE AS m FROM w GROUP BY r)
      SELECT round((SELECT sum(v)::DOUBLE / count(*) / 1000000000::DOUBLE FROM v), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM m""",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM sweep",
    "best_threshold": f"{_SWEEP} SELECT * FROM sweep ORDER BY macro_f DESC, threshold LIMIT 1",
    "capacity_cap": f"{_X} SELECT q, pid, src, p, label FROM own QUALIFY row_number() OVER (PARTITION BY q, src ORDER BY p DESC, pid) <= CASE src WHEN 2 THEN 1 ELSE 2 END",
    "country_thresholds": f"""{_P}, h AS (SELECT o_orderkey AS q, lower(n_name) AS ctry FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
      t AS (SELECT p.*, h.ctry, CASE h.ctry WHEN 'nation_8' THEN 0.4::DOUBLE WHEN 'nation_6' THEN 0.1::DOUBLE ELSE {THRESHOLD}::DOUBLE END AS own FROM pairs p JOIN h ON h.q = p.q)
      SELECT q, pid, src, label, ctry, CASE WHEN p >= own THEN greatest(p, {THRESHOLD}::DOUBLE) ELSE least(p, {THRESHOLD}::DOUBLE - 1e-6::DOUBLE) END AS p FROM t""",
    "match_lists": f"{_X} SELECT u.q, coalesce(string_agg(o.pid, ',' ORDER BY o.pid), '') AS matched FROM universe u LEFT JOIN own o ON o.q = u.q GROUP BY u.q",
    "candidate_lists": f"{_P}, {_SHORT} SELECT u.q, coalesce(string_agg(o.pid, ',' ORDER BY o.pid), '') AS candidates FROM universe u LEFT JOIN short o ON o.q = u.q GROUP BY u.q",
    "fold_hash": f"{_P} SELECT q, q * 2654435761 % 4294967296 % 5 AS fold FROM universe",
    "calibration_bins": f"{_P} SELECT least(floor(p * 20), 19)::BIGINT AS bin, count(*) AS n, sum(label)::BIGINT AS true_pairs, sum(p) AS sum_p FROM pairs GROUP BY 1",
    "expected_calibration_error": f"""{_P}, b AS (SELECT least(floor(p * 20), 19) AS bin, count(*) AS n, sum(label) AS t, sum(p) AS s FROM pairs GROUP BY 1)
      SELECT round(sum(CAST(round(abs(s / n - t / n) * n * 1000000) AS BIGINT))::BIGINT / sum(n) / 1000000::DOUBLE, 9) AS ece FROM b""",
    "logit_blend": f"{_P} SELECT q, pid, round(1 / (1 + exp(-({_LOGIT('p')} + {_LOGIT('(0.75::DOUBLE - p)')}) / 2)), 9) AS p, 2 AS n FROM pairs",
    "score_average": f"{_P} SELECT q, pid, round(1 / (1 + exp(-({_LOGIT('p')} + {_LOGIT('(0.75::DOUBLE - p)')}) / 2)), 9) AS xs, round(abs({_LOGIT('p')} - {_LOGIT('(0.75::DOUBLE - p)')}), 9) AS xs_gap FROM pairs",
    "partial_rescoring": f"{_P} SELECT q, pid, src, label, CASE WHEN src = 3 THEN 0.75::DOUBLE - p ELSE p END AS p FROM pairs",
    "cross_encoder_band": f"{_P}, t AS (SELECT *, CASE WHEN p BETWEEN 0.2 AND 0.5 THEN 'band' WHEN label = 0 AND p > 0.9 THEN 'mistake' WHEN label = 1 AND p > 0.5 AND (q * 31 + pid) % 10 = 0 THEN 'easy' END AS why FROM pairs) SELECT * FROM t WHERE why IS NOT NULL",
    "paired_model_comparison": f"""{_X}, snd AS (SELECT * REPLACE (0.75::DOUBLE - p AS p) FROM pairs), own2 AS (SELECT * FROM (SELECT * FROM snd QUALIFY row_number() OVER (PARTITION BY pid ORDER BY p DESC, q) = 1) WHERE p >= {THRESHOLD}),
      a AS (SELECT q, CAST(round({_f('tp', 'n_pred', 'n_true')} * 1000000000) AS BIGINT) AS f FROM ({_entity('own')})), b AS (SELECT q, CAST(round({_f('tp', 'n_pred', 'n_true')} * 1000000000) AS BIGINT) AS f FROM ({_entity('own2')}))
      SELECT count(*) AS entities, count(*) FILTER (WHERE b.f > a.f) AS b_better, count(*) FILTER (WHERE b.f < a.f) AS a_better, sum(b.f - a.f)::BIGINT / count(*) / 1000000000::DOUBLE AS delta FROM a JOIN b ON a.q = b.q""",
}
