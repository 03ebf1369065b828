"""Queries over list files, made-up records and names, and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters
from ..operators import augment as A, decision as D
from ..sources import synth, validate as V
from .scored_pairs import _SHORT, _X, THRESHOLD

#: A small dictionary for the rewriting of part names.
WORDS = {"red": "rouge", "blue": "bleu", "green": "vert", "bolt": "boulon", "gear": "engrenage", "anvil": "enclume"}


def _lists(spark, sf_dir):
    """Match and candidate lists with textual ids, all entities, and the pool records that any pair names."""
    p, u = adapters.pairs(spark, sf_dir), adapters.universe(spark, sf_dir)
    one = u.select("q", F.concat(F.lit("S1-"), F.col("q").cast("string")).alias("entity_id"))
    pool = p.select("pid").distinct().select("pid", F.concat(F.lit("P-"), F.col("pid").cast("string")).alias("entity_id"))
    from ..sources.tsv import lists_of_pairs

    own = D.assign_exclusive(p).where(F.col("p") >= THRESHOLD)
    return lists_of_pairs(own, one, pool, "matched"), lists_of_pairs(D.shortlist(p, 3, 0.2), one, pool, "candidates"), one.select("entity_id"), pool


def output_validation(spark, sf_dir):
    return V.validate(*_lists(spark, sf_dir))


def submission_stats(spark, sf_dir):
    m, c, ids, _ = _lists(spark, sf_dir)
    orders = adapters.table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("source1_entity_id"), F.col("o_orderstatus").alias("country"))
    return V.statistics(m, c, orders)


def list_pairs(spark, sf_dir):
    """Match lists read back into pairs."""
    from ..sources.tsv import pairs_of_lists

    m, _, ids, pool = _lists(spark, sf_dir)
    one = ids.select("entity_id", F.substring("entity_id", 4, 20).cast("bigint").alias("q"))
    return pairs_of_lists(m, "matched", one, pool)


def synthetic_records(spark, sf_dir):
    sources, _ = synth.make(spark, 500)
    return sources[1].withColumn("src", F.lit(1)).union(sources[2].withColumn("src", F.lit(2))).union(sources[3].withColumn("src", F.lit(3)))


def augmented_names(spark, sf_dir):
    """A made-up copy or decoy of each distinct part name with a legal form."""
    parts = adapters.parts(spark, sf_dir)
    common = sorted(r["w"] for r in A.common_words(parts, "core1", 10).select("w").collect())
    d = parts.groupBy("core1").agg(F.min("rid").alias("q")).select("q", F.col("q").alias("pid"), F.concat("core1", F.lit(" llc")).alias("name1"), "core1", F.col("core1").alias("a_core"))
    return A.synthetic_pairs(d, common, {"swap": 10, "noise": 10, "ini": 10, "spell": 10, "glue": 10})


def french_names(spark, sf_dir):
    d = adapters.parts(spark, sf_dir).select("core1", "addr").distinct()
    return d.select("core1", "addr", A.french_name(F.concat(F.col("core1"), F.lit(" llc")), WORDS).alias("name_fr"), A.french_address(F.concat(F.split("addr", " ")[0], F.lit(" oak street, north"))).alias("addr_fr"))


def event_windows(spark, sf_dir):
    """The batch form of the streaming monitor: events per hour and type."""
    e = adapters.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")


QUERIES = {f.__name__: f for f in (output_validation, submission_stats, list_pairs, synthetic_records, augmented_names, french_names, event_windows)}

_M = f"{_X}, {_SHORT}"
_ZERO = lambda *names: " ".join(f"UNION ALL SELECT '{n}', 0" for n in names)
_KINDS = ("entity with several rows", "entity without a row", "row of an unknown entity", "row that repeats an id", "unknown id", "entity matched with itself")
ORACLES = {
    "output_validation": f"{_M} SELECT 'matched but no candidate' AS issue, (SELECT count(*) FROM own o WHERE NOT EXISTS (SELECT 1 FROM short s WHERE s.q = o.q AND s.pid = o.pid)) AS n "
    + _ZERO(*(f"{a}: {k}" for a in ("matched", "candidates") for k in _KINDS), "record with several owners"),
    "submission_stats": f"""{_M}, m AS (SELECT q, count(*) AS m FROM own GROUP BY q), c AS (SELECT q, count(*) AS c FROM short GROUP BY q)
      SELECT o_orderstatus AS country, count(*) AS n_rows, count(m.m) AS with_match, coalesce(sum(m.m), 0)::BIGINT AS matches, coalesce(sum(c.c), 0)::BIGINT AS candidates
      FROM orders LEFT JOIN m ON m.q = o_orderkey LEFT JOIN c ON c.q = o_orderkey GROUP BY o_orderstatus""",
    "list_pairs": f"{_X} SELECT q, pid FROM own",
    "event_windows": "SELECT (epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
