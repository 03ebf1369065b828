"""Made-up copies and decoys of names, and a rewriting of records into French ones, for training and tests.

Every choice of a position or a word is a hash of the row's key, so results repeat and rows need no random state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

# Results must agree on these word lists and tables.
NOISE = ["center", "centre", "services", "service"]
FR_LEGAL_RULES = [
    (r"private limited|pvt\.? ltd\.?|pvt limited|pvt\.? limited", "sasu"), (r"l\.l\.c\.?", "s.a.r.l."), (r"l l c", "s a r l"), (r"llc", "sarl"), (r"l l p", "s n c"), (r"llp", "snc"), (r"pllc", "sasu"),
    (r"incorporated|inc\.?", "sas"), (r"i n c", "s a s"), (r"corporation|corp\.?", "sa"), (r"limited|ltd\.?", "eurl"), (r"lp", "sci"), (r"pc", "ei"), (r"company", "compagnie"), (r"co\.?", "cie"),
]
FR_PHRASES = {
    "high school": "lycee", "middle school": "college", "elementary school": "ecole elementaire", "primary school": "ecole primaire", "medical center": "centre medical", "health center": "centre de sante",
    "real estate": "immobilier", "day care": "creche", "law firm": "cabinet avocats", "car wash": "lavage auto", "auto repair": "garage", "senior center": "foyer", "sports club": "club sportif",
}
FR_STREET = {
    "street": "rue", "st": "rue", "avenue": "avenue", "ave": "avenue", "av": "avenue", "road": "route", "rd": "route", "boulevard": "boulevard", "blvd": "boulevard", "drive": "allee", "dr": "allee",
    "lane": "chemin", "ln": "chemin", "court": "impasse", "ct": "impasse", "place": "place", "pl": "place", "way": "voie", "circle": "rond point", "cir": "rond point", "parkway": "cours", "pkwy": "cours",
    "highway": "route nationale", "hwy": "route nationale", "square": "square", "sq": "square", "terrace": "residence", "trail": "sentier", "marg": "rue", "nagar": "quartier",
}
FR_ADDRESS = {"north": "nord", "south": "sud", "east": "est", "west": "ouest", "unit": "appartement", "apt": "appartement", "apartment": "appartement", "suite": "bat", "ste": "bat", "floor": "etage", "usa": "france", "india": "france", "united states": "france"}
FR_FORMS = ["sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "ei", "cie", "compagnie"]
NO_CATEGORY = ["et", "de", "le", "groupe", "services", "developpement", "fils", "freres", "associes", "partenaires", "entreprises", "entreprise", "holding", "unis", "ville", "locale", "regionale"]


def _at(words: Column, *key: Column | str | int) -> Column:
    """One element of an array by a hash of the key; null of an empty one."""
    n = F.size(words)
    return F.when(n > 0, F.get(words, F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in key)), F.greatest(n, F.lit(1))).cast("int")))


def initials(core: Column) -> Column:
    """First letters of the first three words."""
    return F.array_join(F.transform(F.slice(F.split(core, " "), 1, 3), lambda w: F.substring(w, 1, 1)), "")


def _spliced(words: Column, at: Column, new: Column, taken: int = 1) -> Column:
    """words joined by blanks, with `taken` of them from index at on (from 0) replaced by new."""
    before, after = F.slice(words, F.lit(1), at), F.slice(words, at + 1 + taken, F.greatest(F.size(words), F.lit(1)))
    return F.when(at.isNotNull() & new.isNotNull(), F.array_join(F.concat(before, F.array(new), after), " "))


def _where(words: Column, test) -> Column:
    """Indices (from 0) of the words that pass."""
    return F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())


def spell(name: Column) -> Column:
    """The first short legal form letter by letter; null without one."""
    w = F.split(name, " ")
    at = F.get(_where(w, lambda x: x.isin(*T.LEGAL) & x.rlike("^[a-z]{2,4}$")), F.lit(0))
    letters = F.array_join(F.filter(F.split(F.get(w, at), ""), lambda c: c != ""), " ")
    return _spliced(w, at, letters)


def glue(name: Column, core: Column, key: Column) -> Column:
    """Two neighbouring core words joined; null if no two are neighbours."""
    w, c = F.split(name, " "), F.split(core, " ")
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i < F.size(w) - 1) & F.array_contains(c, F.get(w, i)) & F.coalesce(F.array_contains(c, F.get(w, i + 1)), F.lit(False)))
    at = _at(places, key, "glue")
    return _spliced(w, at, F.concat(F.get(w, at), F.get(w, at + 1)), 2)


def swap(name: Column, core: Column, common: list[str], key: Column) -> Column:
    """A common word of the query's core replaced by another one that the core lacks: a decoy; null if no word qualifies."""
    w, c = F.split(name, " "), F.split(core, " ")
    at = _at(_where(w, lambda x: F.array_contains(c, x) & x.isin(*common) & ~x.isin(*NOISE, *T.LEGAL)), key, "swap")
    others = F.filter(F.array(*map(F.lit, common)), lambda x: ~F.array_contains(c, x) & ~x.isin(*NOISE))
    return _spliced(w, at, _at(others, key, "new"))


def noise_swap(name: Column, core: Column, common: list[str], key: Column) -> Column:
    """A common word of the query's core replaced by a noise word: a true copy; null if no word qualifies."""
    w, c = F.split(name, " "), F.split(core, " ")
    at = _at(_where(w, lambda x: F.array_contains(c, x) & x.isin(*common)), key, "noise")
    return _spliced(w, at, _at(F.array_except(F.array(*map(F.lit, sorted(NOISE))), F.array(F.get(w, at))), key, "word"))


def synthetic_pairs(true_pairs: DataFrame, common: list[str], quotas: dict[str, int]) -> DataFrame:
    """(q, pid, kind, label, name): one made-up copy or decoy for a true pair, of the first kind still short of its quota.

    true_pairs: (q, pid, name1, core1, a_core). Pairs come in the order of their hash; a kind takes its first pairs that
    allow it, and later kinds the pairs left over.
    """
    key = F.xxhash64("q", "pid")
    made = {"swap": (swap(F.col("name1"), F.col("a_core"), common, key), 0), "noise": (noise_swap(F.col("name1"), F.col("a_core"), common, key), 1), "ini": (initials(F.col("core1")), 1), "spell": (spell(F.col("name1")), 1), "glue": (glue(F.col("name1"), F.col("core1"), key), 1)}
    left, out = true_pairs.withColumn("_h", key), []
    for kind, (name, label) in made.items():
        if not quotas.get(kind):
            continue
        d = left.withColumn("name", name)
        chosen = d.where("name IS NOT NULL AND name <> '' AND name <> name1").orderBy("_h", "q", "pid").limit(quotas[kind])
        out.append(chosen.select("q", "pid", F.lit(kind).alias("kind"), F.lit(label).alias("label"), "name"))
        left = left.join(chosen.select("q", "pid"), ["q", "pid"], "left_anti")
    return reduce(DataFrame.union, out)


def common_words(names: DataFrame, column: str = "core1", df_min: int = 100) -> DataFrame:
    """Plain words of three letters or more that df_min records hold, neither noise nor legal forms."""
    w = names.select(F.explode(F.array_distinct(F.split(column, " "))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return w.where((F.col("df") >= df_min) & F.col("w").rlike("^[a-z]{3,}$") & ~F.col("w").isin(*NOISE, *T.LEGAL))


def _replaced(text: Column, table: dict[str, str]) -> Column:
    """Whole words and phrases replaced, the longest first, each place once: placeholders keep a result from matching again."""
    keys = sorted(table, key=len, reverse=True)
    for i, k in enumerate(keys):
        text = F.regexp_replace(text, rf"\b{k}\b", f"\ue000{i}\ue001")
    for i, k in enumerate(keys):
        text = F.replace(text, F.lit(f"\ue000{i}\ue001"), F.lit(table[k]))
    return text


def french_name(raw: Column, words: dict[str, str]) -> Column:
    """A name with French legal forms, phrases and words; a category word at its end moves to the front."""
    s = F.replace(F.lower(raw), F.lit("&"), F.lit(" and "))
    for pattern, form in FR_LEGAL_RULES:
        s = F.regexp_replace(s, rf"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])", form)
    t = F.filter(F.split(_replaced(_replaced(s, FR_PHRASES), words), r"\s+"), lambda w: w != "")
    category = sorted((set(words.values()) - set(NO_CATEGORY)) | {v.split()[0] for v in FR_PHRASES.values()})
    core = F.filter(t, lambda w: ~F.regexp_replace(w, "^[.,]+|[.,]+$", "").isin(*FR_FORMS))
    last = F.get(core, F.size(core) - 1)
    at = F.size(t) - F.array_position(F.reverse(t), last).cast("int")
    moved = F.concat(F.array(last), F.slice(t, F.lit(1), at), F.slice(t, at + 2, F.greatest(F.size(t), F.lit(1))))
    return F.array_join(F.when((F.size(core) >= 2) & last.isin(*category), moved).otherwise(t), " ")


def french_address(raw: Column, places: dict[str, str] | None = None) -> Column:
    """The street type after the house number; directions, units and, by `places`, states rewritten."""
    s = F.lower(raw)
    types = "|".join(sorted(FR_STREET, key=len, reverse=True))
    shape = rf"^(\d+[a-z]?)\s+(.+?)\s+({types})\b\.?(.*)$"
    part = lambda i: F.regexp_extract(s, shape, i)
    kind = F.create_map(*(F.lit(x) for p in FR_STREET.items() for x in p))[part(3)]
    s = F.when(s.rlike(shape), F.concat(part(1), F.lit(" "), kind, F.lit(" "), part(2), part(4))).otherwise(_replaced(s, FR_STREET))
    s = _replaced(s, FR_ADDRESS)
    return _replaced(s, places) if places else s


def french_records(records: DataFrame, words: dict[str, str], places: dict[str, str] | None = None) -> DataFrame:
    return records.withColumn("business_name", french_name(F.col("business_name"), words)).withColumn("business_address", french_address(F.col("business_address"), places)).withColumn("country", F.lit("France"))


def pseudo_labels(pairs: DataFrame, sure: float = 0.9999, out: float = 0.05) -> DataFrame:
    """Labels for an unlabelled country: exact names at the same house are true, owned pairs of p below `out` are not."""
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("p"), "q"))
    d = pairs.withColumn("_rk", rank)
    label = F.when((F.col("p") >= sure) & (F.col("_rk") == 1) & (F.col("core_eq") | (F.col("house_eq") > 0)), 1).when((F.col("p") < out) | (F.col("_rk") > 1), 0)
    return d.withColumn("label", label).where("label IS NOT NULL").drop("_rk")
