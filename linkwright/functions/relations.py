"""How two core names relate: swapped words, noise words, initials, glued names, type words, streets."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from ..functions import similarity as S, text as T

# Results must agree on these word lists.
NOISE = ["fils", "groupe", "services", "developpement"]
NOISE_ADDED = ["and", "et", "associes"]
NOISE_BROAD = ["france", "and", "et", "associes", "cie"]
NOISE_CELLS = ["fils", "groupe", "services", "developpement", "france", "associes", "cie", "group", "center", "centre", "and", "co", "company", "holdings", "international", "enterprises", "solutions", "industries", "global", "trading", "corporation", "systems"]
FR_FORMS = ["sarl", "sas", "sasu", "eurl", "sci", "snc", "ei", "eirl", "sa", "scop"]
TYPE_WORDS = ["amicale", "amis", "anciens", "atelier", "auto", "cafe", "centre", "club", "college", "comite", "compagnie", "conseil", "culture", "culturelle", "danse", "ecole", "ehpad", "elementaire", "federation", "fetes", "foyer", "gestion", "groupement", "institut", "jeunes", "loisirs", "lycee", "maison", "maternelle", "medico", "musique", "parents", "patrimoine", "pharmacie", "primaire", "residence", "sante", "section", "service", "societe", "soins", "sport", "sportif", "sportive", "union"]
ABBREVIATIONS = ["st", "saint", "ste", "sainte", "frs", "freres", "ets", "etablissement", "etablissements"]


def word_set(core: Column) -> Column:
    return F.array_distinct(F.split(core, " "))


def lost(a: str = "a_core", b: str = "b_core") -> Column:
    """Words of a that b lacks."""
    return F.array_except(word_set(F.col(a)), word_set(F.col(b)))


def gained(a: str = "a_core", b: str = "b_core") -> Column:
    return F.array_except(word_set(F.col(b)), word_set(F.col(a)))


def shared(a: str = "a_core", b: str = "b_core") -> Column:
    return F.array_intersect(word_set(F.col(a)), word_set(F.col(b)))


def all_in(words: Column, known: list[str]) -> Column:
    return F.forall(words, lambda w: w.isin(*known))


def any_in(words: Column, known: list[str]) -> Column:
    return F.exists(words, lambda w: w.isin(*known)) if known else F.lit(False)


def _first(words: Column) -> Column:
    return F.get(words, F.lit(0))


def word_frequency(names: DataFrame, column: str = "core1") -> DataFrame:
    """(w, df): how many records hold each distinct word."""
    return names.select(F.explode(word_set(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


def swap_flag(pairs: DataFrame, df: DataFrame, df_min: int = 100) -> DataFrame:
    """swap: one word differs on either side (spaced legal forms aside), both of df_min records and three letters; xa, xb are the words."""
    a, b = word_set(T.strip_spaced(F.col("a_core"))), word_set(T.strip_spaced(F.col("b_core")))
    da, db = F.array_except(a, b), F.array_except(b, a)
    one = (F.size(da) == 1) & (F.size(db) == 1)
    d = pairs.withColumn("xa", F.when(one, _first(da))).withColumn("xb", F.when(one, _first(db)))
    common = df.where(F.col("df") >= df_min).select("w")
    for side in ("xa", "xb"):
        d = d.join(common.select(F.col("w").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    swap = F.col("_xa").isNotNull() & F.col("_xb").isNotNull() & (F.length("xa") > 2) & (F.length("xb") > 2)
    return d.withColumn("swap", F.coalesce(swap, F.lit(False))).drop("_xa", "_xb")


def equal_but_spaced() -> Column:
    return T.strip_spaced(F.col("a_core")) == T.strip_spaced(F.col("b_core"))


def short_initials() -> Column:
    """The pool name is one word of three letters or fewer, and a subsequence of the query's initials."""
    b = F.col("b_core")
    return (F.length(b) <= 3) & ~b.contains(" ") & T.is_subsequence(b, T.initials(F.col("a_core")))


def noise_copy() -> Column:
    """One word swapped into a noise word, or noise words added with at most one word lost."""
    gone, new = lost(), gained()
    swapped = (F.size(gone) == 1) & (F.size(new) == 1) & _first(new).isin(*NOISE)
    added = (F.size(gone) <= 1) & (F.size(new) >= 1) & all_in(new, NOISE + NOISE_ADDED) & any_in(new, [*NOISE, "associes"])
    return swapped | added


def with_protection(pairs: DataFrame) -> DataFrame:
    """eq_norm, ini_ok, noise_swap: the shapes that soft rules spare."""
    return pairs.withColumns({"eq_norm": equal_but_spaced(), "ini_ok": short_initials(), "noise_swap": noise_copy()})


def name_relation(pairs: DataFrame) -> DataFrame:
    """kind: the relation of the names of an undecided pair. b_name is the pool record's whole name."""
    a, b = F.col("a_core"), F.col("b_core")
    gone, new = lost(), gained()
    d = pairs.withColumn("_glue", S.measure(F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit("")), "matcher")).withColumn("_word", S.measure(F.coalesce(_first(gone), F.lit("")), F.coalesce(_first(new), F.lit("")), "matcher"))
    one = (F.size(gone) == 1) & (F.size(new) == 1)
    kind = (
        F.when(F.col("b_name").rlike(r"\b(d b a|dba|formerly|f k a|fka|t a|trading as)\b"), "alias_marker")
        .when(~b.contains(" ") & (F.col("_glue") >= 0.85), "glued_fuzzy").when((F.size(gone) == 0) & (F.size(new) == 0), "reordered").when(F.size(shared()) == 0, "no_common_word")
        .when(one & (F.col("_word") >= 0.7), "one_typo").when(one, "one_swap").when(F.size(gone) == 0, "words_added").when(F.size(new) == 0, "words_dropped").otherwise("other")
    )
    return d.withColumn("kind", kind).drop("_glue", "_word")


def restore_kind() -> Column:
    """The relation of a pair that may come back: exact, spelled_legal, initials, glued, noise_swap, noise_extra, other."""
    a, b = F.col("a_core"), F.col("b_core")
    gone, new = lost(), gained()
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return (
        F.when(a == b, "exact").when(equal_but_spaced(), "spelled_legal").when(F.length(b).between(2, 3) & ~b.contains(" ") & T.initials(a).startswith(b), "initials").when(bare(a) == bare(b), "glued")
        .when((F.size(gone) == 1) & (F.size(new) == 1) & _first(new).isin(*NOISE), "noise_swap")
        .when((F.size(gone) <= 1) & (F.size(new) >= 1) & all_in(new, NOISE + NOISE_ADDED) & any_in(new, [*NOISE, "associes"]), "noise_extra").otherwise("other")
    )


def cell_kind(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """kind of fifteen, for tables of rates; needs is_domain and has_alias. vocabulary: words (w) of the queries' names."""
    a, b = F.col("a_core"), F.col("b_core")
    gone, new = lost(), gained()
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    d = pairs.withColumn("_r", S.measure(a, b, "ratio")).join(vocabulary.select(F.col("w").alias("b_core"), F.lit(True).alias("_v")), "b_core", "left")
    kind = (
        F.when(a == b, "exact").when(bare(a) == bare(b), "glued").when(F.col("is_domain"), "domain").when(F.col("has_alias"), "alias").when((F.length(b) <= 4) & ~b.contains(" ") & (b == T.initials(a)), "initials")
        .when(b.rlike("^[a-z]{6,}$") & F.col("_v").isNull(), "coined").when((F.size(new) == 0) & (F.size(gone) == 0), "reorder").when(any_in(new, TYPE_WORDS) & any_in(gone, TYPE_WORDS), "typechange")
        .when(F.size(new) == 0, "dropped_words").when((F.size(gone) == 0) & all_in(new, NOISE_CELLS), "noise_added").when(F.size(gone) == 0, "word_added")
        .when((F.size(new) == 1) & (F.size(gone) == 1) & all_in(new, NOISE_CELLS), "noise_swap").when((F.size(new) == 1) & (F.size(gone) == 1), "swap").when(F.col("_r") >= 85, "typo").otherwise("other")
    )
    return d.withColumn("kind", kind).drop("_r", "_v")


def band(p: Column) -> Column:
    return F.when(p < 0.9, "a<0.9").when(p < 0.99, "b<0.99").when(p < 0.995, "c<0.995").when(p < 0.9999, "d<0.9999").otherwise("e>=0.9999")


def zone(p: Column) -> Column:
    return F.when(p < 0.9, "1 [thr,0.9)").when(p < 0.99, "2 [0.9,0.99)").when(p < 0.9999, "3 [0.99,0.9999)").otherwise("4 >=0.9999")


def rare_words(*addresses: DataFrame, share: float = 0.003) -> DataFrame:
    """Words of three letters or more, without digits, that fewer than `share` of the records of every table hold."""
    counts = []
    for d in addresses:
        n = d.agg(F.count("*").alias("n"))
        df = word_frequency(d, "addr").crossJoin(n)  # one row of totals
        counts.append(df.select("w", (F.col("df") >= share * F.col("n")).alias("common")))
    every = reduce(DataFrame.union, counts).groupBy("w").agg(F.max("common").alias("common"))
    return every.where(~F.col("common") & ~F.col("w").rlike("[0-9]") & (F.length("w") >= 3)).select("w")


def street_words(records: DataFrame, key: str, rare: DataFrame) -> DataFrame:
    """(key, street): the rare words of each address, ascending."""
    words = records.select(key, F.explode(word_set(F.col("addr"))).alias("w")).join(rare, "w", "left_semi")
    return words.groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("street"))


def street_relation(pairs: DataFrame, floor: float = 80) -> DataFrame:
    """st: 0 same street (a shared rare word, or two alike), 1 another one, 2 unknown; from a_street and b_street."""
    @F.pandas_udf(BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([any(S.ratio(u, v) >= floor for u in p for v in q) for p, q in zip(x, y, strict=True)])

    a, b = F.coalesce("a_street", F.array()), F.coalesce("b_street", F.array())
    known = (F.size(a) > 0) & (F.size(b) > 0)
    return pairs.withColumn("_alike", alike(a.cast("array<string>"), b.cast("array<string>"))).withColumn("st", F.when(~known, 2).when(F.arrays_overlap(a, b) | F.col("_alike"), 0).otherwise(1)).drop("_alike")


def contains_word(glued: Column, word: Column) -> Column:
    return glued.contains(word)


def multi_type_swap(types: list[str] | None = None) -> Column:
    """All type words of the query's name are gone, another came, and some other word is shared."""
    types = types or TYPE_WORDS
    a, b = word_set(F.col("a_core")), word_set(F.col("b_core"))
    own = F.filter(a, lambda w: w.isin(*types))
    others = F.array_except(a, own)
    return (F.size(own) > 0) & (F.size(b) >= 2) & (F.size(F.array_intersect(own, b)) == 0) & any_in(F.array_except(b, a), types) & F.arrays_overlap(others, b)


def glued_type_swap(types: list[str] | None = None) -> Column:
    """A glued pool name holds all of the query's other words and another type word instead of the query's."""
    types = types or TYPE_WORDS
    b = F.col("b_core")
    words = F.filter(F.split("a_core", " "), lambda w: F.length(w) >= 3)
    own = F.filter(words, lambda w: w.isin(*types))
    rest = F.array_except(words, own)
    other = reduce(lambda x, y: x | y, [b.contains(t) & ~F.array_contains(own, t) for t in types if len(t) >= 4])
    return (F.size(own) > 0) & ~b.contains(" ") & (F.length(b) >= 6) & ~F.exists(own, lambda w: b.contains(w)) & other & (F.size(rest) > 0) & F.forall(rest, lambda w: b.contains(w))


def near_typo(pairs: DataFrame, floor: float = 75) -> DataFrame:
    """typo: one word differs, by spelling only (ratio of floor or more, four letters or more, not two type words)."""
    gone, new = lost(), gained()
    one = (F.size(gone) == 1) & (F.size(new) == 1)
    wa, wb = F.coalesce(_first(gone), F.lit("")), F.coalesce(_first(new), F.lit(""))
    d = pairs.withColumn("_s", S.measure(wa, wb, "ratio"))
    return d.withColumn("typo", one & (F.col("_s") >= floor) & ~(wa.isin(*TYPE_WORDS) & wb.isin(*TYPE_WORDS)) & (F.length(wa) >= 4)).drop("_s")
