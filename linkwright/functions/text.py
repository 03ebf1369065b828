"""Normalisation of names, addresses and countries as column expressions.

Only Unicode folding (entities, composition, accents) and transliteration run in Python, as Arrow UDFs that skip plain
ASCII; tokens, abbreviations, aliases, legal forms and the rest are built-in functions that Catalyst can see.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Results must agree on these word lists and tables.
NAME_ABBR = {
    "corp": "corporation", "inc": "incorporated", "ltd": "limited", "pvt": "private", "co": "company", "intl": "international", "int": "international", "svcs": "services", "svc": "services",
    "mfg": "manufacturing", "assoc": "associates", "bros": "brothers", "dept": "department", "univ": "university", "ent": "enterprises", "ind": "industries", "tech": "technologies",
    "sys": "systems", "grp": "group", "mgmt": "management",
}
LEGAL = ["corporation", "incorporated", "limited", "private", "company", "llc", "llp", "lp", "plc", "pllc", "pty", "opc", "ltda", "gmbh", "ag", "bv", "nv", "sa", "sarl", "sas", "sasu", "eurl", "sci", "snc", "scop", "ei", "eirl", "cie", "partners", "partnership"]
STOP = ["the", "and", "of", "et", "de", "la", "le", "les", "du", "des"]
ADDR_ABBR = {
    "rd": "road", "street": "st", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "hwy": "highway", "dr": "drive", "ct": "court", "pl": "place", "sq": "square", "ste": "suite",
    "fl": "floor", "bldg": "building", "nr": "near", "opp": "opposite", "apt": "apartment", "sec": "sector", "mkt": "market", "cir": "circle", "pkwy": "parkway", "bd": "boulevard", "chem": "chemin",
    "saint": "st", "sainte": "st",
}
ADDR_FILLER = ["door", "no", "number", "hno", "cdp"]
FR_ADDR_ABBR = {"r": "rue", "bd": "boulevard", "bld": "boulevard", "bvd": "boulevard", "ch": "chemin", "imp": "impasse", "rte": "route", "all": "allee", "sq": "square", "qu": "quai", "fg": "faubourg", "pas": "passage", "crs": "cours"}
FR_FILLER = ["cedex"]
COUNTRY_ALIASES = {"usa": "us", "united states": "us", "united states of america": "us", "america": "us", "in": "india", "ind": "india", "bharat": "india", "fr": "france", "fra": "france"}
LEET_FROM, LEET_TO = "0134578", "oleastb"
SPACED_LEGAL = {"s a r l": "sarl", "s a s u": "sasu", "e u r l": "eurl", "s a s": "sas", "s c i": "sci", "s n c": "snc", "e i r l": "eirl", "e i": "ei", "s a": "sa"}
ALIAS_MARKERS = r"(?i)\b(?:doing business as|d\s*/\s*b\s*/\s*a|dba|trading as|also known as|a\.k\.a\.?|aka|formerly known as|fka)\b"
DOMAIN = r"(?i)^(?:https?://)?(?:www\.)?([^\s/@]+\.[a-z]{2,})(?:/\S*)?$"
DOMAIN_ENDING = r"(?i)(?:\.(?:co|com|org|net|gov|edu|ac))?\.[a-z]{2,}$"
_SPACED = r"(?:^| )(?:s a r l|s a s u|s a s|e u r l|s c i|s n c|e i r l|e i|s a)(?: |$)"


def strip_latin_accents(text: str) -> str:
    """Accents go from Latin letters; marks of other scripts carry meaning and stay."""
    if text.isascii():
        return text
    out = []
    for c in text:
        latin = ord(c) < 0x250 or 0x1E00 <= ord(c) <= 0x1EFF
        out.append("".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)) if latin else c)
    return "".join(out)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Entities decoded, composed, Latin accents stripped, lower case."""
    return text.map(lambda t: None if t is None else (t if t.isascii() and "&" not in t else strip_latin_accents(unicodedata.normalize("NFC", html.unescape(t)))).lower())


# The Indic blocks of Unicode share one layout, so one row of letters by offset serves all of them.
_INDIC_BLOCKS = range(0x0900, 0x0D80, 0x80)
_INDIC = {0x01: "m", 0x02: "m", 0x03: "h", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au"}
_INDIC |= dict(zip(range(0x15, 0x3A), "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split(), strict=True))
_INDIC |= {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x44: "r", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "", 0x3C: "", 0x64: " ", 0x65: " "}
_INDIC |= {0x66 + d: str(d) for d in range(10)}
_ROMAN = {base + offset: letters for base in _INDIC_BLOCKS for offset, letters in _INDIC.items()}


def transliterate(text: str) -> str:
    return text if text.isascii() else strip_latin_accents(text.translate(_ROMAN))


@F.pandas_udf(StringType())
def romanised_letters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else transliterate(t).lower())


def _mapping(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def replace_words(words: Column, table: dict[str, str]) -> Column:
    known = _mapping(table)
    return F.transform(words, lambda w: F.coalesce(known[w], w))


def tokens(text: Column) -> Column:
    """Words of folded text: apostrophes vanish, an ampersand is a word, other marks part words."""
    plain = F.replace(F.regexp_replace(text, "['’‘`]", ""), F.lit("&"), F.lit(" and "))
    return F.filter(F.split(F.regexp_replace(plain, r"[\p{P}\p{S}]", " "), r"(?U)\s+"), lambda w: w != "")


def leet_fixed(words: Column) -> Column:
    """c0mpany -> company: words of four or more characters with one digit, of those that stand for letters, and three letters."""

    def fix(w: Column) -> Column:
        digits, letters = F.regexp_replace(w, r"(?U)[^\d]", ""), F.regexp_replace(w, r"[^\p{L}]", "")
        ok = (F.length(w) >= 4) & (F.length(digits) == 1) & (F.length(letters) >= 3) & digits.isin(*LEET_FROM)
        return F.when(ok, F.translate(w, LEET_FROM, LEET_TO)).otherwise(w)

    return F.transform(words, fix)


def name_tokens(text: Column) -> Column:
    return replace_words(leet_fixed(tokens(text)), NAME_ABBR)


NAME_COLUMNS = ["name1", "name2", "core1", "legal", "is_domain", "has_alias"]


def with_parsed_name(records: DataFrame, raw: str) -> DataFrame:
    """records with NAME_COLUMNS, read from a column of raw names that `folded` has folded.

    The steps are columns of their own, one projection after another, so that each is computed once for all that use it.
    """
    text = F.btrim(F.coalesce(raw, F.lit("")))
    parts = F.filter(F.transform(F.flatten(F.transform(F.split(text, r"\s*\|\s*"), lambda x: F.split(x, ALIAS_MARKERS))), lambda x: F.btrim(x)), lambda x: x != "")
    bare = lambda x: F.btrim(x, F.lit("[]() "))
    label = lambda x: F.translate(F.regexp_replace(F.regexp_extract(bare(x), DOMAIN, 1), DOMAIN_ENDING, ""), "-.", "  ")
    is_domain = lambda x: ~bare(x).contains(" ") & bare(x).rlike(DOMAIN)  # noqa: E731  most parts have a blank, and need no pattern
    d = records.withColumn("_text", text).withColumn("_parts", parts)
    d = d.withColumn("_names", F.filter("_parts", lambda x: ~is_domain(x))).withColumn("_domains", F.transform(F.filter("_parts", is_domain), label))
    first = F.coalesce(F.get("_names", F.lit(0)), F.get("_domains", F.lit(0)), F.col("_text"))
    alias = F.coalesce(F.get("_names", F.lit(1)), F.when(F.size("_names") > 0, F.get("_domains", F.lit(0))), F.lit(""))
    d = d.withColumn("_alias", alias).withColumn("_t1", name_tokens(first)).withColumn("_core", F.filter("_t1", lambda w: ~w.isin(*LEGAL, *STOP)))
    return d.withColumns({
        "name1": F.array_join("_t1", " "), "name2": F.array_join(name_tokens(F.col("_alias")), " "), "core1": F.array_join(F.when(F.size("_core") > 0, F.col("_core")).otherwise(F.col("_t1")), " "),
        "legal": F.array_join(F.array_sort(F.array_distinct(F.filter("_t1", lambda w: w.isin(*LEGAL)))), " "), "is_domain": (F.size("_names") == 0) & (F.size("_domains") > 0), "has_alias": F.col("_alias") != "",
    }).drop("_text", "_parts", "_names", "_domains", "_alias", "_t1", "_core")


def norm_country(raw: Column) -> Column:
    text = F.btrim(F.coalesce(raw, F.lit("")))
    return F.coalesce(_mapping(COUNTRY_ALIASES)[text], text)


def norm_address(raw: Column, country: Column) -> Column:
    """raw: folded; country: normalised. French rules hold for France only."""
    cut = F.transform(tokens(F.coalesce(raw, F.lit(""))), lambda w: F.when((F.length(w) > 5) & w.endswith("cdp"), F.substr(w, F.lit(1), F.length(w) - 3)).otherwise(w))
    plain = F.filter(cut, lambda w: ~w.isin(*ADDR_FILLER))
    french = replace_words(F.filter(plain, lambda w: ~w.isin(*FR_FILLER)), ADDR_ABBR | FR_ADDR_ABBR)
    return F.array_join(F.when(country == "france", french).otherwise(replace_words(plain, ADDR_ABBR)), " ")


def nonlatin_share(text: Column) -> Column:
    """The share of letters outside the Latin blocks."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    latin = F.length(F.regexp_replace(letters, r"[^\x{0000}-\x{024F}\x{1E00}-\x{1EFF}]", ""))
    n = F.length(letters)
    return F.when(n > 0, (n - latin) / n).otherwise(0.0)


def normalise(records: DataFrame) -> DataFrame:
    """Raw records (rid, entity_id, business_name, business_address, country) with all normalised columns."""
    f = records.select("*", folded("business_name").alias("_n"), folded("business_address").alias("_a"), folded("country").alias("_c"))
    f = with_parsed_name(f, "_n").withColumn("ctry", norm_country(F.col("_c")))
    f = f.withColumn("addr", norm_address(F.col("_a"), F.col("ctry"))).withColumn("nl_name", nonlatin_share(F.col("business_name"))).withColumn("nl_addr", nonlatin_share(F.col("business_address")))
    roman = lambda c: F.when(F.col(c).rlike(r"[^\x00-\x7F]"), F.array_join(tokens(romanised_letters(c)), " ")).otherwise(F.col(c))
    return f.withColumn("core_rom", roman("core1")).withColumn("addr_rom", roman("addr")).drop("_n", "_a", "_c")


def skeleton(text: Column) -> Column:
    """Consonants only, without blanks."""
    return F.regexp_replace(text, "[ aeiouy]", "")


def tag_digits(text: Column) -> Column:
    """Digit runs marked [N]..[/], of five digits or more [P]..[/]."""
    long = F.regexp_replace(text, r"(\d{5,})", r"[P]$1[/]")
    return F.regexp_replace(long, r"(?<![\d\]])(\d{1,4})(?!\d)", r"[N]$1[/]")


def strip_spaced(core: Column) -> Column:
    """Legal forms spelt with blanks go; twice, as neighbours share a blank."""
    once = F.regexp_replace(F.regexp_replace(core, _SPACED, " "), _SPACED, " ")
    return F.btrim(F.regexp_replace(once, r"\s+", " "))


def legal_set(name: Column, legal: Column) -> Column:
    """Joined legal forms and those spelt with blanks in the name."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    spelt = F.array_compact(F.array(*(F.when(padded.contains(f" {k} "), F.lit(v)) for k, v in SPACED_LEGAL.items())))
    return F.array_distinct(F.concat(F.filter(F.split(legal, " "), lambda w: w != ""), spelt))


def house(addr: Column) -> Column:
    """The first number without leading zeros; null if there is none."""
    return F.nullif(F.regexp_extract(addr, r"(?:^|\s)0*(\d+)", 1), F.lit(""))


def initials(core: Column) -> Column:
    return F.array_join(F.transform(F.split(core, " "), lambda w: F.substring(w, 1, 1)), "")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of short stand in long in order."""
    step = lambda rest, c: F.when(F.instr(rest, c) > 0, F.substr(rest, F.instr(rest, c) + 1, F.length(rest)))
    return F.aggregate(F.filter(F.split(short, ""), lambda c: c != ""), long, step).isNotNull()
