"""Personal data -> surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, telephone, card and identity numbers, IBANs, IP and MAC addresses, access keys and
names after a title. A mention is cut into canonical parts (the address in lower case, the national digits of a
telephone number, each word of a name, ...); the distinct parts of the corpus get surrogates, and every mention is
written with those of its parts in its own format. So all spellings of an entity get one surrogate, in all documents:

- numbers keep their separators, their length, a country code and a trunk zero; the other digits go through a keyed
  Feistel permutation, and card numbers keep their Luhn remainder;
- IPv4 addresses go through such a permutation of all addresses; IPv6 addresses become whole addresses;
- keys, hashes, IBANs and MAC addresses keep their alphabet, case, length and separators; IBANs keep their country, their
  check digits and, where they end in two digits, their remainder modulo 97;
- e-mail addresses become letters at a reserved domain;
- names run over all capitalised words, initials and particles after a title; they keep their title, particles, number
  of words, script and capitals, and initials stay initials. Each word is replaced by itself, with an ending by the
  gender of the titles under which it is a given name (a neutral one if there are both);
- in a document with names or telephone numbers, their words and national digits are replaced wherever they stand alone.

Collision check: a surrogate may equal no other surrogate and no entity of the corpus. Parts whose surrogate fails that
take the next one of their key's sequence, in rounds over tables until none is left; a round leaves the square of the
occupied share, and the spaces of names grow with the rounds. Where the corpus itself occupies over an eighth of all
numbers of a length, avoiding it is no longer sensible: there the permutation alone keeps surrogates apart.

Defined results: a null text stays null, an empty one empty; a null doc_id is kept; repeated rows get equal results;
an empty table gives an empty table; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .common import fresh, materialise, partitions, table, write

KEY = "linkwright-surrogates-1"
#: Rounds of the digit permutation; even, so that its halves end in their places.
ROUNDS = 6
#: The share of all numbers of a length from which the corpus crowds them.
CROWDED = 1 / 8

_TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Lord", "Don", "господин", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Lady", "Doña", "госпожа", "Госпожа"],
    "n": ["Dr", "Prof"],
}
_TITLE = "|".join(t for titles in _TITLES.values() for t in sorted(titles, key=len, reverse=True))
#: Words in lower case within a name, and a capitalised word or initials, but no title of another name.
_PARTICLE = r"(?:de|del|della|delle|dei|di|da|das|do|dos|du|des|la|las|le|los|van|von|vom|der|den|dem|zu|zum|zur|ter|ten|te|af|av|al|el|bin|bint|ibn|ben|y|e)"
_WORD = rf"(?!(?:{_TITLE})[. ])" r"(?:\p{Lu}\.(?:-?\p{Lu}\.)*+|(?:(?:al|el|ad|ar|as|at)-|[dl]['’])?+\p{Lu}[\p{L}\p{M}'’-]*+)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
#: IPv6 with a dotted end, or with zeros left out; not the bare "::".
_SHORT_IP6 = "|".join([
    rf"(?:(?:{_H}:){{6}}|(?:{_H}:){{1,5}}:(?:{_H}:){{0,4}}|::(?:{_H}:){{0,5}})(?:{_OCTET}\.){{3}}{_OCTET}",
    rf"(?:{_H}:){{1,7}}:", *(rf"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)), rf":(?::{_H}){{1,7}}",
])
#: type -> pattern; the first that fits wins. Possessive where a run cannot end elsewhere.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}0-9][\p{L}\p{M}0-9._%+-]{0,63}@(?:[\p{L}\p{M}0-9-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}0-9])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "mac": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:{_SHORT_IP6}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}})(?![0-9A-Za-z:]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9A-Za-z+.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? (?:{_PARTICLE} ){{0,3}}{_WORD}(?: (?:(?:{_PARTICLE} ){{1,3}}(?={_WORD}))?+{_WORD})*+",
}
ENTITY = "|".join(PATTERNS.values())
#: What every entity has: a digit or @, the beginning of a key, a colon between letters of a MAC or IPv6 address, or a title.
HINT = rf"[0-9@]|(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ)|[A-Fa-f:]:[A-Fa-f]|[A-Fa-f]::|(?<![\p{{L}}])(?:{_TITLE})[. ]"


#: Stand around what is found; the first sign alone is written as the two others in a text that has it.
_AROUND, _SIGN, _ESCAPED = "\x01\x02", "\x01", "\x01\x03"


def _digest(*parts: Column | str) -> Column:
    """64 keyed hex digits."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p for p in parts)), 256)


def _number(hexes: Column, digits: int = 15) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("bigint")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the strings of as many digits, two or more: a Feistel network over their two halves."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), h).alias("l"), F.substr(digits, h + 1, n - h).alias("r"))

    def step(s: Column, i: Column) -> Column:
        # the left half moves by a function of the right one, then they change places
        size = F.length(s.l)
        moved = F.pmod(s.l.cast("bigint") + _number(_digest(key, "feistel", i.cast("string"), tweak, n.cast("string"), s.r)), _power(size))
        return F.struct(s.r.alias("l"), F.lpad(moved.cast("string"), size, "0").alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: F.concat(s.l, s.r))


def _moved_number(digits: Column, tweak: Column, key: str) -> Column:
    """A permutation of the numbers of as many digits that do not begin with 0."""
    first, rest = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(digits))
    made = permuted_digits(rest, F.concat(tweak, first), key)
    shift = F.pmod(first.cast("bigint") - 1 + _number(_digest(key, "first", tweak, made)), F.lit(9)) + 1
    return F.when(first == "0", permuted_digits(digits, tweak, key)).otherwise(F.concat(shift.cast("string"), made))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number without its last digit, modulo 10."""
    signs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") < 5, c.cast("int") * 2).otherwise(c.cast("int") * 2 - 9))
    return F.pmod(F.aggregate(signs, F.lit(0), lambda a, c: a + c), F.lit(10))


def _card_surrogate(digits: Column, attempt: Column, key: str) -> Column:
    body, last = F.substr(digits, F.lit(1), F.length(digits) - 1), F.substr(digits, F.length(digits), F.lit(1)).cast("int")
    made = _moved_number(body, F.concat(F.lit("card"), attempt), key)
    return F.concat(made, F.pmod(last + _luhn(body) - _luhn(made), F.lit(10)).cast("string"))


def _ip_surrogate(m: Column, attempt: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("bigint"))

    def step(s: Column, i: Column) -> Column:
        return F.struct(s.low.alias("high"), F.pmod(s.high + _number(_digest(key, "ip", i.cast("string"), attempt, s.low.cast("string"))), F.lit(65536)).alias("low"))

    def dotted(s: Column) -> Column:
        return F.concat_ws(".", *(p.cast("string") for half in (s.high, s.low) for p in (F.floor(half / 256), F.pmod(half, F.lit(256)))))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct((octets[0] * 256 + octets[1]).alias("high"), (octets[2] * 256 + octets[3]).alias("low")), step, dotted)


def _alike(m: Column, kind: str, attempt: Column, key: str, keep: int = 0) -> Column:
    """Characters of the same class in the place of each letter and digit after the first keep ones."""
    stream = F.concat(*(_digest(key, kind, attempt, str(i), m) for i in range(4)))

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(stream, F.pmod(i * 3, F.lit(254)) + 1, F.lit(3)), 16, 10).cast("int")
        upper = F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(v, F.lit(26)) + 1, F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[A-Z]"), upper).when(c.rlike("[a-z]"), F.lower(upper)).when(c.rlike("[0-9]"), F.pmod(v, F.lit(10)).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _remainder(account: Column) -> Column:
    """An account number modulo 97, its letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(account, ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def _iban_surrogate(m: Column, attempt: Column, key: str) -> Column:
    made = _alike(m, "iban", attempt, key, 4)
    account, head = F.substr(m, F.lit(5), F.length(m)), F.substr(made, F.lit(5), F.length(m) - 6)
    last = F.pmod(_remainder(account) - _remainder(head) * 100, F.lit(97))
    return F.when(m.rlike("[0-9]{2}$"), F.concat(F.substr(m, F.lit(1), F.lit(4)), head, F.lpad(last.cast("string"), 2, "0"))).otherwise(made)


def _email_surrogate(m: Column, attempt: Column, key: str) -> Column:
    h = _digest(key, "email", attempt, m)
    letters = lambda at, n: F.translate(F.substring(h, at, n), "0123456789abcdef", "bdfghjklmnaeiour")
    return F.concat(letters(1, 12), F.lit("."), F.lpad(F.pmod(_number(F.substring(h, 30, 8), 8), F.lit(100)).cast("string"), 2, "0"), F.lit("@"), letters(13, 8), F.lit(".example.org"))


_LATIN = "bdfgklmnprstvzaeiou"


def _word_surrogate(word: Column, gender: Column, attempt: Column, key: str) -> Column:
    """A word in the script of word, of four syllables and one more with each attempt, and an ending by gender."""
    h = _digest(key, "name", word)

    def syllable(i: Column) -> Column:
        v = _number(_digest(h, attempt, i.cast("string")), 8)
        return F.concat(F.substr(F.lit("bdfgklmnprstvz"), F.pmod(v, F.lit(14)) + 1, F.lit(1)), F.substr(F.lit("aeiou"), F.pmod(F.floor(v / 14), F.lit(5)).cast("int") + 1, F.lit(1)))

    ending = F.when(gender == "f", F.lit("na")).when(gender == "m", F.lit("ro")).otherwise(F.lit("n"))
    latin = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + attempt.cast("int")), syllable), ""), ending)
    cyrillic, greek = F.translate(latin, _LATIN, "бдфгклмнпрствзаеиоу"), F.translate(latin, _LATIN, "βδφγκλμνπρστωζαειοή")
    return F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).when(word.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


_ALPHABETS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŁŚŠŽĐ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_LETTERS = "".join(_ALPHABETS)


def _permuted_letters(key: str) -> str:
    """_LETTERS with the letters of each alphabet moved on by keyed cycles, so that none stays."""
    out = {}
    for letters in _ALPHABETS:
        order = sorted(letters, key=lambda c: hashlib.sha256(f"{key}\x1finitial\x1f{c}".encode()).digest())
        out.update(zip(order, order[1:] + order[:1], strict=True))
    return "".join(out[c] for c in _LETTERS)


def _full_ip6(m: Column) -> Column:
    """An IPv6 address as eight groups of four lower-case digits."""
    v4 = F.split(F.regexp_extract(m, r"[0-9]+(?:\.[0-9]+){3}$", 0), r"\.")
    pair = lambda i: F.lower(F.hex(F.get(v4, F.lit(i)).cast("bigint") * 256 + F.get(v4, F.lit(i + 1)).cast("bigint")))
    hexes = F.when(m.contains("."), F.concat(F.regexp_replace(m, r"[0-9]+(?:\.[0-9]+){3}$", ""), pair(0), F.lit(":"), pair(2))).otherwise(m)
    sides = F.split(hexes, "::", 2)
    groups = lambda at: F.filter(F.split(F.coalesce(F.get(sides, F.lit(at)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(groups(0)) - F.size(groups(1)))
    return F.array_join(F.transform(F.concat(groups(0), zeros, groups(1)), lambda g: F.lpad(F.lower(g), 4, "0")), ":")


def kind_of(m: Column) -> Column:
    """The type of a mention that ENTITY has found, told by its characters."""
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(rf"^(?:{_TITLE})\.? "), F.lit("name"))
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), F.lit("ip"))
        .when(m.rlike("^[0-9a-f]{32,}$") & m.rlike("[a-f]"), F.lit("hex"))
        .when(m.rlike("^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.lit("mac"))
        .when(m.contains(":"), F.lit("ip6"))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), F.lit("iban"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), F.lit("phone"))
        .when(m.rlike("^[0-9 -]+$"), F.lit("card"))
        .otherwise(F.lit("key"))
    )


#: The telephone country codes of one and two digits; all others have three.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _national(m: Column) -> Column:
    """The digits of a telephone number without its country code and trunk zeros, if five or more are left."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    own = F.when(m.startswith("+"), F.regexp_replace(digits, _COUNTRY, "")).otherwise(digits)
    bare = F.regexp_replace(own, "^0+", "")
    return F.when(F.length(bare) >= 5, bare).otherwise(own)


def _name_words(m: Column) -> Column:
    """(w, plain): the words of a name after its title, and whether each has a surrogate of its own.

    Particles stay, and initials stay initials beside a full word; alone they are replaced like a word.
    """
    words = F.split(F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", ""), " ")
    initials = lambda w: w.rlike(r"^(?:-?\p{Lu}\.)+$")
    full = F.exists(words, lambda w: w.rlike(r"\p{Lu}") & ~initials(w))
    return F.transform(words, lambda w: F.struct(w.alias("w"), (~w.rlike(rf"^{_PARTICLE}$") & ~(full & initials(w))).alias("plain")))


def parts_of(m: Column, kind: Column) -> Column:
    """The distinct canonical parts of a mention: (part, gender); a part is its type, a colon and its value."""
    title = F.regexp_replace(F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0), r"\.? $", "")
    gender = F.when(title.isin(_TITLES["m"]), F.lit("m")).when(title.isin(_TITLES["f"]), F.lit("f"))
    words = _name_words(m)
    # the first of several words is a given name
    name = F.transform(F.filter(words, lambda x: x.plain), lambda x: F.struct(F.concat(F.lit("name:"), F.lower(x.w)).alias("part"), F.when((F.size(words) > 1) & (x.w == words[0].w), gender).alias("gender")))
    digits = F.regexp_replace(m, "[^0-9]", "")
    value = (
        F.when(kind == "email", F.lower(m)).when(kind == "ip6", _full_ip6(m)).when(kind == "phone", _national(m)).when(kind.isin("ssn", "card"), digits)
        .when(kind == "mac", F.lower(F.regexp_replace(m, ":", ""))).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(m)
    )
    return F.when(kind == "name", F.array_distinct(name)).otherwise(F.array(F.struct(F.concat(kind, F.lit(":"), value).alias("part"), F.lit(None).cast("string").alias("gender"))))


def surrogate(m: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a part in an attempt. m: type, with a name's gender after a stop, a colon and the value."""
    kind, v = F.substring_index(m, ":", 1), F.regexp_replace(m, "^[^:]*:", "")
    tweak = lambda name: F.concat(F.lit(name), attempt)
    hexes = F.substr(F.concat(_digest(key, "hex", attempt, m), _digest(key, "hex more", attempt, m)), F.lit(1), F.length(v))
    made = {
        "email": _email_surrogate(v, attempt, key), "ip": _ip_surrogate(v, attempt, key), "phone": _moved_number(v, tweak("phone"), key), "ssn": permuted_digits(v, tweak("ssn"), key),
        "card": _card_surrogate(v, attempt, key), "ip6": F.regexp_replace(F.substring(_digest(key, "ip6", attempt, v), 1, 32), "(.{4})(?!$)", "$1:"),
        "hex": hexes, "mac": hexes, "iban": _iban_surrogate(v, attempt, key), "key": _alike(v, "key", attempt, key, 4),
    }
    name = _word_surrogate(v, F.substring_index(kind, ".", -1), attempt, key)
    return reduce(lambda c, k: c.when(kind == k, made[k]), made, F.when(kind.startswith("name"), name))


def _refilled(shape: Column, pattern: str, characters: Column) -> Column:
    """shape with the signs that fit pattern replaced by characters in order."""
    gaps = F.split(shape, pattern, -1)
    return F.concat(gaps[0], F.array_join(F.zip_with(F.split(characters, ""), F.slice(gaps, F.lit(2), F.size(gaps) - 1), lambda c, g: F.concat(c, g)), ""))


def _like(word: Column, made: Column) -> Column:
    """made with the capitals of word."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(made)).otherwise(F.initcap(made))


def written(m: Column, kind: Column, made: Column, key: str = KEY) -> Column:
    """A mention with the surrogates of its parts in its own format. made: part -> surrogate."""
    one = F.map_values(made)[0]
    digits = F.regexp_replace(m, "[^0-9]", "")
    number = _refilled(m, "[0-9]", F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(one)), one))
    title = F.regexp_extract(m, rf"^(?:{_TITLE})\.? ", 0)
    word = lambda x: F.when(x.plain, _like(x.w, made[F.concat(F.lit("name:"), F.lower(x.w))])).when(x.w.rlike(r"\.$"), F.translate(x.w, _LETTERS, _permuted_letters(key))).otherwise(x.w)
    name = F.concat(title, F.array_join(F.transform(_name_words(m), word), " "))
    mac = _refilled(m, "[0-9A-Fa-f]", F.when(m.rlike("[A-F]"), F.upper(one)).otherwise(one))
    return F.when(kind == "name", name).when(kind.isin("phone", "ssn", "card"), number).when(kind == "mac", mac).when(kind == "iban", _refilled(m, "[0-9A-Z]", one)).otherwise(one)


def alone(m: Column, kind: Column, made: Column) -> Column:
    """(w, made): what of a mention is replaced wherever it stands alone in the document."""
    words = F.transform(F.filter(_name_words(m), lambda x: x.plain & (F.length(x.w) > 1) & ~x.w.rlike(r"\.$")), lambda x: F.struct(x.w.alias("w"), _like(x.w, made[F.concat(F.lit("name:"), F.lower(x.w))]).alias("made")))
    number = _national(m)
    digits = F.array(F.struct(number.alias("w"), F.map_values(made)[0].alias("made")))
    return F.when(kind == "name", F.array_distinct(words)).when((kind == "phone") & (F.length(number) >= 7), digits).otherwise(F.array().cast("array<struct<w:string,made:string>>"))


def _marked(text: Column, pattern: Column) -> Column:
    """text as an array: what lies between the places that fit pattern, and these places, by turns."""
    both = F.split(F.regexp_replace(F.replace(text, F.lit(_SIGN), F.lit(_ESCAPED)), pattern, F.lit(f"{_AROUND}$0{_AROUND}")), _AROUND, -1)
    return F.transform(both, lambda x: F.replace(x, F.lit(_ESCAPED), F.lit(_SIGN)))


def pieces(text: Column) -> Column:
    """A text's gaps and mentions by turns; null where there is no mention."""
    found = F.when(text.rlike(HINT), _marked(text, F.lit(ENTITY)))
    return F.when(F.size(found) > 1, found)


def _distinct_parts(spark: SparkSession, mentions: DataFrame) -> DataFrame:
    """(part, m): the distinct parts, and what surrogate() takes, dealt over all tasks whatever their bytes."""
    each = mentions.select(F.explode("parts").alias("p")).groupBy("p.part").agg(F.min("p.gender").alias("least"), F.max("p.gender").alias("most"))
    gender = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("n")
    m = F.when(F.col("part").startswith("name:"), F.concat(F.lit("name."), F.coalesce(gender, F.lit("n")), F.substr("part", F.lit(5)))).otherwise(F.col("part"))
    return materialise(spark, each.select("part", m.alias("m")).repartition(partitions(spark), "part"), "pii-parts")


def _crowded(parts: DataFrame) -> DataFrame:
    """(space): the lengths of numbers of which the corpus holds over CROWDED; under a hundred rows can come out."""
    value = F.regexp_replace("part", "^[^:]*:", "")
    kind = F.substring_index("part", ":", 1)
    spaces = parts.where(kind.isin("phone", "ssn", "card", "ip")).groupBy(_space().alias("space"), kind.alias("kind"), F.when(kind != "ip", F.length(value)).otherwise(0).alias("n")).agg(F.count("*").alias("held"))
    size = F.when(F.col("kind") == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), F.col("n") - F.when(F.col("kind") == "card", 1).otherwise(0)))
    return spaces.where(F.col("held") > size * CROWDED).select("space")


def _space() -> Column:
    kind = F.substring_index("part", ":", 1)
    return F.when(kind == "ip", kind).when(kind.isin("phone", "ssn", "card"), F.concat(kind, F.length("part").cast("string"))).otherwise("other")


def surrogates(spark: SparkSession, mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(part, made): a surrogate for each distinct part of mentions (parts), no two alike and none an entity of the corpus."""
    parts = _distinct_parts(spark, mentions)
    # crowded lengths are a handful of rows: their parts do not bar one another
    crowded = F.broadcast(materialise(spark, _crowded(parts), "pii-crowded"))
    kind = F.substring_index("part", ":", 1)
    bars = parts.withColumn("space", _space()).join(crowded, "space", "left_anti").select(F.col("part").alias("claim"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("made"))
    left, done, attempt = parts, None, 0
    while True:
        tried = left.select("part", "m", surrogate(F.col("m"), F.lit(str(attempt)), key).alias("made")).select(F.concat(kind, F.lit(":"), "made").alias("claim"), "part", "m", "made")
        taken = bars if done is None else bars.union(done.select(F.concat(kind, F.lit(":"), "made"), *(F.lit(None).cast("string") for _ in range(3))))
        # of all that claim a surrogate, entities and earlier rounds come first; nearly every claim is alone
        claims = tried.union(taken).groupBy("claim").agg(F.max(F.col("part").isNull()).alias("barred"), F.min("part").alias("least"), F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "m", "made"))).alias("all"))
        rows = claims.select("barred", "least", F.explode("all").alias("x")).select("x.part", "x.m", "x.made", (~F.col("barred") & (F.col("x.part") == F.col("least"))).alias("ok"))
        seen = Observation()
        path = write(spark, rows.observe(seen, F.count(F.when(~F.col("ok"), 1)).alias("left")), "pii-surrogates")
        rows = spark.read.schema(rows.schema).parquet(path)
        good = rows.where("ok").select("part", "made")
        done = good if done is None else done.union(good)
        if not seen.get["left"]:
            return done
        left, attempt = rows.where("NOT ok").select("part", "m"), attempt + 1


def _given(dictionary: Column, gap: Column) -> Column:
    """gap with the words of dictionary (w, made) replaced where they stand alone."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(F.transform(dictionary, lambda d: F.concat(F.lit(r"\Q"), d.w, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    changed = F.transform(_marked(gap, pattern), lambda x, i: F.when(i % 2 == 1, F.filter(dictionary, lambda d: d.w == x)[0].made).otherwise(x))
    return F.array_join(changed, "")


def assembled(found: Column, made: Column, dictionary: Column) -> Column:
    """The text of pieces with its mentions replaced by made, in order, and the words of dictionary that stand alone."""
    gaps = F.filter(found, lambda _, i: i % 2 == 0)
    # only words that the gaps hold go into a pattern; they are told by their first letters or digits
    head = lambda w: F.regexp_extract(w, r"^(?:[\p{L}\p{M}]+|[0-9]+)", 0)
    held = F.when(F.size(dictionary) > 0, F.array_intersect(F.transform(dictionary, lambda d: head(d.w)), F.regexp_extract_all(F.array_join(gaps, " "), F.lit(r"\p{Lu}[\p{L}\p{M}]*|[0-9]{7,}"), F.lit(0))))
    chosen = F.array_sort(F.filter(dictionary, lambda d: F.array_contains(held, head(d.w))), lambda a, b: F.length(b.w) - F.length(a.w))
    gaps = F.when(F.size(held) > 0, F.transform(gaps, lambda g: _given(chosen, g))).otherwise(gaps)
    return F.array_join(F.flatten(F.zip_with(gaps, made, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def with_surrogates(spark: SparkSession, docs: DataFrame, key: str = KEY, n_entities: str | None = None) -> DataFrame:
    """docs with their texts' entities replaced; all columns stay, and n_chars follows the text where there is one.

    n_entities names a further column for the number of a text's mentions. A text is searched once; texts without a
    mention, most of them, are in no exchange.
    """
    found, row = fresh(docs, "_found"), fresh(docs, "_row")
    staged = docs.withColumn(found, pieces(F.col("text"))).withColumn("text", F.when(F.col(found).isNull(), F.col("text"))).withColumn(row, F.monotonically_increasing_id())
    staged = materialise(spark, staged, "pii-pieces")
    some = staged.where(F.col(found).isNotNull())
    in_docs = some.select(F.col(row).alias("row"), F.posexplode(F.filter(found, lambda _, i: i % 2 == 1)).alias("pos", "mention"))
    kind = F.col("kind")
    mentions = in_docs.select("mention").distinct().withColumn("kind", kind_of(F.col("mention"))).withColumn("parts", parts_of(F.col("mention"), kind))
    mentions = materialise(spark, mentions, "pii-mentions")
    made = mentions.select("mention", "kind", F.explode("parts.part").alias("part")).join(surrogates(spark, mentions, key), "part")
    made = made.groupBy("mention", "kind").agg(F.map_from_entries(F.collect_list(F.struct("part", "made"))).alias("by_part"))
    made = made.select("mention", written(F.col("mention"), kind, F.col("by_part"), key).alias("made"), alone(F.col("mention"), kind, F.col("by_part")).alias("alone"))
    made = materialise(spark, made, "pii-written")
    by_row = in_docs.join(made, "mention").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "made"))).alias("made"), F.array_distinct(F.flatten(F.collect_list("alone"))).alias("alone"))
    mine = [fresh(docs, "_made"), fresh(docs, "_alone")]
    by_row = by_row.select(F.col("row").alias(row), F.col("made.made").alias(mine[0]), F.col("alone").alias(mine[1]))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    if n_entities:
        columns[n_entities] = F.floor(F.coalesce(F.size(found), F.lit(0)) / 2).cast("bigint")
    plain = staged.where(F.col(found).isNull()).select(*(c.alias(n) for n, c in (columns | ({n_entities: F.lit(0).cast("bigint")} if n_entities else {})).items()))
    text = assembled(F.col(found), F.col(mine[0]), F.col(mine[1]))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = some.join(by_row, row).withColumn("text", text).select(*(c.alias(n) for n, c in columns.items()))
    return plain.union(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_entities, text) of every document."""
    return with_surrogates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), n_entities="n_entities").select("doc_id", "n_entities", "text")
