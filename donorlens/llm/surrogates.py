"""Keyed surrogates for personal data, in DataFrame expressions only.

Detection: one regular expression finds e-mail addresses, IPv4 and IPv6 addresses,
card and account numbers, phone and social security numbers, IBANs, long
hexadecimal or assigned secrets, and persons named with a title: any number of
names, initials and particles ("Dr J. Robert van der Berg"). Each name is an
entity of its own, so "Ms Ada Byron" and "Ms Byron" stay the same person; where
a document names a person with a title, it is also found without one in the rest
of that document ("Byron's").

Surrogate: HMAC-SHA-256, under the caller's key, of type, canonical value and
attempt fills the value's own layout: digits for digits, letters for letters of
the same script and case, hexadecimal for hexadecimal, separators and country
codes as they were, numbers with a valid Luhn digit get a valid one, names keep
script, case and the gender of their title. The same entity gets the same
surrogate in every document and spelling (coreference). The key is part of the
query's plan, so plans of such queries are as confidential as the key.

Collision check: all distinct entities of the corpus are compared by surrogate.
If several share one, or a surrogate is itself a value found in the corpus, all
but one draw again with the next attempt, until all are distinct.

Rows without a finding pass by untouched. For the others the distinct mentions
are joined with their replacements; a mention that a third of all documents
hold is one row of that table, and the documents' side of the join is spread
by AQE.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlens.llm.common import staged

#: for tests and trials only: with a published key anyone can compute the mapping
TRIAL_KEY = "surrogate-key-1"
MAX_ATTEMPTS = 64

# Titles by gender.
MALE = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña",
          "Госпожа", "Г-жа"]
NEUTRAL = ["Dr", "Prof", "Mx"]

# Parts of made-up names, by script.
LATIN_STEMS = ["al", "ber", "cor", "dan", "el", "fer", "gar", "hal", "ir", "jor", "kel", "lor", "mar", "nor", "ol",
               "per", "quin", "ros", "sal", "tor", "ul", "ver", "wil", "yor", "zan"]
LATIN_ENDS = {"M": ["ano", "bert", "dric", "fred", "mond", "ton"], "F": ["anna", "bella", "dina", "lia", "mina", "rosa"],
              "U": ["ael", "ey", "in", "is", "lee", "ray"], "S": ["bury", "dale", "feld", "ham", "land", "mann", "sen",
                                                                 "well"]}
CYRILLIC_STEMS = ["ал", "бор", "вер", "гор", "дан", "ел", "зор", "кор", "лен", "мар", "ник", "ол", "пав", "рос", "сер",
                  "тим"]
CYRILLIC_ENDS = {"M": ["ан", "ей", "ий", "слав"], "F": ["ана", "ина", "ия", "слава"], "U": ["я", "и", "ен", "ань"],
                 "S": ["енко", "ич", "ских", "чук"]}

# Particles within names.
PARTICLES = ["af", "al", "av", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le",
             "ten", "ter", "van", "von", "zu", "zur", "фон"]


def _span(first: int, last: int) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha() and c not in "ªº")


#: letters to draw from: a class of characters and the alphabet that replaces them, the first that fits
ALPHABETS = [
    ("[a-z]", _span(0x61, 0x7A)), ("[A-Z]", _span(0x41, 0x5A)),
    (r"[\p{IsLatin}&&\p{Lu}]", _span(0x41, 0x5A)), (r"\p{IsLatin}", _span(0x61, 0x7A)),
    (r"[\p{IsCyrillic}&&\p{Lu}]", _span(0x410, 0x42F)), (r"\p{IsCyrillic}", _span(0x430, 0x44F)),
    (r"[\p{IsGreek}&&\p{Lu}]", _span(0x391, 0x3A9)), (r"\p{IsGreek}", _span(0x3B1, 0x3C9).replace("ς", "")),
    (r"[\p{IsArmenian}&&\p{Lu}]", _span(0x531, 0x556)), (r"\p{IsArmenian}", _span(0x561, 0x586)),
    (r"\p{IsGeorgian}", _span(0x10D0, 0x10F0)), (r"\p{IsHebrew}", _span(0x5D0, 0x5EA)),
    (r"\p{IsArabic}", _span(0x627, 0x63A) + _span(0x641, 0x64A)), (r"\p{IsDevanagari}", _span(0x915, 0x939)),
    (r"\p{IsThai}", _span(0xE01, 0xE2E)), (r"\p{IsHiragana}", _span(0x3042, 0x3093)),
    (r"\p{IsKatakana}", _span(0x30A2, 0x30F3)), (r"\p{IsHangul}", _span(0xAC00, 0xAFFF)),
    (r"\p{IsHan}", _span(0x4E00, 0x51FF)),
]



def session_key(spark) -> str:
    """The key that the session names in ``spark.donorlens.surrogateKey``, or else the published trial key."""
    return spark.conf.get("spark.donorlens.surrogateKey", TRIAL_KEY)


_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_INITIAL = r"(?:\p{Lu}\.)++|\p{Lu}(?![\p{L}\p{N}'’-])"
_PART = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=lambda w: (-len(w), w)))})[  ])*+(?:{_NAME}|{_INITIAL})"
_TITLES = sorted({t for w in MALE + FEMALE + NEUTRAL for t in (w, w.upper())}, key=lambda w: (-len(w), w))
_TITLE = "(?:" + "|".join(_TITLES) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_ALONE = r"(?<![\p{L}\p{N}])"  # no letter or digit before
_ASSIGN = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Aa]pi_?[Kk]ey|API_?KEY)\s{0,2}[=:]\s{0,2}[\"']?"
# Every pattern starts with a look at one character, so that the many places
# where nothing can start are left at once.
PATTERNS = {
    # possessive throughout: a domain of any number of labels is matched without going back or deeper
    "EMAIL": r"(?<![^\s@<>(),;:\"'])[^\s@<>(),;:\"']++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "IPV6": rf"(?=[0-9A-Fa-f:])(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*+[0-9])"
            rf"(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)(?![\p{{L}}\p{{N}}:])",
    "IPV4": rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "IBAN": rf"(?=[A-Z]){_ALONE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])",
    "ASSIGNED": rf"(?=[tspaTSPA]){_ALONE}{_ASSIGN}[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{{6,}}[A-Za-z0-9+/_=-]",
    "SECRET": rf"(?=[0-9a-f]){_ALONE}[0-9a-f]{{32,}}+(?![\p{{L}}\p{{N}}])"
              rf"|(?=A){_ALONE}AKIA[0-9A-Z]{{16}}(?![\p{{L}}\p{{N}}])",
    "PHONE": r"(?=\+)(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|(?=\()(?<!\d)\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?=\d)(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "SSN": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?=\d)(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,4}|\d{4}(?:-\d{4}){2}-\d{1,4}"
            r"|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "PERSON": rf"(?=[{''.join(sorted({t[0] for t in _TITLES}))}]){_ALONE}{_TITLE}[  ]{_PART}(?:[  ]{_PART})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this cheap expression has no match of ``ANY``.
HINT = rf"[0-9@]|{PATTERNS['ASSIGNED']}|{PATTERNS['SECRET']}|{PATTERNS['PERSON']}"


def _type(m: Column) -> Column:
    out = F.lit("CARD")
    for name in reversed(PATTERNS):
        if name != "CARD":
            out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _digest(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hexadecimal digits: two HMAC-SHA-256 values under ``key``."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))

    def hmac(text: Column) -> Column:
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)

    text = F.concat_ws("\u0001", kind, attempt.cast("string"), canon)
    return F.concat(hmac(text), hmac(F.concat(text, F.lit("+"))))


def _number(digest: Column, i: Column) -> Column:
    """The ``i``-th of 42 numbers below 4096 in a digest."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(42)) * 3 + 1, F.lit(3)), 16, 10).cast("int")


def _fill(value: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """``value`` with every letter and digit drawn anew from the digest."""

    def letter(alphabet: str, n: Column) -> Column:
        return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))

    def draw(c: Column, i: Column) -> Column:
        n = _number(digest, i) + F.floor(i / 42).cast("int") * 7
        digit = F.when((i == 0) & (c != "0"), letter("123456789", n)).otherwise(letter("0123456789", n))
        plain = F.when(c.rlike("[0-9]"), digit)
        for letters, alphabet in ALPHABETS:
            plain = plain.when(c.rlike(letters), letter(alphabet, n))
        plain = plain.otherwise(c)
        return plain if hexadecimal is None else F.when(hexadecimal, letter("0123456789abcdef", n)).otherwise(plain)

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int"))
        .otherwise(c.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _name(kind: Column, canon: Column, digest: Column, attempt: Column) -> Column:
    """A made-up name of the given kind (GIVEN_M, GIVEN_F, GIVEN_U, SURNAME) in the script of ``canon``.

    Every fourth attempt adds a stem, so the supply of names has no end.
    """

    def pick(parts: list[str], n: Column) -> Column:
        return F.element_at(F.array(*[F.lit(p) for p in parts]), F.pmod(n, F.lit(len(parts))) + 1)

    def made(stems: list[str], ends: dict) -> Column:
        more = F.array_join(F.transform(F.sequence(F.lit(0), 1 + F.floor(attempt / 4).cast("int")),
                                        lambda i: pick(stems, _number(digest, i))), "")
        end = pick(ends["S"], _number(digest, F.lit(40)))
        for g in "MFU":
            end = F.when(kind == f"GIVEN_{g}", pick(ends[g], _number(digest, F.lit(40)))).otherwise(end)
        return F.initcap(F.concat(more, end))

    # other scripts: letters of the script, more of them with every fourth attempt
    drawn = F.initcap(_fill(F.concat(canon, F.repeat(F.substring(canon, 1, 1), F.floor(attempt / 4).cast("int"))), digest))
    return (F.when(canon.rlike(r"\p{IsCyrillic}"), made(CYRILLIC_STEMS, CYRILLIC_ENDS))
            .when(canon.rlike(r"\p{IsLatin}"), made(LATIN_STEMS, LATIN_ENDS)).otherwise(drawn))


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, attempt)`` with ``surrogate``. The digests are columns, so they are found once per entity, not per letter."""
    kind, canon = F.col("kind"), F.col("canon")
    domain = F.when(kind == "EMAIL", _digest(key, F.lit("DOMAIN"), F.substring_index(canon, "@", -1), F.lit(0)))
    held = entities.withColumns({"digest": _digest(key, kind, canon, F.col("attempt")), "domain_digest": domain})
    return held.withColumn("surrogate", _surrogate()).select("kind", "canon", "attempt", "surrogate")


def _surrogate() -> Column:
    """The surrogate of (kind, canon) at ``attempt``, from its ``digest`` and its domain's."""
    kind, canon, attempt, digest = (F.col(c) for c in ("kind", "canon", "attempt", "digest"))
    domain = F.substring_index(canon, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)\.([^.]+)$", 1)
    # a crowded domain gets longer names: a letter more with every eighth attempt
    more = F.substring(_fill(F.lit("a" * 8), F.reverse(digest)), F.lit(1), F.floor(attempt / 8).cast("int"))
    email = F.concat(_fill(F.substring_index(canon, "@", 1), digest), more, F.lit("@"),
                     _fill(labels, F.col("domain_digest")), F.lit("."),
                     F.substring_index(domain, ".", -1))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)),
                                      lambda i: (F.pmod(_number(digest, i), F.lit(254)) + 1).cast("string")), ".")
    digits = _fill(canon, digest)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    luhn = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    iban = F.concat(F.substring(canon, 1, 2), _fill(F.substring(canon, F.lit(3), F.length(canon)), digest))
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex(
        F.pmod(_number(digest, i), F.lit(4095)) + 1))), ":")
    return (F.when(kind == "EMAIL", email).when(kind == "IPV4", octets).when(kind == "IPV6", groups)
            .when(kind == "CARD", F.when(_luhn(canon) == 0, luhn).otherwise(digits))
            .when(kind == "IBAN", iban).when(kind == "SECRET", _fill(canon, digest, canon.rlike("^[0-9a-f]+$")))
            .when(kind.startswith("GIVEN") | (kind == "SURNAME"), _name(kind, canon, digest, attempt))
            .otherwise(digits))


def _names(m: Column) -> Column:
    """The words of a person's mention behind the title: names, initials and particles."""
    return F.split(F.regexp_replace(m, rf"^{_TITLE}[  ]", ""), "[  ]")


def _is_name(word: Column) -> Column:
    return word.rlike(rf"^(?:{_NAME})$")


def _entities(mentions: DataFrame) -> DataFrame:
    """``(m)`` -> ``(m, part, kind, canon)``: the entities of each mention; of a person all names, by their place."""
    m, kind = F.col("m"), F.col("kind")
    bare = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    assigned = F.struct(F.lit(0).alias("part"), F.lit("SECRET").alias("kind"),
                        F.regexp_replace(m, f"^{_ASSIGN}", "").alias("canon"))
    title = F.regexp_replace(F.regexp_extract(m, rf"^({_TITLE})[  ]", 1), r"\.$", "")
    gender = (F.when(F.lower(title).isin([t.lower() for t in MALE]), "M")
              .when(F.lower(title).isin([t.lower() for t in FEMALE]), "F").otherwise("U"))
    words = _names(m)
    last = F.array_max(F.transform(words, lambda w, i: F.when(_is_name(w), i)))  # the last name is the surname
    names = F.filter(F.transform(words, lambda w, i: F.struct(
        i.alias("part"), F.when(i == last, "SURNAME").otherwise(F.concat(F.lit("GIVEN_"), gender)).alias("kind"),
        F.when(_is_name(w), F.lower(w)).alias("canon"))), lambda e: e["canon"].isNotNull())
    canon = (F.when(kind.isin("EMAIL", "IPV6"), F.lower(m)).when(kind.isin("IPV4", "SECRET"), m)
             .when(kind == "PHONE", F.substring(bare, F.greatest(F.length(bare) - 9, F.lit(1)), F.lit(10)))
             .otherwise(bare))
    other = F.array(F.struct(F.lit(0).alias("part"), kind.alias("kind"), canon.alias("canon")))
    parts = F.when(kind == "PERSON", names).when(kind == "ASSIGNED", F.array(assigned)).otherwise(other)
    return (mentions.withColumn("kind", _type(m)).withColumn("e", F.explode(parts))
            .select("m", "e.part", "e.kind", "e.canon"))


def _distinct_surrogates(entities: DataFrame, key: str = TRIAL_KEY) -> DataFrame:
    """``(kind, canon)`` -> ``(kind, canon, surrogate)`` without collisions."""
    now = staged(_drawn(entities.distinct().withColumn("attempt", F.lit(0)), key), "drawn")
    for _ in range(MAX_ATTEMPTS):
        shared = (now.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("first"))
                  .filter("n > 1").drop("n"))
        twice = now.join(shared, ["kind", "surrogate"]).filter("canon <> first").select("kind", "canon")
        real = now.select("kind", F.lower("canon").alias("taken"))
        found = (now.withColumn("taken", F.lower("surrogate")).join(real, ["kind", "taken"], "left_semi")
                 .select("kind", "canon"))
        again = staged(twice.union(found).distinct(), "again")
        if again.isEmpty():
            return now.select("kind", "canon", "surrogate")
        drawn = _drawn(now.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        now = staged(now.join(again, ["kind", "canon"], "left_anti").unionByName(drawn), "drawn")
    raise RuntimeError(f"no distinct surrogates after {MAX_ATTEMPTS} attempts")


def _laid_out(m: Column, value: Column) -> Column:
    """``value`` over the letters and digits of the mention, from the right; the rest of it stays."""
    n = F.length(F.regexp_replace(m, "[^A-Za-z0-9]", ""))

    def place(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^A-Za-z0-9]", ""))
        at = seen - (n - F.length(value)) + 1
        return F.when(c.rlike("[A-Za-z0-9]") & (at > 0), F.substring(value, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), place), "")


def _cased(word: Column, name: Column) -> Column:
    """``name`` in capitals where ``word`` is."""
    return F.when((word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1), F.upper(name)).otherwise(name)


def replacements(mentions: DataFrame, key: str = TRIAL_KEY) -> DataFrame:
    """``mentions(m)``, distinct -> ``(m, kind, replacement, names)``; ``names`` are the (lower-case) names
    of a person with their surrogates. An initial becomes a drawn letter; a person of initials only has no names."""
    kinds = mentions.withColumn("type", _type(F.col("m")))
    parts = staged(_entities(mentions), "entities")
    made = _distinct_surrogates(parts.select("kind", "canon"), key)
    got = parts.join(made, ["kind", "canon"]).groupBy("m").agg(
        F.array_sort(F.collect_list(F.struct("part", "canon", "surrogate"))).alias("s"))  # the words of one mention
    got = kinds.join(got, "m", "left")
    m, kind = F.col("m"), F.when(F.col("type") == "ASSIGNED", "SECRET").otherwise(F.col("type"))
    value = F.get("s", F.lit(0))["surrogate"]

    def word(w: Column, i: Column) -> Column:
        own = F.get(F.filter("s", lambda e: e["part"] == i), F.lit(0))["surrogate"]
        drawn = F.transform(F.split(w, ""), lambda c, k: F.when(c.rlike(r"\p{Lu}"), F.upper(_fill(
            c, _digest(key, F.lit("INITIAL"), c, F.lit(0))))).otherwise(c))
        return F.when(own.isNotNull(), _cased(w, own)).when(w.rlike(r"^(?:\p{Lu}\.?)+$"), F.array_join(drawn, "")).otherwise(w)

    gaps = F.split(F.regexp_replace(m, rf"^{_TITLE}[  ]", ""), "[^  ]+", -1)
    title = F.regexp_extract(m, rf"^({_TITLE}[  ])", 1)
    person = F.concat(title, F.array_join(F.zip_with(gaps, F.transform(_names(m), word), lambda g, w: F.concat(
        g, F.coalesce(w, F.lit("")))), ""))
    email = F.when(m == F.upper(m), F.upper(value)).otherwise(value)
    text = (F.when(kind == "PERSON", person).when(kind == "EMAIL", email)
            .when(kind == "SECRET", F.concat(F.regexp_extract(m, f"^({_ASSIGN})?", 0), value))
            .when(kind.isin("IPV4", "IPV6"), value).otherwise(_laid_out(m, value)))
    names = F.when(kind == "PERSON", F.transform("s", lambda e: F.struct(e["canon"].alias("name"), e["surrogate"])))
    return got.select("m", kind.alias("kind"), text.alias("replacement"), names.alias("names"))


def _renamed(segment: Column, names: Column) -> Column:
    """(text, number of names): ``segment`` with the names of persons that the document names with a title."""
    found = F.regexp_extract_all(segment, F.lit(_ALONE + _NAME), F.lit(0))

    def other(w: Column) -> Column:
        bare = F.regexp_replace(w, "['’]s$", "")
        own = F.get(F.filter(names, lambda e: e["name"] == F.lower(bare)), F.lit(0))["surrogate"]
        return F.concat(_cased(bare, own), F.substring(w, F.length(bare) + 1, F.length(w)))

    made = F.transform(found, other)
    kept = F.transform(F.arrays_zip(found.alias("w"), made.alias("o")), lambda e: F.coalesce(e["o"], e["w"]))
    text = F.array_join(F.zip_with(F.split(segment, _ALONE + _NAME, -1), kept, lambda gap, w: F.concat(
        gap, F.coalesce(w, F.lit("")))), "")
    return F.struct(text.alias("text"), F.size(F.filter(made, lambda o: o.isNotNull())).alias("n"))


def pseudonymised(docs: DataFrame, text_col: str = "text", key: str = TRIAL_KEY) -> DataFrame:
    """``(row, text, n_entities, entity_types)`` for every row of ``docs``.

    ``row`` is a struct of the other columns, whatever their names and nulls,
    ``text`` the text with surrogates, ``n_entities`` the mentions replaced,
    ``entity_types`` their types (distinct, sorted, comma-joined). Null and empty
    texts stay as they are, with 0 and "". Repeated rows are treated alike.
    """
    text = F.col("text")
    rest = [c for c in docs.columns if c != text_col]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    plain = docs.filter(~F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))).select(
        "row", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types"))
    hits = staged(docs.filter(text.rlike(HINT) & text.rlike(ANY))
                  .withColumn("found", F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
                  .withColumn("nth", F.monotonically_increasing_id()), "hits")
    held = hits.select("nth", F.explode(F.array_distinct("found")).alias("m"))
    table = staged(replacements(held.select("m").distinct(), key), "replacements")
    own = (held.join(table, "m").groupBy("nth")  # a text's own mentions
           .agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("kind", "replacement")))).alias("new"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")))
    done = hits.join(own, "nth").withColumn("made", F.transform("found", lambda m: F.element_at("new", m)))
    nobody = F.size("names") == 0
    segments = F.transform(F.split(text, ANY, -1), lambda p: F.when(
        nobody, F.struct(p.alias("text"), F.lit(0).alias("n"))).otherwise(_renamed(p, F.col("names"))))
    done = done.withColumn("segments", segments)
    whole = F.array_join(F.zip_with("segments", "made", lambda p, r: F.concat(
        p["text"], F.coalesce(r["replacement"], F.lit("")))), "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("made", lambda r: r["kind"]))), ",")
    count = F.size("made") + F.aggregate("segments", F.lit(0), lambda a, p: a + p["n"])
    return plain.unionByName(done.select("row", whole.alias("text"), count.cast("long").alias("n_entities"),
                                         kinds.alias("entity_types")))


def pseudonymised_documents(docs: DataFrame, key: str = TRIAL_KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``n_chars``, where there is one, follows the new text.

    Nulls in any column, empty texts and repeated rows are kept as ``pseudonymised`` says; no row gives no row.
    """
    made = pseudonymised(docs, key=key)
    columns = []
    for c in docs.columns:
        own = F.col("row")[c] if c != "text" else F.col("text")
        if c == "n_chars":
            own = F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return made.select(columns)
