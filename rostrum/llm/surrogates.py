"""Operator 2, surrogates for personal data, in Spark SQL functions only.

Entities are found by pattern: e-mail and IPv4 addresses, phone, card and social security
numbers, IBANs, access keys, passwords and tokens, and names after a title. Each is replaced by
a value of its type that a keyed hash of its normal form derives:

* Type and format stay: separators, brackets, letter case, number of digits, country codes,
  the prefix of a key, the first digit of a card, the reserved ``example`` domain for e-mail.
* A card number is one whose check digit is right; other long numbers are left alone, and the
  check digit of a surrogate is right, too.
* Secrets run to their closing quote, white space or line end, names over all their parts.
* Names keep particles, gender (given names take a gender's endings, from the title), script (Latin,
  Cyrillic, Greek) and case; each part of a name is replaced by itself, so "Mr Ann Lee" and
  "Mr Lee" stay the same person.
* One normal form gives one surrogate everywhere (coreference), whatever its spelling.
* Distinct forms give distinct surrogates, and no surrogate is a value that occurs: all
  surrogates are checked against each other and against all entities; those that collide take
  the next attempt of the hash until none is left. Only entities are shuffled for this, after
  distinct; texts are not. Attempts beyond the first are rare; documents that need them are
  found by a hash of their text.

Whoever holds the key can link surrogates to entities; ``key`` belongs to the caller.

Defined results: a null text stays null, one without entities stays as it is; ids and other
columns are passed through untouched and may be null or repeat; equal texts get equal results.
An empty table gives no rows. The helper columns are named ``_pii_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import folder

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "Господин", "Κος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Sra", "Doña", "Г-жа", "Госпожа", "Κα")
NEUTRAL = ("Mx", "Dr", "Prof")

_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
# Words in lower case inside a name; they stay.
PARTICLES = tuple(
    "von vom van der den de del della dello degli dei di da do dos das du des la las los le el al bin bint ibn ben abu "
    "zu zum zur af av til ter ten te y e".split()
)
# Repeated groups are possessive: Java walks these in a loop and the others by recursion, once per
# repetition, which overflows its stack on a long text.
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
_PART = r"(?:\p{Ll}{1,4}['’])?\p{Lu}[\p{L}\p{M}'’-]*"
# A title after a name begins another one; "Don" is a given name, too.
_AGAIN = rf"(?!(?:{'|'.join(t for t in _TITLE.split('|') if t != 'Don')})\.? {_PARTICLES}\p{{Lu}})"
_NAME = rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? {_PARTICLES}{_PART}(?: {_PARTICLES}{_AGAIN}{_PART})*+"
# To the closing quote, or to white space, a quote or the end; marks that close a sentence stay.
_SECRET = (
    r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}(?:"
    r"\"(?=[^\"\r\n]{8,}\")(?=[^\"\r\n]*\d)[^\"\r\n]+|'(?=[^'\r\n]{8,}')(?=[^'\r\n]*\d)[^'\r\n]+|"
    r"[\"']?(?=[^\s\"']*\d)[^\s\"']{7,}[^\s\"',.;:)\]}>])"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

PATTERN = "|".join([
    _SECRET,
    r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)++",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",
    r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,12}){1,6}(?!\d)",
    r"\+\d{8,15}(?!\d)",
    r"(?<![\w+])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)",
    r"(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    _NAME,
])
# A text without any of these has no entity: most texts are told apart by one quick search.
GUARD = rf"[0-9@]|(?:{_TITLE})\.? {_PARTICLES}{_PART}"

# Consonants with vowels; sixteen syllables for each hexadecimal digit and script.
_SYLLABLES = {
    "latin": "ba de fi go lu ma ne pi ro su ta ve wi ko na le".split(),
    "cyrillic": "ба де фи го лу ма не пи ро су та ве зи ко на ле".split(),
    "greek": "βα δε φι γο λυ μα νε πι ρο συ τα θε ζι κο να λε".split(),
}
_ENDINGS = {
    "latin": {"given-m": "n", "given-f": "a", "given-n": "", "family": "r"},
    "cyrillic": {"given-m": "н", "given-f": "я", "given-n": "", "family": "в"},
    "greek": {"given-m": "ς", "given-f": "η", "given-n": "", "family": "ου"},
}


def _q(s: str) -> str:
    """A raw SQL literal."""
    return 'r"' + s + '"' if '"' not in s else "r'" + s + "'"


def _kind(e: str) -> str:
    phone = r"^[+(]|^\d{3}[-.]\d{3}[-.]\d{4}$"
    return f"""CASE WHEN contains({e}, '@') AND NOT {e} RLIKE {_q('[=:]')} THEN 'email'
      WHEN {e} RLIKE {_q(r'^AKIA[0-9A-Z]{16}$')} THEN 'access'
      WHEN {e} RLIKE {_q(r'^[A-Z]{2}[0-9]{2}')} THEN 'iban'
      WHEN {e} RLIKE {_q(r'[=:]')} THEN 'secret'
      WHEN {e} RLIKE {_q(r'^[0-9]{1,3}([.][0-9]{1,3}){3}$')} THEN 'ip'
      WHEN {e} RLIKE {_q(r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$')} THEN 'ssn'
      WHEN {e} RLIKE {_q(phone)} THEN 'phone'
      WHEN {e} RLIKE {_q(r'^[0-9]')} THEN CASE WHEN luhn_check({_digits(e)}) THEN 'card' ELSE 'number' END ELSE 'name' END"""


_COUNTRY = r"^\+(\d{1,3})[ .(-]"
_VALUE = r"^(?s)(.*?[=:]\s{0,3}[\"']?)(.*)$"


def _digits(e: str) -> str:
    return f"regexp_replace({e}, {_q(r'[^0-9]')}, '')"


def _country(e: str) -> str:
    return f"regexp_extract({e}, {_q(_COUNTRY)}, 1)"


def _secret_part(e: str, part: int) -> str:
    return f"regexp_extract({e}, r'{_VALUE.replace(chr(39), chr(92) + 'x27')}', {part})"


def _key(kind: str, e: str) -> str:
    """Normal form of an entity: what is the same thing has the same one."""
    return f"""CASE {kind} WHEN 'email' THEN lower({e}) WHEN 'secret' THEN {_secret_part(e, 2)}
      WHEN 'iban' THEN replace({e}, ' ', '') WHEN 'phone' THEN substr({_digits(e)}, length({_country(e)}) + 1)
      WHEN 'card' THEN {_digits(e)} WHEN 'ssn' THEN {_digits(e)} ELSE {e} END"""


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _name_kind(n: str, k: str) -> str:
    """Kind of the ``k``-th part of a split name."""
    return f"""CASE WHEN {k} = size({n}.words) - 1 THEN 'family' WHEN {n}.title IN {_in(MALE)} THEN 'given-m'
      WHEN {n}.title IN {_in(FEMALE)} THEN 'given-f' ELSE 'given-n' END"""


def _split_name(e: str, body: str) -> str:
    """``body`` over ``n``, the title of a name without its dot and the parts after it, particles
    included: split once, whatever their number."""
    return f"""transform(transform(array(split({e}, ' ')), w -> struct(w[0] AS as_it_stands,
      rtrim('.', w[0]) AS title, slice(w, 2, size(w)) AS words)), n -> {body})[0]"""


def _parts(e: str) -> str:
    """The things that an entity names, as ``array<struct<kind, key>>``; a number has none."""
    names = _split_name(e, f"""transform(filter(transform(n.words, (t, k) -> struct({_name_kind('n', 'k')} AS kind, t AS word)),
      p -> p.word NOT IN {_in(PARTICLES)}), p -> struct(p.kind AS kind, lower(p.word) AS key))""")
    one = f"transform(filter(array({_kind(e)}), kind -> kind <> 'number'), kind -> struct(kind AS kind, {_key('kind', e)} AS key))"
    return f"CASE WHEN ({_kind(e)}) = 'name' THEN {names} ELSE {one} END"


def _letters(h: str) -> str:
    return f"translate({h}, '0123456789abcdef', 'bcdfghjkmnpqrstv')"


def _numbers(h: str) -> str:
    return f"translate({h}, 'abcdef', '012345')"


def _shaped(s: str, h: str) -> str:
    """Every digit and letter of a string replaced by one of its sort."""
    hexadecimal = f"substr({h}, i % 64 + 1, 1)"
    return f"""array_join(transform(split({s}, ''), (c, i) -> CASE
      WHEN c RLIKE '[0-9]' THEN {_numbers(hexadecimal)}
      WHEN c RLIKE '[a-z]' THEN {_letters(hexadecimal)}
      WHEN c RLIKE '[A-Z]' THEN upper({_letters(hexadecimal)})
      WHEN c RLIKE {_q(r'[\p{L}\p{M}]')} THEN {_letters(hexadecimal)}
      WHEN c RLIKE {_q(r'\p{N}')} THEN {_numbers(hexadecimal)} ELSE c END), '')"""


def _octet(h: str, at: int, base: int, least: int) -> str:
    return f"cast(cast(conv(substr({h}, {at}, 4), 16, 10) as int) % {base} + {least} as string)"


def _name(script: str, kind: str, h: str, attempt: str) -> str:
    syllables = ", ".join(f"'{s}'" for s in _SYLLABLES[script])
    # A later attempt has one syllable more, so attempts come to an end.
    body = f"""array_join(transform(sequence(1, 3 + {attempt}), i ->
      element_at(array({syllables}), cast(conv(substr({h}, (i - 1) % 64 + 1, 1), 16, 10) as int) + 1)), '')"""
    ends = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ENDINGS[script].items())
    return f"concat({body}, CASE {kind} {ends} ELSE '' END)"


def _hash(secret: str, kind: str, key: str, attempt: str) -> str:
    # Length and separator keep different inputs apart.
    return f"sha2(concat_ws(':', '{secret}', {kind}, cast({attempt} as string), {key}), 256)"


def surrogate(secret: str, kind: str, key: str, attempt: str) -> str:
    """SQL of the surrogate of a normal form, itself a normal form."""
    domain = f"sha2(concat_ws(':', '{secret}', 'domain', substring_index({key}, '@', -1)), 256)"
    top = f"substring_index({key}, '.', -1)"
    email = f"""concat({_letters('substr(h, 1, 9)')},
      CASE WHEN substring_index({key}, '@', 1) RLIKE '[0-9]' THEN concat('.', {_numbers('substr(h, 10, 2)')}) ELSE '' END,
      '@', {_letters(f'substr({domain}, 1, 6)')}, '.example.',
      CASE WHEN {top} IN ('com', 'net', 'org') THEN {top} ELSE 'com' END)"""
    number = f"substr(concat({_numbers('h')}, {_numbers('reverse(h)')}), 1, length({key}))"
    # The last digit is the check digit.
    body = f"concat(substr({key}, 1, 1), substr({number}, 2, length({key}) - 2))"
    card = f"filter(transform(sequence(0, 9), d -> concat({body}, cast(d as string))), n -> luhn_check(n))[0]"
    ip = "concat_ws('.', " + ", ".join(
        [_octet("h", 1, 223, 1), _octet("h", 5, 256, 0), _octet("h", 9, 256, 0), _octet("h", 13, 254, 1)]
    ) + ")"
    names = f"""CASE WHEN {key} RLIKE '[\\\\u0400-\\\\u04ff]' THEN {_name('cyrillic', kind, 'h', attempt)}
      WHEN {key} RLIKE '[\\\\u0370-\\\\u03ff]' THEN {_name('greek', kind, 'h', attempt)}
      ELSE {_name('latin', kind, 'h', attempt)} END"""
    body = f"""CASE {kind} WHEN 'email' THEN {email} WHEN 'ip' THEN {ip}
      WHEN 'card' THEN {card} WHEN 'ssn' THEN {number}
      WHEN 'phone' THEN {number} WHEN 'iban' THEN concat(substr({key}, 1, 2), {_shaped(f'substr({key}, 3)', 'h')})
      WHEN 'access' THEN concat('AKIA', upper(substr(h, 1, 16)))
      WHEN 'secret' THEN CASE WHEN {key} RLIKE '^[0-9a-f]+$' AND length({key}) <= 128
        THEN substr(concat(h, reverse(h)), 1, length({key})) ELSE {_shaped(key, 'h')} END
      ELSE {names} END"""
    return f"transform(array({_hash(secret, kind, key, attempt)}), h -> {body})[0]"


def _filled(e: str, s: str) -> str:
    """The letters and digits of ``s`` in the format of ``e``."""
    return f"""aggregate(transform(sequence(1, length({e})), i -> substr({e}, i, 1)),
      named_struct('o', '', 'k', 0), (a, c) -> IF(c RLIKE '[0-9A-Za-z]',
        named_struct('o', concat(a.o, substr({s}, a.k + 1, 1)), 'k', a.k + 1),
        named_struct('o', concat(a.o, c), 'k', a.k)), a -> a.o)"""


def _cased(word: str, like: str) -> str:
    return f"""CASE WHEN length({like}) > 1 AND {like} = upper({like}) THEN upper({word})
      WHEN substr({like}, 1, 1) = upper(substr({like}, 1, 1)) THEN initcap({word}) ELSE {word} END"""


def _replaced(secret: str, e: str) -> str:
    """SQL of what takes the place of an entity; ``_pii_over`` has attempts beyond the first."""

    def value(kind: str, key: str) -> str:
        attempt = f"coalesce(_pii_over[concat({kind}, ':', {key})], 0)"
        return f"transform(array({attempt}), n -> {surrogate(secret, kind, key, 'n')})[0]"

    names = _split_name(e, f"""concat(n.as_it_stands, ' ', array_join(transform(transform(n.words, (t, k) ->
      struct({_name_kind('n', 'k')} AS kind, lower(t) AS key, t AS word)), p -> CASE WHEN p.word IN {_in(PARTICLES)} THEN p.word
      ELSE {_cased(value('p.kind', 'p.key'), 'p.word')} END), ' '))""")
    one = f"""transform({_parts(e)}, p -> transform(array({value('p.kind', 'p.key')}), s -> CASE p.kind
      WHEN 'email' THEN CASE WHEN {e} = upper({e}) THEN upper(s) ELSE s END
      WHEN 'secret' THEN concat({_secret_part(e, 1)}, s) WHEN 'phone' THEN {_filled(e, f'concat({_country(e)}, s)')}
      WHEN 'ip' THEN s WHEN 'access' THEN s ELSE {_filled(e, 's')} END)[0])[0]"""
    return f"CASE ({_kind(e)}) WHEN 'name' THEN {names} WHEN 'number' THEN {e} ELSE {one} END"


def entities(text: str) -> Column:
    """All entities of a text, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    return F.when(F.col(text).rlike(GUARD), found).otherwise(F.array().cast("array<string>"))


def mentions(docs: DataFrame, text: str) -> DataFrame:
    """Distinct ``(kind, key)`` of all entities."""
    rows = docs.select(entities(text).alias("_pii_found")).filter("size(_pii_found) > 0")
    parts = rows.select(F.expr(f"explode(flatten(transform(_pii_found, e -> {_parts('e')}))) AS part"))
    return parts.select("part.kind", "part.key").distinct()


def attempts(known: DataFrame, secret: str, most: int = 64) -> DataFrame:
    """``(kind, key, attempt)`` of those whose first surrogate collides.

    ``known`` are the distinct normal forms. In each round the open ones get a surrogate; it
    stands if nothing real equals it, no earlier surrogate does, and of equal ones in the round
    it belongs to the smallest form.
    """
    spark = known.sparkSession
    still, settled, out = known, None, None
    for attempt in range(most):
        made = F.expr(surrogate(secret, "kind", "key", str(attempt)))
        tried = folder.written(still.select("kind", "key", made.alias("made")), "surrogates")
        taken = known.select("kind", F.col("key").alias("made"))
        if settled is not None:
            taken = taken.union(settled)
        rows = tried.select("kind", "made", "key").union(
            taken.select("kind", "made", F.lit(None).cast("string").alias("key"))
        )
        first = rows.groupBy("kind", "made").agg(
            F.min("key").alias("first"), F.max(F.col("key").isNull()).alias("taken")
        ).filter("first is not null")
        checked = folder.written(
            tried.join(first, ["kind", "made"]).withColumn("good", ~F.col("taken") & (F.col("key") == F.col("first"))),
            "surrogates",
        )
        good = checked.filter("good")
        if attempt:
            found = good.select("kind", "key", F.lit(attempt).alias("attempt"))
            out = found if out is None else out.union(found)
        still = checked.filter("not good").select("kind", "key")
        if still.isEmpty():
            break
        made = good.select("kind", "made")
        settled = made if settled is None else settled.union(made)
    else:
        raise RuntimeError("surrogates still collide")
    return out if out is not None else spark.createDataFrame([], "kind string, key string, attempt int")


def replace(docs: DataFrame, text="text", key: str = "rostrum") -> DataFrame:
    """``docs`` with surrogates in ``text``."""
    if "'" in key or "\\" in key:
        raise ValueError("the key must have no quote and no backslash")
    known = folder.written(mentions(docs, text), "mentions")
    late = folder.written(attempts(known, key), "attempts")
    rows = docs
    none = F.expr("cast(map() as map<string, int>)")
    if late.isEmpty():
        rows = rows.withColumn("_pii_over", none)
    else:
        found = docs.select(F.xxhash64(text).alias("_pii_text"), entities(text).alias("_pii_found"))
        found = found.filter("size(_pii_found) > 0").distinct()
        parts = found.select(
            "_pii_text", F.expr(f"explode(flatten(transform(_pii_found, e -> {_parts('e')}))) AS part")
        ).select("_pii_text", "part.kind", "part.key")
        # A text names few things, so its map is small.
        entry = F.struct(F.concat("kind", F.lit(":"), "key"), "attempt")
        maps = parts.distinct().join(late, ["kind", "key"]).groupBy("_pii_text").agg(
            F.map_from_entries(F.collect_set(entry)).alias("_pii_map")
        )
        maps = folder.written(maps, "attempts")
        rows = rows.withColumn("_pii_text", F.xxhash64(text)).join(maps, "_pii_text", "left")
        rows = rows.withColumn("_pii_over", F.coalesce("_pii_map", none))
    rows = rows.withColumn("_pii_found", entities(text))
    rows = rows.withColumn("_pii_gaps", F.when(F.size("_pii_found") > 0, F.split(F.col(text), PATTERN, -1)))
    made = F.expr(f"""CASE WHEN size(_pii_found) > 0 THEN concat(array_join(zip_with(
      slice(_pii_gaps, 1, size(_pii_found)), transform(_pii_found, e -> {_replaced(key, 'e')}), (g, s) -> concat(g, s)), ''),
      element_at(_pii_gaps, -1)) ELSE `{text}` END""")
    out = rows.withColumn(text, made)
    real = F.expr(f"filter(_pii_found, e -> ({_kind('e')}) <> 'number')")
    return out.select(*docs.columns, F.size(real).alias("_pii_entities"))


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs).withColumnRenamed("_pii_entities", "n_entities")
