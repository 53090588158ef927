"""Small text, token, URL and array functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions import fixed

# A token is a run of letters, marks, digits and underscores, or one other character.
WORD_CHAR = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{WORD_CHAR}]+|[^{WORD_CHAR}\s]"
ALPHA = r"^\p{L}+$"
SENTENCE_END = r"([.!?])\s+"
MARK = "\x01"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """``array<string>`` of words and single punctuation marks."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0))


def n_tokens(c) -> Column:
    return F.size(tokens(c)).cast("long")


def is_alpha(c) -> Column:
    return _col(c).rlike(ALPHA)


def has_word(c) -> Column:
    """True when at least one token is made of letters only."""
    return F.exists(tokens(c), is_alpha)


def sentences(c) -> Column:
    """``array<string>``: cut after ``. ! ?`` plus white space, and at line ends."""
    marked = F.regexp_replace(_col(c), F.lit(SENTENCE_END), F.lit("$1" + MARK))
    parts = F.split(marked, rf"[{MARK}\n]+")
    return F.filter(parts, lambda s: F.length(F.trim(s)) > 0)


def host(url) -> Column:
    """Network location of a URL without a leading ``www.``; ``""`` if there is none."""
    netloc = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(netloc, r"^www\.", "")


def core_domain(url) -> Column:
    """Last two labels of the host, or three under a short or shared second level."""
    netloc = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    parts = F.split(netloc, r"\.")
    second = F.get(parts, F.size(parts) - 2)
    three = (F.size(parts) > 2) & (
        (F.length(second) == 2) | second.isin(fixed.SHARED_SECOND_LEVEL)
    )
    keep = F.when(three, 3).otherwise(F.least(F.size(parts), F.lit(2)))
    return F.array_join(F.slice(parts, F.size(parts) - keep + 1, keep), ".")


def padded_id(c, suffix=None, width: int = 10) -> Column:
    """Zero-padded id; longer ids are kept whole. ``suffix`` is appended."""
    text = _col(c).cast("string")
    out = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return out if suffix is None else F.concat(out, suffix)


def comma_list(c) -> Column:
    """``"a , b"`` to ``["a", "b"]``."""
    return F.transform(F.split(_col(c), ","), lambda x: F.trim(x))


def name_list(c) -> Column:
    """``"a, b"`` to ``["a", "b"]``, split at comma plus one space."""
    return F.split(_col(c), ", ")


def day_string(ts) -> Column:
    """``DD-MM-YYYY``; a missing date becomes an empty string."""
    return F.coalesce(F.date_format(_col(ts), "dd-MM-yyyy"), F.lit(""))


def label_of(code, names: dict) -> Column:
    """Map codes to names (or names to codes); an unknown code becomes NULL."""
    code = _col(code)
    out = F.lit(None)
    for key, name in names.items():
        out = F.when(code == F.lit(key), F.lit(name)).otherwise(out)
    return out


def holds_all(c, values) -> Column:
    """True when the array holds every one of ``values``."""
    wanted = F.array(*[F.lit(v) for v in values])
    return F.size(F.array_intersect(_col(c), wanted)) == F.size(F.array_distinct(wanted))


def encode_multi_hot(c, vocab) -> Column:
    """0/1 array over ``vocab``: is the entry in the array column?"""
    words = F.array(*[F.lit(v) for v in vocab])
    names = _col(c)
    return F.transform(words, lambda v: F.array_contains(names, v).cast("int"))


def decode_multi_hot(c, vocab) -> Column:
    """Entries of ``vocab`` whose position holds a 1."""
    words = F.array(*[F.lit(v) for v in vocab])
    pairs = F.arrays_zip(words.alias("w"), _col(c).alias("b"))
    return F.transform(F.filter(pairs, lambda p: p["b"] == 1), lambda p: p["w"])


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays; NULL when either has length zero."""
    a, b = _col(a), _col(b)

    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
