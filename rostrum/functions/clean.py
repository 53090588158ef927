"""Text cleaning as composed Column expressions.

Each step is a function ``Column -> Column`` made of built-in string functions,
so a cleaned text is one projection over the scan: no shuffle and no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(c, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit(replacement))


def _once(c, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` refers to it."""
    return F.get(F.transform(F.array(_col(c)), fn), F.lit(0))


def strip(c) -> Column:
    """Drop white space of every kind at both ends."""
    return _sub(c, r"^\s+|\s+$", "")


def drop_strings(c, strings=None, replacement: str = " ") -> Column:
    """Replace each literal string, in list order, by one space."""
    out = _col(c)
    for s in fixed.BOILERPLATE if strings is None else strings:
        out = F.replace(out, F.lit(s), F.lit(replacement))
    return out


def drop_brackets(c) -> Column:
    """Remove ``( … )`` and ``[ … ]`` that close on the same line."""
    return _sub(c, r"\([^\n]*?\)|\[[^\n]*?\]", "")


def drop_parentheses(c) -> Column:
    """Remove ``( … )`` that closes on the same line."""
    return _sub(c, r"\([^\n]*?\)", "")


def drop_timestamps(c) -> Column:
    """Remove ``[hh:mm:ss]`` and ``(hh:mm:ss)``."""
    return _sub(c, r"[\[\(]\d{1,2}:\d{2}:\d{2}[\]\)]", "")


SPEAKER_LABEL = r"^[A-Z][A-Za-z0-9 .'\-]*:\s?"


def drop_speaker_prefix(c, mode: str = "label") -> Column:
    """Remove a leading speaker label.

    ``mode="label"`` takes only what looks like a name followed by a colon;
    ``mode="reference"`` drops everything up to the first colon of the text.
    """
    if mode not in ("label", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    return _sub(c, SPEAKER_LABEL if mode == "label" else r"^[^:]*:\s?", "")


def drop_unopened(c) -> Column:
    """Cut after the last closing bracket that was never opened, then strip.

    A fold over the characters of one text. Texts without a closing bracket
    skip the fold.
    """
    return strip(_once(c, _after_unopened))


def _after_unopened(c: Column) -> Column:
    state = F.struct(
        F.lit(0).cast("long").alias("pos"),
        F.lit(0).alias("round"),
        F.lit(0).alias("square"),
        F.lit(0).cast("long").alias("cut"),
    )

    def step(acc, ch):
        pos = acc["pos"] + F.lit(1).cast("long")
        rnd = acc["round"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        sqr = acc["square"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        return F.struct(
            pos.alias("pos"),
            F.greatest(rnd, F.lit(0)).alias("round"),
            F.greatest(sqr, F.lit(0)).alias("square"),
            F.when((rnd < 0) | (sqr < 0), pos).otherwise(acc["cut"]).alias("cut"),
        )

    cut = F.aggregate(F.split(c, ""), state, step, lambda acc: acc["cut"])
    return F.when(
        c.rlike(r"[\)\]]"),
        F.substr(c, (cut + 1).cast("int"), F.length(c)),
    ).otherwise(c)


def drop_leading_marks(c) -> Column:
    """Remove one leading punctuation mark (unless the text starts with ``[``),
    then a leading ``word.`` and then leading hyphens, periods and spaces."""
    # The mark class leaves out "[", so a text that starts with it is not touched.
    out = _sub(c, r"""^[!"#$%&'()*+,\-./:;<=>?@\\\]^_`{|}~]\s*""", "")
    out = _sub(out, r"^\w+\.\s", "")
    return _sub(out, r"^[-.,\s]+", "")


def strip_leading(c, mode: str = "label") -> Column:
    """Speaker prefix, unopened brackets and leading marks, in that order."""
    return drop_leading_marks(drop_unopened(drop_speaker_prefix(c, mode)))


def to_ascii(c) -> Column:
    """Map dashes, quotes and white space, then delete all other non-ASCII."""
    src = "".join(k for k, _ in fixed.CHAR_MAP)
    dst = "".join(v for _, v in fixed.CHAR_MAP)
    return _sub(F.translate(_col(c), src, dst), r"[^\x00-\x7F]", "")


def _branches(words) -> str:
    """``words`` as nested alternatives, one for each next character."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    out = [c + ("" if ws == [""] else _branches(ws)) for c, ws in tails.items()]
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def contraction_pattern(mapping=None) -> str:
    keys = (fixed.CONTRACTIONS if mapping is None else mapping).keys()
    return r"\b(" + "|".join(keys) + r")\b"


def contraction_search(mapping=None) -> str:
    """What :func:`contraction_pattern` finds. Plain words of which none begins another are asked for by
    their characters in turn: a position costs a look at one character, not at every word."""
    keys = list((fixed.CONTRACTIONS if mapping is None else mapping).keys())
    plain = bool(keys) and all(re.fullmatch("[A-Za-z][A-Za-z' ]*", k) for k in keys)
    if not plain or any(a != b and b.startswith(a) for a in keys for b in keys):
        return contraction_pattern(mapping)
    first = "".join(sorted({k[0] for k in keys}))
    return rf"(?=[{first}])\b({_branches(keys)})\b"


def expand_contractions(c, mapping=None) -> Column:
    """Expand contractions, case-sensitive whole words, one space after each.

    The text is split at the matches and re-joined with the looked-up words, so
    the cost is one regular expression and not one per contraction.
    """
    mapping = fixed.CONTRACTIONS if mapping is None else mapping
    pattern = contraction_search(mapping)
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])

    def expand(c):
        joined = F.array_join(
            F.zip_with(
                F.split(c, pattern, -1),
                F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
                lambda p, h: F.concat(
                    p, F.coalesce(F.concat(F.element_at(table, h), F.lit(" ")), F.lit(""))
                ),
            ),
            "",
        )
        return F.when(c.rlike(pattern), joined).otherwise(c)

    return _sub(_once(c, expand), " +", " ")


def drop_links(c) -> Column:
    return _sub(c, r"http\S+", " ")


def _emoji_class() -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fixed.EMOJI_RANGES) + "]+"


def replace_entities(c, ents) -> Column:
    """Replace every occurrence of an entity's text by its placeholder.

    ``ents`` is ``array<struct<label, text>>`` of the same row.
    """
    c, ents = _col(c), _col(ents)
    kept = F.filter(
        ents, lambda e: e["label"].isin(fixed.NUMERIC_ENTITY_LABELS + ["DATE", "TIME"])
    )
    folded = F.aggregate(
        kept,
        c,
        lambda t, e: F.replace(
            t,
            e["text"],
            F.when(e["label"].isin("DATE", "TIME"), e["label"]).otherwise(F.lit("NUMBER")),
        ),
    )
    return F.coalesce(folded, c)


def placeholders(c, ents=None, numbers_last: bool = False) -> Column:
    """Emoji, numbers, dates and times become ``EMOJI NUMBER DATE TIME``.

    Bare numbers go first, which leaves little for the date and time patterns;
    ``numbers_last=True`` runs them after those.
    """
    out = _sub(c, _emoji_class(), "EMOJI")
    if not numbers_last:
        out = _sub(out, fixed.BARE_NUMBER, "NUMBER")
    if ents is not None:
        out = replace_entities(out, ents)
    for pattern, name in (
        (fixed.YEAR_PERIOD, "DATE"),
        (fixed.NUMERIC_DATE, "DATE"),
        (fixed.CLOCK_TIME, "TIME"),
    ):
        out = _sub(out, pattern, name)
    return _sub(out, fixed.BARE_NUMBER, "NUMBER") if numbers_last else out


def final_cleanup(c) -> Column:
    """Drop HTML tags and e-mail addresses, tidy the white space."""
    out = _sub(c, r"<[^\n]*?>", "")
    # Possessive: a word without "@" is given up without backtracking.
    out = _sub(out, r"[^\s@]*+@\S*\s?", "")
    out = _sub(out, r"\s+\.\n?$", ".")
    return _sub(strip(out), r"\s+", " ")


def drop_entity_label(c) -> Column:
    return _sub(c, r"ENTITY\s*:\s*", "")


SPEAKER_TAG = r"\[(SPEAKER|INTERVIEWER|INTERVIEWED)([1-9]|1[0-5])?\]"


def speaker_tags(c) -> Column:
    """Bracketed speaker tags become ``ENTITY``."""
    return _sub(c, SPEAKER_TAG, "ENTITY")


def mask_words(c, words=None, mask: str = "[ENTITY]", ignore_case: bool = True) -> Column:
    """Replace extra entity words literally."""
    words = fixed.EXTRA_ENTITIES if words is None else words
    if ignore_case:
        pattern = "(?i)" + "|".join(re.escape(w) for w in words)
        return _sub(c, pattern, mask)
    return drop_strings(c, words, mask)


# Step name -> function, in the fixed order of application.
STEPS = {
    "known_strings": drop_strings,
    "brackets": drop_brackets,
    "parentheses": drop_parentheses,
    "leading": strip_leading,
    "timestamps": drop_timestamps,
    "ascii": to_ascii,
    "contractions": expand_contractions,
    "links": drop_links,
    "placeholders": placeholders,
    "cleanup": final_cleanup,
}

BODY_STEPS = ("known_strings", "brackets", "ascii", "contractions", "links", "cleanup")
TITLE_STEPS = ("brackets", "ascii", "cleanup")


def clean_text(c, steps=BODY_STEPS, **options) -> Column:
    """Apply the named steps; the order is that of ``STEPS``, not of ``steps``.

    ``options`` maps a step name to a dict of keyword arguments for it.
    """
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    out = _col(c)
    for name, step in STEPS.items():
        if name in steps:
            out = step(out, **options.get(name, {}))
    return out
