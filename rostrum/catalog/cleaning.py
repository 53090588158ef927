"""Cleaning, labels, ids, lists and URLs."""

from pyspark.sql import functions as F

from rostrum.catalog.base import Tables, q, query, sql_list
from rostrum.functions import clean, fixed
from rostrum.functions import text as T

# The texts hold no links, brackets or contractions: they are put in front of each one.
FRONT = (
    "(Applause) [Laughter] AboutSearch Well, don't go, I've said he'll wait – it’s late "
    "[00:12:34] [SPEAKER1] : ENTITY : in the 1990s on 01/02/2000 at 12:34 PM see http://x.org/a HIV covid "
    "<b>x</b> a.b@c.de "
)


def fronted(t: Tables):
    return t.texts.select(
        "doc_id",
        F.concat(F.lit(FRONT), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"), F.lit(" .")).alias("text"),
    )


SOURCE = f"(SELECT doc_id, {q(FRONT)} || CAST(doc_id AS VARCHAR) || ' ' || text || ' .' AS text FROM documents)"


def sub(c: str, pattern: str, to: str, flags="g") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, {q(flags)})"


def replaces(c: str, words, to=" ") -> str:
    for w in words:
        c = f"replace({c}, {q(w)}, {q(to)})"
    return c


SQL = {
    "known_strings": lambda c: replaces(c, fixed.BOILERPLATE),
    "brackets": lambda c: sub(c, r"\([^\n]*?\)|\[[^\n]*?\]", ""),
    "parentheses": lambda c: sub(c, r"\([^\n]*?\)", ""),
    "timestamps": lambda c: sub(c, r"[\[\(]\d{1,2}:\d{2}:\d{2}[\]\)]", ""),
    "ascii": lambda c: sub(
        "translate(" + c + ", chr(8203)||chr(8211)||chr(8212)||chr(8217)||chr(8216)||chr(10)||chr(34)"
        "||chr(9)||chr(13)||chr(160), ' --''''     ')", r"[^\x00-\x7F]", ""),
    "contractions": lambda c: sub(
        "array_to_string(list_transform(list_zip("
        f"string_split_regex({c}, {q(clean.contraction_pattern())}), "
        f"regexp_extract_all({c}, {q(clean.contraction_pattern())}, 0)), "
        "lambda x: x[1] || coalesce(map {"
        + ", ".join(f"{q(k)}: {q(v)}" for k, v in fixed.CONTRACTIONS.items())
        + "}[x[2]] || ' ', '')), '')", " +", " "),
    "links": lambda c: sub(c, r"http\S+", " "),
    "cleanup": lambda c: sub(
        sub(sub(sub(sub(c, r"<[^\n]*?>", ""), r"\S*@\S*\s?", ""), r"\s+\.\n?$", "."), r"^\s+|\s+$", ""),
        r"\s+", " "),
}


def chain(*steps) -> str:
    c = "text"
    for s in steps:
        c = SQL[s](c)
    return f"SELECT doc_id, {c} AS text FROM {SOURCE}"


def cleaned(t: Tables, column):
    return fronted(t).select("doc_id", column.alias("text"))


@query("tx00_clean_text", chain("known_strings", "brackets", "ascii", "contractions", "links", "cleanup"))
def tx00(t):
    return cleaned(t, clean.clean_text("text"))


@query("tx01_known_strings", chain("known_strings"))
def tx01(t):
    return cleaned(t, clean.drop_strings("text"))


@query("tx02_brackets", chain("brackets"))
def tx02(t):
    return cleaned(t, clean.drop_brackets("text"))


@query("tx03_parentheses", chain("parentheses"))
def tx03(t):
    return cleaned(t, clean.drop_parentheses("text"))


@query("tx04_timestamps", chain("timestamps"))
def tx04(t):
    return cleaned(t, clean.drop_timestamps("text"))


@query("tx05a_speaker_prefix", f"SELECT doc_id, {sub('text', r'^[^:]*:\s?', '')} AS text FROM {SOURCE}")
def tx05a(t):
    return cleaned(t, clean.drop_speaker_prefix("text", "reference"))


# A closing bracket was never opened where the running balance falls below all before it.
UNOPENED = f"""WITH src AS (SELECT doc_id, 'a (b) c] d) ' || text AS text FROM documents),
ch AS (SELECT doc_id, i, substr(text, i, 1) AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM src) WHERE substr(text, i, 1) IN ('(', ')', '[', ']')),
bal AS (SELECT doc_id, i, c, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS r, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS s
  FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
low AS (SELECT doc_id, i, c, r, s, least(0, min(r) OVER p) AS r0, least(0, min(s) OVER p) AS s0 FROM bal
  WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT doc_id, max(i) AS place FROM low WHERE (c = ')' AND r < coalesce(r0, 0)) OR (c = ']' AND s < coalesce(s0, 0)) GROUP BY doc_id)
SELECT doc_id, regexp_replace(substr(text, coalesce(place, 0) + 1), '^\\s+|\\s+$', '', 'g') AS text FROM src LEFT JOIN cut USING (doc_id)"""


@query("tx05b_unopened_brackets", UNOPENED)
def tx05b(t):
    return t.documents.select(
        "doc_id", clean.drop_unopened(F.concat(F.lit("a (b) c] d) "), F.col("text"))).alias("text")
    )


MARKS = r"""^[!"#$%&'()*+,\-./:;<=>?@\\\]^_`{|}~]\s*"""


@query(
    "tx05c_leading_marks",
    "SELECT doc_id, " + sub(sub(
        f"CASE WHEN NOT starts_with(t, '[') THEN {sub('t', MARKS, '')} ELSE t END", r"^\w+\.\s", ""),
        r"^[-.,\s]+", "")
    + " AS text FROM (SELECT doc_id, '# 1. - ' || text AS t FROM documents)",
)
def tx05c(t):
    return t.documents.select(
        "doc_id", clean.drop_leading_marks(F.concat(F.lit("# 1. - "), F.col("text"))).alias("text")
    )


@query("tx06_ascii", chain("ascii"))
def tx06(t):
    return cleaned(t, clean.to_ascii("text"))


@query("tx07_contractions", chain("contractions"))
def tx07(t):
    return cleaned(t, clean.expand_contractions("text"))


@query("tx08_links", chain("links"))
def tx08(t):
    return cleaned(t, clean.drop_links("text"))


EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fixed.EMOJI_RANGES) + "]+"


@query(
    "tx09_placeholders",
    "SELECT doc_id, " + sub(sub(sub(sub(sub("text", EMOJI, "EMOJI"), fixed.BARE_NUMBER, "NUMBER"),
        r"(^|[^-0-9A-Za-z_])\d{2,4}'?s([^-0-9A-Za-z_]|$)", r"\1DATE\2"), fixed.NUMERIC_DATE, "DATE"),
        fixed.CLOCK_TIME, "TIME") + f" AS text FROM {SOURCE}",
)
def tx09(t):
    return cleaned(t, clean.placeholders("text"))


# Entities in order of their first occurrence, each replaced in the text that the one before left.
ENTITIES = """list_concat(list_transform(regexp_extract_all(text, '\\d+'), lambda x: {'l': 'NUMBER', 't': x}),
  list_transform(regexp_extract_all(text, '\\b(?:june|the)\\b'), lambda x: {'l': 'DATE', 't': x}))"""
BARE = sub(sub("text", EMOJI, "EMOJI"), fixed.BARE_NUMBER, "NUMBER")


@query(
    "tx10_entity_placeholders",
    f"""WITH src AS (SELECT doc_id, {BARE} AS bare, {ENTITIES} AS every FROM {SOURCE}),
one AS (SELECT doc_id, bare, list_filter(every, lambda x, i: list_position(every, x) = i) AS ents FROM src),
done AS (SELECT doc_id, (list_reduce(list_prepend({{'l': '', 't': bare}}, ents), lambda a, e: {{'l': '', 't': replace(a.t, e.t, e.l)}})).t AS text FROM one)
SELECT doc_id, """ + sub(sub(sub("text",
        r"(^|[^-0-9A-Za-z_])\d{2,4}'?s([^-0-9A-Za-z_]|$)", r"\1DATE\2"), fixed.NUMERIC_DATE, "DATE"), fixed.CLOCK_TIME, "TIME")
    + " AS text FROM done",
)
def tx10(t):
    from rostrum.operators.anonymize import spans_of

    ents = F.concat(spans_of("text", r"\d+", "CARDINAL"), spans_of("text", r"\b(?:june|the)\b", "DATE"))
    ents = F.transform(ents, lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))
    return fronted(t).withColumn("ents", ents).select(
        "doc_id", clean.placeholders("text", F.array_distinct("ents")).alias("text")
    )


@query("tx11_final_cleanup", chain("cleanup"))
def tx11(t):
    return cleaned(t, clean.final_cleanup("text"))


@query("tx11_final_cleanup_pages", f"SELECT page_id, {SQL['cleanup']('html')} AS text FROM pages")
def tx11_pages(t):
    return t.pages.select("page_id", clean.final_cleanup("html").alias("text"))


@query("tx12_entity_label", f"SELECT doc_id, {sub('text', r'ENTITY\s*:\s*', '')} AS text FROM {SOURCE}")
def tx12(t):
    return cleaned(t, clean.drop_entity_label("text"))


@query("tx13_speaker_tags", f"SELECT doc_id, {sub('text', clean.SPEAKER_TAG, 'ENTITY')} AS text FROM {SOURCE}")
def tx13(t):
    return cleaned(t, clean.speaker_tags("text"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(
    "tx14_title",
    f"SELECT page_id, {SQL['cleanup'](SQL['ascii'](SQL['brackets'](TITLE)))} AS title FROM pages",
)
def tx14(t):
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", clean.clean_text(title, clean.TITLE_STEPS).alias("title"))


@query(
    "tx15_extra_words",
    "SELECT doc_id, " + sub("text", r"COVID\-19|COVID|Army|WeCanDoThis\.HHS\.gov|HIV|AIDS", "[ENTITY]", "gi")
    + " AS masked, " + replaces("text", fixed.EXTRA_ENTITIES, "[ENTITY]") + f" AS masked_exact FROM {SOURCE}",
)
def tx15(t):
    return fronted(t).select(
        "doc_id",
        clean.mask_words("text").alias("masked"),
        clean.mask_words("text", ignore_case=False).alias("masked_exact"),
    )


HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
CORE = f"""(SELECT page_id, url, string_split({HOST}, '.') AS p FROM pages)"""
CORE_EXPR = f"""array_to_string(CASE WHEN len(p) > 2 AND (length(p[-2]) = 2
  OR p[-2] IN {sql_list(fixed.SHARED_SECOND_LEVEL)}) THEN p[-3:] ELSE p[-2:] END, '.')"""


@query("tx16_host", f"SELECT page_id, {sub(HOST, '^www[.]', '')} AS host FROM pages")
def tx16(t):
    return t.pages.select("page_id", T.host("url").alias("host"))


@query("tx17_core_domain", f"SELECT page_id, {CORE_EXPR} AS domain FROM {CORE}")
def tx17(t):
    return t.pages.select("page_id", T.core_domain("url").alias("domain"))


@query(
    "tx18_padded_id",
    "SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 10, '0') || CASE WHEN quality = 1 THEN 'S' ELSE 'O' END AS id FROM labels",
)
def tx18(t):
    suffix = F.when(F.col("quality") == 1, "S").otherwise("O")
    return t.labels.select("doc_id", T.padded_id("doc_id", suffix).alias("id"))


@query(
    "tx19_comma_list",
    """SELECT p_partkey, unnest(list_transform(string_split(replace(p_name, ' ', ' , '), ','),
       lambda x: trim(x))) AS item FROM part""",
)
def tx19(t):
    return t.part.select(
        "p_partkey", F.explode(T.comma_list(F.replace("p_name", F.lit(" "), F.lit(" , ")))).alias("item")
    )


@query(
    "tx20_label_map",
    """SELECT doc_id, CASE quality WHEN 0 THEN 'monologic' WHEN 1 THEN 'dialogic' END AS label,
       CASE toxic WHEN 1 THEN 'oppose' END AS side, quality AS code FROM labels""",
)
def tx20(t):
    named = t.labels.withColumn("label", T.label_of("quality", {0: "monologic", 1: "dialogic"}))
    return named.select(
        "doc_id", "label", T.label_of("toxic", {1: "oppose"}).alias("side"),
        T.label_of("label", {"monologic": 0, "dialogic": 1}).alias("code"),
    )


@query(
    "tx21_name_list",
    """SELECT doc_id, unnest(string_split(CAST(source AS VARCHAR) || ', ' || lang, ', ')) AS name FROM documents""",
)
def tx21(t):
    both = F.concat(F.col("source"), F.lit(", "), F.col("lang"))
    return t.documents.select("doc_id", F.explode(T.name_list(both)).alias("name"))
