"""The end-to-end query: documents, classes, cleaning, features, test."""

from pyspark.sql import functions as F

from rostrum.catalog.base import LABELLED_SQL, Tables, labelled, query, rounded, sents_sql, toks_sql
from rostrum.plans import discourse

CLEAN = r"""(SELECT doc_id, quality, regexp_replace(trim(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(translate(regexp_replace(text, '\([^\n]*?\)|\[[^\n]*?\]', '', 'g'),
    chr(8203) || chr(8211) || chr(8212) || chr(8217) || chr(8216) || chr(34) || chr(9) || chr(13) || chr(160),
    ' --''''    '), '[^\x00-\x7F]', '', 'g'), 'http[^\s]+', ' ', 'g'),
  '[^\s]*@[^\s]*\s?', '', 'g'), '[ \t\r\f]+', ' ', 'g')), ' +', ' ', 'g') AS text
  FROM """ + LABELLED_SQL + ")"


@query(
    "flagship_discourse_t_tests",
    f"""
WITH {sents_sql(CLEAN, extra="quality")},{toks_sql("quality")},
s AS (SELECT id, quality, sent_i,
    count(*) FILTER (WHERE regexp_full_match(text, '\\p{{L}}+')) AS words,
    sum(length(text)) FILTER (WHERE regexp_full_match(text, '\\p{{L}}+')) AS chars,
    count(*) FILTER (WHERE lower(text) IN ('i','me','my','mine','you','your','yours','he','him',
      'his','she','her','hers','it','its','we','us','our','ours','they','them','their','theirs')) AS pron
  FROM toks GROUP BY ALL),
d AS (SELECT id, quality, CAST(count(*) AS DOUBLE) AS sentences, avg(words) AS sentence_length,
    sum(chars) / sum(words) AS word_length, avg(pron) AS personal_pronoun_d
  FROM s WHERE words > 0 GROUP BY id, quality),
l AS (UNPIVOT d ON sentences, sentence_length, word_length, personal_pronoun_d INTO NAME feature VALUE value),
g AS (SELECT feature,
    count(*) FILTER (WHERE quality = 1) AS n1, avg(value) FILTER (WHERE quality = 1) AS m1,
    var_samp(value) FILTER (WHERE quality = 1) AS v1,
    count(*) FILTER (WHERE quality = 0) AS n2, avg(value) FILTER (WHERE quality = 0) AS m2,
    var_samp(value) FILTER (WHERE quality = 0) AS v2
  FROM l GROUP BY feature)
SELECT feature, n1, round(m1, 6) AS mean1, round(sqrt(v1), 6) AS sd1,
  n2, round(m2, 6) AS mean2, round(sqrt(v2), 6) AS sd2,
  round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df
FROM g""",
)
def flagship(t: Tables):
    docs = labelled(t).select("doc_id", "text", "quality")
    return rounded(discourse.quick_tests(docs, "doc_id", "text", "quality", (1, 0), p=False))
