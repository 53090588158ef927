"""Dedupe, balance, split, scale, set operations, lookups, sources."""

import uuid

from pyspark.sql import functions as F

from rostrum.catalog.base import LABELLED_SQL, Tables, labelled, q, query, rounded, sents_sql, doc_sentences
from rostrum.functions import text as T
from rostrum.operators import curate, lookup, stats
from rostrum.sources import tables
from rostrum.streaming import resume


def small(t):
    """Class and size of the labelled documents; the texts are not needed."""
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


@query("ds01_dedupe", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def ds01(t):
    return curate.dedupe(t.documents.select("doc_id", "text"), "text", "doc_id")


RANKED = f"SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM {LABELLED_SQL}"


@query(
    "ds02_balance",
    f"SELECT doc_id, quality FROM ({RANKED}) WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))",
)
def ds02(t):
    return curate.balance(small(t), "quality", [1, 0], ["n_chars", "doc_id"]).select("doc_id", "quality")


SPLIT = """CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train'
  WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END"""


@query("ds03_stratified_split", f"SELECT doc_id, quality, {SPLIT} AS split FROM ({RANKED})")
def ds03(t):
    return curate.stratified_split(small(t), "quality", ["n_chars", "doc_id"]).select("doc_id", "quality", "split")


@query("ds04_two_way_split", f"SELECT doc_id, quality, CASE WHEN {SPLIT} = 'train' THEN 'train' ELSE 'test' END AS split FROM ({RANKED})")
def ds04(t):
    return curate.two_way_split(small(t), "quality", ["n_chars", "doc_id"]).select("doc_id", "quality", "split")


@query(
    "ds05_fixed_test_split",
    f"""SELECT doc_id, quality, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, quality DESC, r) AS new_id
    FROM (SELECT *, CASE WHEN r <= 20 THEN 'test' WHEN r <= 20 + floor((n - 20) * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM ({RANKED}))""",
)
def ds05(t):
    return curate.fixed_test_split(small(t), "quality", [1, 0], ["n_chars", "doc_id"], 20).select(
        "doc_id", "quality", "split", "new_id"
    )


def seeded(rows: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
    count(*) OVER (PARTITION BY quality) AS n FROM {rows}"""


BALANCED = f"""(SELECT doc_id, quality FROM ({seeded(LABELLED_SQL)})
  WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM {LABELLED_SQL} GROUP BY quality)))"""


@query("ds06_balanced_random_split", f"SELECT doc_id, quality, {SPLIT} AS split FROM ({seeded(BALANCED)})")
def ds06(t):
    return curate.balanced_random_split(small(t), "quality", [1, 0], "doc_id").select("doc_id", "quality", "split")


@query("ds07_random_split", f"SELECT doc_id, quality, {SPLIT} AS split FROM ({seeded(LABELLED_SQL)})")
def ds07(t):
    return curate.random_split(small(t), "quality", "doc_id").select("doc_id", "quality", "split")


@query(
    "ds08_seeded_shuffle",
    "SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents",
)
def ds08(t):
    from rostrum.operators import ordered

    return ordered.numbered(t.documents.select("doc_id", "lang"), curate.seeded_key("doc_id"), (), "place")


@query(
    "ds09_concat",
    """SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark
    UNION ALL SELECT conv_id, text, NULL FROM conversations""",
)
def ds09(t):
    return curate.concat(
        t.documents.select(F.col("doc_id").alias("id"), "text", "lang"),
        t.benchmark.select(F.col("item_id").alias("id"), "text"),
        t.conversations.select(F.col("conv_id").alias("id"), "text"),
    )


@query("ds10_common", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def ds10(t):
    return curate.common(t.documents, t.labels.filter("toxic = 0"), "doc_id")


@query("ds10_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def ds10_diff(t):
    return curate.difference(t.documents, t.labels, "doc_id")


@query("ds11_sort", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def ds11(t):
    return t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy(
        "o_orderpriority", F.desc("o_totalprice"), "o_orderkey"
    )


@query(
    "ds12_renumber",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) AS new_id FROM orders",
)
def ds12(t):
    return curate.renumber(t.orders, ["o_orderstatus", "o_totalprice", "o_orderkey"]).select("o_orderkey", "new_id")


@query(
    "ds13_minmax_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - lo1) / (hi1 - lo1), 6) AS l_quantity,
      round((l_extendedprice - lo2) / (hi2 - lo2), 6) AS l_extendedprice, 0.0 AS flat
    FROM lineitem, (SELECT min(l_quantity) AS lo1, max(l_quantity) AS hi1, min(l_extendedprice) AS lo2, max(l_extendedprice) AS hi2
      FROM lineitem WHERE l_returnflag = 'A') WHERE l_returnflag <> 'A'""",
)
def ds13(t):
    li = t.lineitem.withColumn("flat", F.lit(3.0))
    test = li.filter(F.col("l_returnflag") != "A")
    out = curate.minmax_scale(
        li.filter(F.col("l_returnflag") == "A"), test, ["l_quantity", "l_extendedprice", "flat"]
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "flat"))


@query(
    "ds14_build_pool",
    f"""SELECT min(doc_id) AS id, text, arg_min(lang, doc_id) AS target FROM documents
    WHERE text NOT IN (SELECT text FROM {LABELLED_SQL}) GROUP BY text""",
)
def ds14(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("issue"))
    return curate.build_pool(docs, labelled(t))


@query(
    "ds15_class_weights",
    f"""SELECT doc_id, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * n), 6) AS weight
    FROM (SELECT doc_id, count(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
def ds15(t):
    return rounded(curate.class_weights(t.labels, "quality").select("doc_id", "weight"))


# --- joins ------------------------------------------------------------------------


@query("jn01_exclude_texts", f"SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM {LABELLED_SQL})")
def jn01(t):
    return curate.exclude(t.documents.select("doc_id", "text"), labelled(t), "text").select("doc_id")


@query("jn02_exclude_ids", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn02(t):
    return curate.exclude(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("jn03_only_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn03(t):
    return curate.only(t.documents.select("doc_id", "lang"), t.labels.filter("quality = 1"), "doc_id")


@query(
    "jn04_transfer_labels",
    f"SELECT DISTINCT d.doc_id, l.quality FROM documents d JOIN {LABELLED_SQL} l ON d.text = l.text",
)
def jn04(t):
    return lookup.transfer_labels(
        t.documents.select("doc_id", "text"), labelled(t), "text", "quality"
    ).select("doc_id", "quality")


@query("jn05_attach", "SELECT doc_id, lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def jn05(t):
    return lookup.attach(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id").select(
        "doc_id", "lang", "source", "quality"
    )


@query(
    "jn06_attach_two_hops",
    """SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
)
def jn06(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    out = lookup.attach_two_hops(
        rows, t.orders.select("o_orderkey", "o_custkey"),
        t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_orderkey", "o_custkey",
    )
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment")


@query(
    "jn07_first_match",
    """SELECT user_id AS id, CASE WHEN n_name IS NOT NULL THEN n_name WHEN s_name IS NOT NULL THEN s_name ELSE c_name END AS name,
      CASE WHEN n_name IS NOT NULL THEN 0 WHEN s_name IS NOT NULL THEN 1 WHEN c_name IS NOT NULL THEN 2 END AS source_rank, event_id
    FROM events LEFT JOIN nation ON user_id = n_nationkey LEFT JOIN supplier ON user_id = s_suppkey LEFT JOIN customer ON user_id = c_custkey""",
)
def jn07(t):
    found = [
        t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    ]
    return lookup.first_match(t.events.select(F.col("user_id").alias("id"), "event_id"), found)


@query(
    "jn14_frame_rules",
    f"""WITH f AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS ws FROM documents),
r AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT lower(split_part(text, ' ', 1)) FROM benchmark)
SELECT doc_id, arg_min(w, p) AS main_frame, string_agg(DISTINCT w, ',' ORDER BY w) AS matched_frames
FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM f) JOIN r ON w = name GROUP BY doc_id""",
)
def jn14(t):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    docs = t.texts.select(
        "doc_id", F.transform(words, lambda w: F.struct(w.alias("frame"), F.array(w).alias("denotations"))).alias("frames")
    )
    first = t.benchmark.select(F.lower(F.element_at(F.split("text", " "), 1)).alias("name"))
    rules = t.nation.select(F.lower("n_name").alias("name")).unionByName(first)
    return lookup.frame_rule_matches(docs, rules).select(
        "doc_id", "main_frame", F.array_join("matched_frames", ",").alias("matched_frames")
    )


# --- sources ------------------------------------------------------------------------


@query(
    "io06_sentences_to_records",
    f"WITH {sents_sql()} SELECT id, sentence || '.' AS text FROM sents WHERE len(regexp_extract_all(sentence, '{T.TOKEN}')) <= 50",
)
def io06(t):
    return tables.sentences_to_records(doc_sentences(t), "id", "sentence")


@query("io08_scan", "SELECT page_id, url FROM pages")
def io08(t):
    return tables.scan(t.pages.select("page_id", "url"))


@query("io08_scan_limit", "SELECT least(25, count(*)) AS n, 0 AS strangers FROM pages")
def io08_limit(t):
    some = tables.scan(t.pages.select("page_id", "url"), 25)
    known = t.pages.select("page_id", "url", F.lit(1).alias("known")).distinct()
    return some.join(known, ["page_id", "url"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("strangers")
    )


@query(
    "io11_upsert",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def io11(t):
    new = t.supplier.select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    return lookup.upsert(t.customer.select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey")


@query(
    "io13_matrix_rows",
    """SELECT f1 AS "column", f2 AS "row", corr FROM (SELECT 'l_quantity' AS f1, 'l_tax' AS f2, round(corr(l_quantity, l_tax), 3) AS corr FROM lineitem
    UNION ALL SELECT 'l_tax', 'l_quantity', round(corr(l_quantity, l_tax), 3) FROM lineitem)""",
)
def io13(t):
    long = stats.correlations(t.lineitem.withColumn("_all", F.lit(1)), "_all", ["l_quantity", "l_tax"])
    return tables.matrix_rows(long).select("column", F.explode("values").alias("row", "corr"))


@query("io14_day_string", "SELECT event_id, strftime(ts, '%d-%m-%Y') AS day FROM events")
def io14(t):
    return t.events.select("event_id", T.day_string("ts").alias("day"))


@query("io15_unprocessed", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def io15(t):
    done = t.supplier.select(F.col("s_suppkey").alias("user_id"))
    return resume.unprocessed(t.events.select("event_id", "user_id"), done, "user_id")


@query("io15_resumed_stream", "SELECT event_id, user_id, event_type FROM events WHERE user_id % 3 <> 0")
def io15_stream(t):
    """The files of the table as a stream; a second start finds nothing new and adds nothing."""
    folder = f"{resume.shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        resume.process_new(
            # A pattern: the table may be one file or a folder of files.
            t.spark, f"{t.folder}/events.parque[t]", t.events.schema,
            lambda new: new.filter("user_id % 3 <> 0").select("event_id", "user_id", "event_type"),
            f"{folder}/rows", f"{folder}/checkpoint", "parquet",
        )
    return t.spark.read.parquet(f"{folder}/rows").select("event_id", "user_id", "event_type")


@query("io_parse_literal", "SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events")
def io_literal(t):
    cell = F.replace("props", F.lit('"'), F.lit("'"))
    return t.events.select("event_id", tables.parse_literal(cell, "k BIGINT").alias("_p")).select("event_id", "_p.k")
