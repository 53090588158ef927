"""Quality: the model and its thresholds come from all trusted documents."""

from pyspark.sql import functions as F

from rostrum.llm import kneser, quality


def test_no_trusted_document_is_left_out(spark, monkeypatch):
    n = 20_400
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a b c w"), F.col("id") % 50).alias("text"), F.lit("en").alias("lang")
    )
    counted = {}
    train, score = kneser.train, kneser.score
    monkeypatch.setattr(kneser, "train", lambda d, *a: counted.update(trained=d.count()) or train(d, *a))
    monkeypatch.setattr(kneser, "score", lambda d, *a: counted.setdefault("held", d.count()) and score(d, *a))
    out = quality.judge(rows, rows.select("doc_id")).agg(F.count("*"), F.countDistinct("threshold"), F.max("threshold")).first()
    assert counted["trained"] + counted["held"] == n and out[:2] == (n, 1)
    want = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(4)) != 0
    assert counted["trained"] == rows.filter(want).count()
    # The threshold is the exact quantile over the held-out quarter.
    model = train(rows.filter(want), "text")
    held = score(rows.filter(~want).select("text", "lang"), model, "text")
    exact = held.agg(F.percentile(quality.log_perplexity(), F.lit(quality.QUANTILE))).first()[0]
    assert abs(out[2] - exact) < 1e-12
