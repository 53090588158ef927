import json
import os

from pyspark.sql import functions as F

from rostrum.operators import evaluate, models
from rostrum.plans import continuity, discourse, stances
from rostrum.sources import tables
from rostrum.streaming import resume


def test_jsonl_round_trip_and_unstable_ids(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text('{"id": 5847, "true_label": "a", "predicted_label": "b"}\n{"id": "0000003114", "true_label": "a"}\n')
    df = tables.read_jsonl(spark, str(src), "predictions")
    assert [(r.id, r.predicted_label) for r in df.collect()] == [("5847", "b"), ("0000003114", None)]
    out = str(tmp_path / "out")
    tables.write_jsonl(df, out)
    tables.write_jsonl(df.limit(1), out, "append")
    assert tables.read_jsonl(spark, out, "predictions").count() == 3


def test_whole_json_lines_and_sheets(spark, tmp_path):
    doc = tmp_path / "f.json"
    doc.write_text(json.dumps([{"frame": "Help", "lu": "x", "denotations": [{"id": 1, "obj": "Help", "span": {"begin": 0, "end": 4}}]}], indent=1))
    row = tables.read_json(spark, str(doc), "frames").first()
    assert row.frame == "Help" and row.denotations[0].obj == "Help"
    tables.write_lines(spark.range(3), "id", str(tmp_path / "ids"))
    assert sorted(r.id for r in tables.read_lines(spark, str(tmp_path / "ids"), "id").collect()) == ["0", "1", "2"]
    sheet = spark.createDataFrame([("1", 'a "b",\nc')], "id string, text string")
    tables.write_sheet(sheet, str(tmp_path / "sheet"))
    back = tables.read_sheet(spark, str(tmp_path / "sheet"))
    assert back.dtypes == [("id", "string"), ("text", "string")] and back.first().text == 'a "b",\nc'


def test_named_tables_and_attributions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, x int")
    tables.write_tables(df, "label", str(tmp_path / "t"))
    assert sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("label=")) == ["label=a", "label=b"]
    att = spark.createDataFrame([("w", 0.5)], "feature string, value double")
    tables.write_attributions(att, str(tmp_path / "att"))
    assert tables.read_attributions(spark, str(tmp_path / "att")).first() == ("w", 0.5)


def test_upsert_table(spark, tmp_path):
    old = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    tables.upsert_table(old, spark.createDataFrame([("2", "z")], "id string, v string"), str(tmp_path / "u"))
    assert sorted(spark.read.parquet(str(tmp_path / "u")).collect()) == [("1", "x"), ("2", "z")]


def test_literals_are_parsed_not_run(spark):
    df = spark.createDataFrame([("[{'kind': 'lexical'}]",), ("__import__('os')",)], "c string")
    out = [r[0] for r in df.select(tables.parse_literal("c", "array<struct<kind:string>>")).collect()]
    assert out[0][0].kind == "lexical" and out[1] is None


def test_resume_reads_only_new_files(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    os.mkdir(src)
    schema = "id string, text string"
    step = lambda df: df.withColumn("n", F.length("text"))
    for k in range(2):
        with open(f"{src}/{k}.json", "w") as f:
            f.write(json.dumps({"id": str(k), "text": "x" * k}) + "\n")
        resume.process_new(spark, src, schema, step, out, cp)
    assert sorted((r.id, r.n, r.batch) for r in spark.read.parquet(out).collect()) == [("0", 0, 0), ("1", 1, 1)]


def test_checkpoint_uses_the_shared_folder(spark):
    assert resume.cut_lineage(spark.range(3)).count() == 3


def test_text_classifier_learns_and_reloads(spark, tmp_path):
    rows = [(i, ("tax cut " if i % 2 else "health care ") + f"w{i}", "support" if i % 2 else "oppose") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    names = {"oppose": 0, "support": 1}
    model = models.train_text(df, names, features=256)
    models.save(model, str(tmp_path / "m"))
    scored = models.score_text(models.PipelineModel.load(str(tmp_path / "m")), df, names, ("id", "label"))
    assert evaluate.misclassified(scored).count() == 0


def test_logit_recovers_odds(spark):
    # 30 of 40 hits at x = 1 and 10 of 40 at x = 0: the odds ratio is 9.
    rows = [(float(x), int(k < (30 if x else 10))) for x in (0, 1) for k in range(40)]
    table, fit = models.logit_table(spark.createDataFrame(rows, "x double, y int"), "y", ["x"])
    x = table.filter("term = 'x'").first()
    assert abs(x.odds_ratio - 9.0) < 1e-4 and x.ci_low < x.coef < x.ci_high and x.p < 0.001
    assert 0.18 < fit.first().pseudo_r2 < 0.19


def test_plans_run_end_to_end(spark):
    docs = spark.createDataFrame(
        [(str(i), f"We will cut taxes. {'Yes it is done slowly.' if i % 2 else 'Costs rose.'} Thus he was {i} happy.", "s" if i % 2 else "o") for i in range(8)],
        "id string, text string, label string",
    )
    out = discourse.full_tests(docs, "label", ("s", "o"))
    assert out.count() == 10 and "reject_bh" in out.columns
    lex = spark.createDataFrame([("positive", "ADV", "slowly"), ("pro", "VERB", "cut")], "category string, pos string, entry string")
    bits = stances.document_bits(docs, lex)
    assert {r.id: r.positive_affect for r in bits.collect()} == {str(i): i % 2 for i in range(8)}
    passages = spark.createDataFrame(
        [("p", [("We cut taxes.", "beginning"), ("Taxes are low.", "inside"), ("But Ann left.", "outside")])],
        "passage_id string, text array<struct<sentence:string,role:string>>",
    )
    pairs, summary = continuity.label_passages(passages)
    assert {r.i: r.rule_label for r in pairs.collect()} == {0: "continue", 1: "not_continue"}
    assert summary.first().accuracy == 1.0


def test_scan_takes_a_limit(spark):
    df = spark.range(50)
    assert tables.scan(df).count() == 50 and tables.scan(df, 7).count() == 7


def test_shared_folder_follows_the_session(spark):
    folder = resume.shared_folder(spark)
    assert folder == resume.shared_folder(spark) and not folder.endswith("/")
