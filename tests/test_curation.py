import random

from pyspark.sql import functions as F

from rostrum.operators import curate, lookup, ordered, segment, topic


def labelled(spark, n, share=0.75, seed=1):
    rnd = random.Random(seed)
    rows = [(i, "a" if rnd.random() < share else "b", rnd.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, label string, v int")


def test_numbering_matches_brute_force(spark):
    rows, df = labelled(spark, 700)
    got = {r.id: r.n for r in ordered.numbered(df, [F.desc("v"), "id"][1:], "label").collect()}
    for lab in "ab":
        ids = sorted(r[0] for r in rows if r[1] == lab)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_numbering_with_null_class_and_ties(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i // 4) for i in range(60)], "id int, c string, v int")
    got = ordered.numbered(df, ["v", "id"], "c", "n", "_size").collect()
    for c in (None, "x"):
        part = sorted((r.v, r.id, r.n, r.n_size) for r in got if r.c == c)
        assert [p[2] for p in part] == list(range(1, len(part) + 1))
        assert {p[3] for p in part} == {len(part)}


def test_running_totals_global(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = ordered.running_totals(df, {"s": F.col("v")}, "id").collect()
    want, total = {}, 0
    for i in range(1000):
        total += i % 7
        want[i] = total
    assert {r.id: r.s for r in got} == want


def test_quantiles_match_interpolation(spark):
    rnd = random.Random(3)
    rows = [("g" if i % 4 else "h", float(rnd.randrange(30))) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r.k: r for r in ordered.quantiles(df, "k", "value", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    for k in "gh":
        xs = sorted(v for g, v in rows if g == k)
        for name, q in (("q1", 0.25), ("m", 0.5), ("q3", 0.75)):
            p = q * (len(xs) - 1)
            lo, hi = xs[int(p)], xs[min(int(p) + 1, len(xs) - 1)]
            assert abs(got[k][name] - (lo + (hi - lo) * (p - int(p)))) < 1e-9


def test_dedupe_keeps_first_and_is_unique(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, text string")
    assert sorted((r.id, r.text) for r in curate.dedupe(df).collect()) == [(1, "x"), (2, "y")]


def test_balance_and_splits(spark):
    rows, df = labelled(spark, 333)
    out = curate.balance(df, "label", ["a", "b"], "id").groupBy("label").count().collect()
    assert len({r["count"] for r in out}) == 1
    same = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    assert curate.balance(same, "label", ["a", "b"], "id").count() == 2
    parts = curate.stratified_split(df, "label", "id").collect()
    assert sorted(r.id for r in parts) == [r[0] for r in rows]
    for lab in "ab":
        ids = sorted(r[0] for r in rows if r[1] == lab)
        n = len(ids)
        cut = int(n * 0.8)
        want = ["train"] * cut + ["validation"] * int(n * 0.1)
        want += ["test"] * (n - len(want))
        assert [r.split for r in sorted(parts, key=lambda r: r.id) if r.label == lab] == want


def test_random_split_is_stable_and_complete(spark):
    _, df = labelled(spark, 200)
    a = {r.id: r.split for r in curate.random_split(df, "label").collect()}
    b = {r.id: r.split for r in curate.random_split(df.repartition(7), "label").collect()}
    assert a == b and len(a) == 200


def test_fixed_test_split_ids_run_over_parts(spark):
    _, df = labelled(spark, 90)
    out = curate.fixed_test_split(df, "label", ["b", "a"], "id", 10).collect()
    assert sorted(r.new_id for r in out) == list(range(1, 91))
    rank = {"train": 0, "validation": 1, "test": 2}
    order = [(rank[r.split], "ba".index(r.label), r.id) for r in sorted(out, key=lambda r: r.new_id)]
    assert order == sorted(order)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    out = curate.minmax_scale(df, df, ["x", "c"]).collect()
    assert [(r.x, r.c) for r in out] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_first_match_without_hit_is_null(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("9",)], "id string")
    a = spark.createDataFrame([("1", "a")], "id string, name string")
    b = spark.createDataFrame([("1", "b"), ("2", "b")], "id string, name string")
    out = {r.id: r.name for r in lookup.first_match(ids, [a, b]).collect()}
    assert out == {"1": "a", "2": "b", "9": None}


def windows(spark, sizes, low, high):
    text = " ".join(" ".join(["w"] * (n - 1)) + "." for n in sizes)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r.n_tokens for r in segment.windows(df, "id", "text", low, high).orderBy("window_i").collect()]


def test_window_packing(spark):
    assert windows(spark, [5, 5, 5], 8, 12) == [10]
    assert windows(spark, [5, 5, 9], 8, 12) == [10, 9]
    assert windows(spark, [3, 11, 4], 8, 12) == [11]
    assert windows(spark, [20, 5, 5], 8, 12) == [20, 10]


def test_pairs_by_join_and_by_array_agree(spark):
    roles = ["beginning", "inside", "beginning", "outside", "inside", "outside", "outside"]
    rows = [("p", i, f"s{i}", r) for i, r in enumerate(roles)]
    flat = spark.createDataFrame(rows, "passage_id string, i int, sentence string, role string")
    got = sorted((r.i, r.label) for r in topic.sentence_pairs(flat).collect())
    assert got == [(0, "continue"), (1, "continue"), (2, "not_continue"), (3, "not_continue"), (4, "not_continue")]
    nested = flat.groupBy("passage_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence", "role"))), lambda x: F.struct(x["sentence"], x["role"])).alias("text")
    )
    assert sorted((r.i, r.label) for r in topic.array_pairs(nested).collect()) == got


def test_pairs_keep_columns(spark):
    from rostrum.operators import topic

    rows = [("p", 0, "a", "beginning", "ann"), ("p", 1, "b", "inside", "ann"), ("p", 2, "c", "outside", "ann")]
    df = spark.createDataFrame(rows, "passage_id string, i int, sentence string, role string, annotator string")
    got = topic.sentence_pairs(df, keep=["annotator"]).orderBy("i").collect()
    assert [(r.annotator, r.s1, r.label) for r in got] == [("ann", "a", "continue"), ("ann", "b", "not_continue")]
    arrays = df.groupBy("passage_id", "annotator").agg(F.expr("array_sort(collect_list(struct(i, sentence, role)))").alias("text"))
    got = topic.array_pairs(arrays, keep=["annotator"]).orderBy("i").collect()
    assert [(r.annotator, r.s1, r.label) for r in got] == [("ann", "a", "continue"), ("ann", "b", "not_continue")]


def test_numbering_over_more_ranges_than_partitions(spark, monkeypatch):
    from rostrum.operators import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 20)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordered.numbered(df, ["k"]).filter("n != k + 1").count()
    assert got == 0
