"""The similarity join finds every pair and compares few where vectors lie in groups."""

import numpy as np
import pytest

from rostrum.operators import similar, topic

SCHEMA = "key string, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(f"k{i}", [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def brute(x, threshold):
    x = np.asarray(x, np.float32).astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = set()
    for i in range(len(x)):
        for j in range(i):
            if norm[i] and norm[j] and x[i] @ x[j] / norm[i] / norm[j] >= threshold:
                out.add(frozenset((f"k{i}", f"k{j}")))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.75, 0.95])
def test_equals_brute_force(spark, threshold):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 8))
    x = np.concatenate([middle[rng.integers(0, 6, 90)] + rng.normal(0, 0.35, (90, 8)), rng.normal(size=(40, 8)), np.zeros((2, 8))])
    x = np.concatenate([x, x[:5] * 3])
    rows = similar.similar_pairs(table(spark, x), threshold, block=16, pivots=5).collect()
    got = [frozenset((r.a, r.b)) for r in rows]
    assert len(set(got)) == len(got) and set(got) == brute(x, threshold) and got
    for r in rows[:20]:
        a, b = (np.float32(x[int(k[1:])]).astype(float) for k in (r.a, r.b))
        assert abs(r.similarity - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-9


def test_groups_that_lie_apart_do_not_meet(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(8)[k] + rng.normal(0, 0.02, (32, 8)) for k in range(8)])
    pivots = np.eye(8)
    batches = [b for b in table(spark, x).toArrow().to_batches()]
    homes = list(similar._homes(batches, pivots))
    import pyarrow as pa

    homes = pa.Table.from_batches(homes).append_column("deal", pa.array(np.arange(256)))
    blocks = np.full(8, 2)
    met = list(similar._meetings(homes.to_batches(), pivots, np.full(8, 0.2), np.arange(8) * 2, blocks, np.sqrt(0.5)))
    # Its own two blocks only, not those of the seven other cells.
    assert sum(b.num_rows for b in met) == 256 * 2


def test_odd_vectors(spark):
    rows = [("a", None), ("b", []), ("c", [0.0, 0.0]), ("d", [1.0, None]), ("e", [float("nan"), 1.0]), ("f", [1.0, 0.0]), ("g", [2.0, 0.1]), ("h", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.a, r.b) for r in similar.similar_pairs(df, 0.75).collect()} in ({("f", "g")}, {("g", "f")})
    assert similar.similar_pairs(df.limit(0), 0.75).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(df, 0.0)


def test_sentences_meet_by_class_and_carry_no_vector(spark):
    vec = spark.createDataFrame(
        [("tax", [1.0, 0.0]), ("levy", [1.0, 0.0]), ("rise", [0.9, 0.1]), ("fast", [0.0, 1.0]), ("odd", [0.0, 0.0])],
        "lemma string, embedding array<float>",
    )
    toks = spark.createDataFrame(
        [("p", s, i, w, w, "NOUN") for s, ws in ((1, "tax tax odd"), (2, "levy tax rise fast odd")) for i, w in enumerate(ws.split())],
        "id string, side int, i int, text string, lemma string, pos string",
    )
    out = topic.semantic_links(toks, vec, score=True)
    assert sorted((r.s1_word, r.s1_i, r.s2_word, r.s2_i) for r in out.collect()) == [
        ("tax", 0, "levy", 0), ("tax", 0, "rise", 2), ("tax", 1, "levy", 0), ("tax", 1, "rise", 2)
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line]
    assert "Cartesian" not in plan and not any("embedding" in line for line in exchanges)
