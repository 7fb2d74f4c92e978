"""Hand-checked fixtures and invariants of the evaluation operators."""

import random

import pytest
from pyspark.sql import functions as F

from foldsieve.functions import scalar
from foldsieve.functions.hashing import hex_to_long, long_to_hex
from foldsieve.operators import ensembles, knn, metrics, simjoin, splits, vectors
from foldsieve.operators.components import connected_components


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics(spark):
    rows = table(spark, [(0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 1, 0), (1, 0, 0)], "fold int, y int, pred int")
    first, second = metrics.metrics_by_fold(rows).orderBy("fold").collect()
    assert [round(first[m], 9) for m in metrics.METRICS] == [0.5] * 5
    assert [second[m] for m in metrics.METRICS] == [0.5, 0, 0, 0, 1]


def test_macro_uses_population_deviation(spark):
    rows = table(spark, [(0, 1.0), (1, 0.5)], "fold int, acc double")
    found = metrics.macro(rows, metrics=("acc",)).first()
    assert (found["acc_mean"], found["acc_std"]) == (0.75, 0.25)


def test_report_rounding(spark):
    row = table(spark, [(0.911, 0.004, 0.0625)], "m double, s double, p double").select(
        metrics.report_line(F.col("m"), F.col("s")), metrics.percent(F.col("p"))
    )
    assert tuple(row.first()) == (" 91.1±0.4".rjust(9), 6.2)


def test_majority_tie_is_zero_and_picks_that_member(spark):
    rows = table(spark, [(1, 0, 1), (1, 1, 0), (2, 2, 1)], "cluster int, row_idx int, y int")
    assert {tuple(r) for r in splits.representatives(rows).collect()} == {(1, 1, 0), (2, 2, 1)}
    assert {tuple(r)[:2] for r in splits.representatives(rows, rule="first").collect()} == {(1, 0), (2, 2)}


def test_keep_first_and_last_wins(spark):
    rows = table(spark, [("a", 0, "O"), ("a", 1, "X"), ("b", 2, "X")], "name string, row_idx int, v string")
    assert {(r.name, r.v) for r in splits.keep_first(rows, "name", "row_idx").select("name", "v").collect()} == {("a", "O"), ("b", "X")}
    assert {tuple(r) for r in splits.last_wins(rows, "name", "v", "row_idx").collect()} == {("a", "X"), ("b", "X")}


def test_folds(spark):
    rows = table(spark, [(i, i % 3 == 0) for i in range(101)], "id int, b boolean").select("id", F.col("b").cast("int").alias("y"))
    counts = splits.stratified_folds(rows, "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    stats = splits.cluster_stats(rows.withColumn("cluster", (F.col("id") / 4).cast("int")))
    assert splits.group_folds(stats).groupBy("cluster").count().where("count > 1").count() == 0


def test_resume_and_weights(spark):
    assert splits.resume_point(17, 10) == 10 and splits.resume_point(1, 10) == 0
    rows = table(spark, [(0,), (0,), (0,), (1,)], "y int")
    assert sorted(r.weight for r in splits.balanced_weights(rows).collect()) == pytest.approx([2 / 3] * 3 + [2])


def test_missing_verdict_policies(spark):
    rows = table(spark, [(1, 1), (2, None)], "id int, pred int")
    assert splits.assert_complete(rows, "pred", "drop").count() == 1
    assert [r.pred for r in splits.assert_complete(rows, "pred", "negative").orderBy("id").collect()] == [1, 0]
    with pytest.raises(Exception, match="missing pred"):
        splits.assert_complete(rows, "pred").collect()


def test_strict_label(spark):
    rows = table(spark, [("O",), ("X",)], "v string")
    assert [r[0] for r in rows.select(scalar.strict_label(F.col("v"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown label"):
        table(spark, [("?",)], "v string").select(scalar.strict_label(F.col("v"))).collect()


def test_hash_extremes(spark):
    rows = table(spark, [("ffffffffffffffff", "0000000000000000")], "a string, b string").select(hex_to_long(F.col("a")).alias("a"), hex_to_long(F.col("b")).alias("b"))
    assert rows.select("a", simjoin.hamming(F.col("a"), F.col("b")).alias("d"), long_to_hex(F.col("a")).alias("h")).first() == (-1, 64, "ffffffffffffffff")


def hashes(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        h = rng.getrandbits(64) if i % 4 == 0 else out[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64))
        out.append(h)
    return [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(out)]


@pytest.mark.parametrize("most", [0, 5, 10, 15])
def test_banded_join_is_complete(spark, most):
    rows = hashes(200, most) + [(200, 7), (201, 7), (202, 7)]
    want = {(i, j, ((g ^ h) & (2**64 - 1)).bit_count()) for i, g in rows for j, h in rows if i < j}
    want = {p for p in want if p[2] <= most}
    frame = table(spark, rows, "id long, hash long")
    assert {tuple(r) for r in simjoin.hamming_pairs(frame, most).collect()} == want
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in want:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = simjoin.cluster(frame, simjoin.hash_edges(frame, most), most).collect()
    assert {tuple(r) for r in found} == {(i, root(i)) for i, _ in rows}


def test_transitive_cluster_and_inclusive_threshold(spark):
    rows = [(0, 0), (1, (1 << 10) - 1), (2, (1 << 20) - 1), (3, (1 << 31) - 1)]
    frame = table(spark, rows, "id long, hash long")
    found = simjoin.cluster(frame, simjoin.hash_edges(frame, 10), 10).collect()
    assert {tuple(r) for r in found} == {(0, 0), (1, 0), (2, 0), (3, 3)}


@pytest.mark.parametrize("few", [0, 59, 60, 61])
def test_components_either_way(spark, few, monkeypatch):
    """The same labels by rounds and in one task, of graphs of random edges, loops and repeats, and of strings."""
    import random

    from foldsieve.operators import components

    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(5, 5), (7, 9), (9, 7)]
    root = list(range(80))
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: root[x] for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(frame).collect()} == want
    names = frame.selectExpr("format_string('n%02d', src) AS src", "format_string('n%02d', dst) AS dst")
    assert {r.node: r.component for r in connected_components(names).collect()} == {f"n{k:02d}": f"n{v:02d}" for k, v in want.items()}
    assert connected_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_of_a_long_chain(spark, few, monkeypatch):
    from foldsieve.operators import components

    monkeypatch.setattr(components, "FEW", few)
    edges = table(spark, [(i, i + 1) for i in range(300)] + [(1000, 1001)], "src long, dst long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[1001] == 1000


def test_knn_ties_and_folds(spark):
    rows = [(0, 0, 0, 1), (1, 0, 1, 0), (2, 0, 1, 1), (3, 0, 1, 1), (4, 0, 1, 0), (5, 3, 1, 0)]
    frame = table(spark, rows, "id long, hash long, fold int, y int").withColumn("row_idx", F.col("id"))
    found = {r.id: r.pred for r in knn.knn_predictions(frame).collect()}
    assert found[0] == 1  # neighbours 1, 2, 3 by order: labels 0, 1, 1
    assert found[1] == 1  # only row 0 is in another fold


def test_votes_and_zero_shot_tie(spark):
    rows = table(spark, [(1, 0, 0), (1, 1, 0), (0, 0, 0)], "a int, b int, c int")
    assert [tuple(r) for r in rows.select(ensembles.any_of("a", "b", "c"), ensembles.majority_of("a", "b", "c")).collect()] == [(1, 0), (1, 1), (0, 0)]
    protos = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "class_idx int, vec array<double>").withColumn("s", F.lit("x"))
    found = vectors.two_class_scores(table(spark, [(1, [0.5, 0.5])], "id int, vec array<double>"), protos, ["s"], "vec", ["id"]).first()
    assert (found.p_pos, found.pred) == (0.5, 1)


def test_learner_predicts_every_row_once(spark):
    from foldsieve.operators import learners

    rng = random.Random(1)
    rows = [(i, i % 5, i % 2, [rng.random() + i % 2, rng.random()]) for i in range(100)]
    frame = table(spark, rows, "id long, fold int, y int, features array<double>")
    found = learners.out_of_fold(frame, learners.logistic(iterations=20), balanced=True).collect()
    assert sorted(r.id for r in found) == list(range(100))
    assert sum(r.pred == r.y for r in found) > 95
