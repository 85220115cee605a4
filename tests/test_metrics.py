import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from meterwise.operators import metrics as ops


def scored(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, n)
    prob = np.clip(np.round(0.3 * truth + rng.uniform(0, 0.8, n), 2), 0, 1)
    rows = [(int(t), int(p >= 0.5), float(p)) for t, p in zip(truth, prob, strict=True)]
    return spark.createDataFrame(rows, "y_true int, y_pred int, y_prob double"), truth, prob


def test_auc_agrees_with_the_exact_evaluator(spark):
    df, _, _ = scored(spark)
    exact = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="label", numBins=0)
    want = exact.evaluate(df.withColumn("label", F.col("y_true").cast("double")))
    assert ops.ranking_metrics(df).first()["roc_auc"] == pytest.approx(want)


def test_average_precision_by_hand(spark):
    df, truth, prob = scored(spark)
    total, want = truth.sum(), 0.0
    for s in np.unique(prob):
        at_least = prob >= s
        want += truth[prob == s].sum() / total * (truth[at_least].sum() / at_least.sum())
    assert ops.ranking_metrics(df).first()["avg_precision"] == pytest.approx(want)


def test_single_class_and_no_predicted_positives(spark):
    one = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.4)], "y_true int, y_pred int, y_prob double")
    row = ops.classification_metrics(one).first()
    assert row["roc_auc"] is None and row["avg_precision"] == 1.0
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 0)


def test_regression_metrics_and_flat_truth(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "y_true double, y_pred double")
    row = ops.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(4 / 3) and row["rmse"] == pytest.approx((10 / 3) ** 0.5)
    assert row["r2"] == pytest.approx(1 - 10 / 8)
    flat = spark.createDataFrame([(1.0, 2.0)], "y_true double, y_pred double")
    assert ops.regression_metrics(flat).first()["r2"] is None


def brute_silhouette(points, labels):
    out = []
    for i, p in enumerate(points):
        dist = ((points - p) ** 2).sum(axis=1)
        same = labels == labels[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = dist[same].sum() / (same.sum() - 1)
        b = min(dist[labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_and_variance_ratio_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.7, (n, 2)) for c, n in ((0, 400), (3, 250), (9, 60))])
    first = np.repeat([0, 1, 2], [400, 250, 60])
    second = (points[:, 0] > 1.5).astype(int)
    second[0] = 5
    rows = [(float(a), float(b), int(x), int(y))
            for (a, b), x, y in zip(points, first, second, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, l1 int, l2 int")
    got = {r["labelling"]: r["silhouette"]
           for r in ops.silhouettes(df, ["a", "b"], ["l1", "l2"]).collect()}
    assert got["l1"] == pytest.approx(brute_silhouette(points, first))
    assert got["l2"] == pytest.approx(brute_silhouette(points, second))

    row = ops.calinski_harabasz(df, ["a", "b"], "l1").first()
    centre = points.mean(axis=0)
    parts = [points[first == c] for c in range(3)]
    between = sum(len(p) * ((p.mean(axis=0) - centre) ** 2).sum() for p in parts)
    within = sum(((p - p.mean(axis=0)) ** 2).sum() for p in parts)
    assert row["inertia"] == pytest.approx(within)
    assert row["calinski_harabasz"] == pytest.approx(between / 2 / (within / (len(points) - 3)))


def test_silhouette_limits(spark):
    two = spark.createDataFrame([(0.0, 0), (1.0, 1)], "a double, l int")
    assert ops.silhouettes(two, ["a"], ["l"]).first()["silhouette"] is None
    one = spark.createDataFrame([(float(i), 0) for i in range(5)], "a double, l int")
    assert ops.silhouettes(one, ["a"], ["l"]).first()["silhouette"] is None


def test_euclidean_silhouette_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ops, "_BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (90, 2)), rng.normal(3, 1, (60, 2)), [[9.0, 9.0]], np.ones((5, 2))])
    one, two = np.repeat([7, 2, 5, 7], [90, 60, 1, 5]), np.arange(156) % 2
    df = spark.createDataFrame([(*map(float, r), int(a), int(b), 1) for r, a, b in zip(x, one, two)], "a double, b double, l1 int, l2 int, l3 int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def plain(labels):
        out = []
        for i, mine in enumerate(labels):
            same = labels == mine
            own = far[i, same].sum() / max(same.sum() - 1, 1)
            near = min(far[i, labels == o].mean() for o in set(labels) - {mine})
            out.append(0.0 if same.sum() == 1 else (near - own) / max(own, near))
        return float(np.mean(out))

    got = {r["labelling"]: r["silhouette"] for r in ops.euclidean_silhouettes(df, ["a", "b"], ["l1", "l2", "l3"]).collect()}
    assert got["l1"] == pytest.approx(plain(one), abs=1e-12) and got["l2"] == pytest.approx(plain(two), abs=1e-12)
    assert got["l3"] is None and ops.euclidean_silhouettes(df.limit(2), ["a"], ["l1"]).first()["silhouette"] is None
    assert ops.euclidean_silhouettes(df.limit(0), ["a"], ["l1"]).first()["silhouette"] is None


def test_a_silhouette_row_meets_few_large_blocks_in_parts(spark, monkeypatch):
    # A row of the full sample is sent to so many blocks and gets as many lines of sums.
    assert -(-ops.SILHOUETTE_ROWS // ops._BLOCK_ROWS) <= 25
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(70, 2)), rng.integers(0, 3, 70)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, label)], "a double, b double, l int")
    whole = ops.euclidean_silhouettes(rows, ["a", "b"], ["l"]).first()["silhouette"]
    monkeypatch.setattr(ops, "_PART", (7, 11))
    assert ops.euclidean_silhouettes(rows, ["a", "b"], ["l"]).first()["silhouette"] == pytest.approx(whole, rel=1e-12)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, c in enumerate(label):
        own = far[i, label == c].sum() / ((label == c).sum() - 1)
        near = min(far[i, label == o].mean() for o in {*label} - {c})
        scores.append((near - own) / max(near, own))
    assert whole == pytest.approx(np.mean(scores), rel=1e-9)
