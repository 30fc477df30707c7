"""Split counts, early stopping, network gradients and MLlib weight layout."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from outcomelens.operators import learn as L
from outcomelens.operators.scoring import MlpModel
from outcomelens.operators.train import _mlp_from_vector
from outcomelens.sources.fixtures import split_records


def test_stratified_split_exact_counts(spark):
    df = split_records(spark, "/root/testdata/sf0.01")
    parts = {(r.label, r.part): r.n for r in L.stratified_split(df, "doc_id").groupBy("label", "part").count()
             .withColumnRenamed("count", "n").collect()}
    assert parts[(0, "test")] == 12 and parts[(1, "test")] == 68
    assert parts[(0, "val")] + parts[(1, "val")] == 64
    again = L.stratified_split(df, "doc_id").orderBy("doc_id").collect()
    assert again == L.stratified_split(df, "doc_id").orderBy("doc_id").collect()


def test_early_stop_matches_loop(spark):
    losses = [1.0, 0.8, 0.85, 0.7, 0.71, 0.72, 0.73, 0.74, 0.75, 0.6]
    df = spark.createDataFrame(list(enumerate(losses, start=1)), "epoch int, val_loss double")
    got = L.early_stop(df, patience=5).where("stop").collect()
    best, since, stop = float("inf"), 0, None
    for e, v in enumerate(losses, start=1):
        if v < best:
            best, since = v, 0
        else:
            since += 1
            if since >= 5:
                stop = e
                break
    assert [r.epoch for r in got] == [stop]


def test_mlp_gradient_finite_difference():
    rng = np.random.default_rng(0)
    m = MlpModel(((rng.normal(size=(5, 3)), rng.normal(size=5)), (rng.normal(size=(4, 5)), rng.normal(size=4)),
                  (rng.normal(size=(2, 4)), rng.normal(size=2))))
    z = rng.normal(size=(2, 3))
    g = m.gradient(z)
    eps = 1e-6
    for j in range(3):
        d = np.zeros(3)
        d[j] = eps
        num = (m.forward(z + d) - m.forward(z - d)) / (2 * eps)
        assert np.allclose(g[:, j], num, atol=1e-6)


def test_mllib_layout_matches_forward(spark):
    rows = [(float(i % 2), Vectors.dense([i / 10.0, (i % 3) - 1.0])) for i in range(40)]
    df = spark.createDataFrame(rows, ["label", "features"])
    model = MultilayerPerceptronClassifier(layers=[2, 3, 2], maxIter=30, seed=1).fit(df)
    ours = _mlp_from_vector(np.asarray(model.weights.toArray()), [2, 3, 2])
    probs = [r.probability[1] for r in model.transform(df).select("probability").collect()]
    x = np.array([list(v) for _, v in rows])
    assert np.allclose(ours.forward(x), probs, atol=1e-9)
