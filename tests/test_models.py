import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import classify, fusion
from credence.operators.tfidf import fit_tfidf, tfidf_vectors


def _texts(spark, n=60):
    rng = np.random.default_rng(2)
    words = np.array("vaccine cure study trial doctor secret miracle data report claim".split())
    rows = []
    for i in range(n):
        y = int(i % 3 == 0)
        p = np.ones(10) / 10 if y else np.r_[np.ones(5) * 0.16, np.ones(5) * 0.04]
        rows.append((f"d{i}", " ".join(rng.choice(words, 12, p=p / p.sum())), y))
    return spark.createDataFrame(rows, "id string, text string, label int").repartition(3)


def newton(x, y, weight, c):
    """Minimiser of 0.5 |w|^2 + c * sum(weight * log-loss), bias penalised."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = w + c * x.T @ (weight * (p - y))
        h = np.eye(len(w)) + c * (x.T * (weight * p * (1 - p))) @ x
        w -= np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("c,balanced", [(1.0, False), (0.3, True)])
def test_logistic_objective(spark, c, balanced):
    df = _texts(spark)
    build = classify.build_balanced_baseline if balanced else classify.build_baseline
    model = build(max_features=25, c=c).fit(df)
    rows = tfidf_vectors(df, "text", model.tfidf, sign=F.lit(1.0)).collect()
    x = np.stack([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    w = newton(x, y, weight, c)
    assert np.abs(model.model.coefficients.toArray() - w).max() < 1e-4
    scored = {r["id"]: r for r in model.predict(df).collect()}
    for r, z in zip(rows, x @ w):
        assert scored[r["id"]]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
        assert scored[r["id"]]["prediction"] == int(scored[r["id"]]["score"] > 0.5)


def test_baseline_contract(spark):
    for bad in ({"max_features": 0}, {"c": 0}, {"class_weight": "other"}):
        with pytest.raises(ValueError):
            classify.build_baseline(**bad)
    with pytest.raises(ValueError):
        classify.build_baseline().fit(_texts(spark).where("label = 0"))


SHAPE = fusion.FusionShape(5, 3, 4, 2, domain_hidden=3)


def _batch(n=7, seed=0):
    rng = np.random.default_rng(seed)
    return (
        rng.normal(size=(n, 5)), rng.normal(size=(n, 3)), (rng.random(n) < 0.6).astype(float),
        rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(-(2**62), 2**62, n),
    )


def test_parameter_count():
    assert fusion.FusionShape(768, 32, 128, 2).size() == 152579


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_gradient(rate):
    text, ctx, mask, label, _, keys = _batch()
    keep = fusion.dropout_masks(SHAPE, keys, 3, rate, 42)
    flat = SHAPE.init(1)
    loss = lambda p: fusion.gradient(SHAPE, p, text, ctx, mask, label, keep)[0]
    grad = fusion.gradient(SHAPE, flat, text, ctx, mask, label, keep)[4][0]
    for i in range(0, flat.size, 3):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-5)


def test_adversarial_gradient():
    """Domain head descends its loss, everything below ascends it, scaled by lambda;
    class loss counts source rows only."""
    text, ctx, mask, label, domain, _ = _batch(seed=4)
    flat, lam = SHAPE.init(2), 0.5
    run = lambda p: fusion.gradient(SHAPE, p, text, ctx, mask, label, None, domain, lam)
    class_loss, class_rows, _, n, grads = run(flat)
    assert class_rows == (domain == 0).sum() and n == len(domain)
    source = domain == 0
    alone = fusion.gradient(SHAPE, flat, text[source], ctx[source], mask[source], label[source])
    assert class_loss == pytest.approx(alone[0])
    assert grads[0] == pytest.approx(alone[4][0])
    names = np.concatenate([[k] * ((i + 1) * o) for k, (i, o) in SHAPE.layers().items()])
    for i in range(0, flat.size, 2):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        slope = (run(flat + e)[2] - run(flat - e)[2]) / 2e-6
        sign = 1.0 if names[i].startswith("domain") else -lam
        assert grads[1][i] == pytest.approx(sign * slope, abs=1e-5)


def _inputs(spark, n=90, parts=4):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((
            f"r{i}", (rng.normal(size=5) + y).tolist(), (rng.normal(size=3) - y).tolist(),
            int(i % 3 > 0), y, int(i % 5 == 0)))
    schema = "id string, text_features array<float>, context_features array<float>, context_mask int, label int, domain_label int"
    return spark.createDataFrame(rows, schema).repartition(parts, "id")


def test_scoring(spark):
    df = _inputs(spark)
    model = fusion.FittedFusion(SHAPE, SHAPE.init(3))
    rows = model.domain_scores(df).collect()
    layers = SHAPE.unpack(model.params)
    for r in rows:
        a = fusion.forward(layers, [r["text_features"]], [r["context_features"]], [r["context_mask"]])
        assert r["gate"] == pytest.approx(a["gate"][0, 0])
        assert r["logits"] == pytest.approx(a["logits"][0].tolist())
        p = np.exp(a["logits"][0]) / np.exp(a["logits"][0]).sum()
        assert r["probabilities"] == pytest.approx(p.tolist()) and r["score"] == pytest.approx(p[1])
        assert r["prediction"] == int(np.argmax(p))
        assert r["domain_score"] == pytest.approx(fusion.discriminate(layers, a["fused"])["p"][0, 0])
        if r["context_mask"] == 0:
            assert r["gate"] == 0
    # without context, its values do not matter
    huge = F.transform("context_features", lambda v: v * 1e6)
    other = model.score(df.withColumn("context_features", huge)).where("context_mask = 0")
    plain = {r["id"]: r["logits"] for r in rows}
    assert all(r["logits"] == plain[r["id"]] for r in other.collect())


def test_contract(spark):
    df = _inputs(spark, 10)
    fusion.check_features(df, SHAPE)
    for column, value in (("context_mask", F.lit(2)), ("label", F.lit(2)), ("text_features", F.array(F.lit(1.0)))):
        with pytest.raises(ValueError):
            fusion.check_features(df.withColumn(column, value), SHAPE)
    with pytest.raises(ValueError):
        fusion.check_features(df.where("id = 'none'"), SHAPE)


def test_training(spark, tmp_path, monkeypatch):
    df = _inputs(spark)
    train, validation = df.where("label >= 0 and id not like '%7'"), df.where("id like '%7'")
    shape = fusion.FusionShape(5, 3, 8, 2)
    options = dict(epochs=4, learning_rate=0.05)
    model, history = fusion.train_fusion(train, validation, shape, **options)
    h = history.orderBy("epoch").collect()
    assert [r["epoch"] for r in h] == [1, 2, 3, 4] and h[-1]["train_loss"] < h[0]["train_loss"]

    # the same model whatever the partitioning, and with the gradients summed in a tree
    monkeypatch.setattr(fusion, "SUM_FAN_IN", 2)
    again, _ = fusion.train_fusion(train.repartition(7), validation.repartition(1), shape, **options)
    assert np.abs(model.params - again.params).max() < 1e-9

    # the kept parameters are those of the best epoch
    best = min(h, key=lambda r: r["val_loss"])
    scored = model.score(validation).collect()
    loss = -np.mean([np.log(r["probabilities"][r["label"]]) for r in scored])
    assert loss == pytest.approx(best["val_loss"])

    model.save(spark, f"{tmp_path}/m")
    back = fusion.FittedFusion.load(spark, f"{tmp_path}/m")
    assert back.shape == shape and np.array_equal(back.params, model.params)


def test_early_stop_minibatches_and_adversary(spark):
    df = _inputs(spark, 60)
    train, validation = df.where("id not like '%7'"), df.where("id like '%7'")
    shape = fusion.FusionShape(5, 3, 4, 2)
    _, history = fusion.train_fusion(train, validation, shape, epochs=9, patience=1, learning_rate=5.0, steps_per_epoch=2)
    assert history.count() < 9
    lambdas = []
    _, history = fusion.train_fusion(
        train, validation, SHAPE, epochs=2, patience=None,
        adversarial_lambda=lambda epoch: lambdas.append(epoch) or epoch / 2)
    assert lambdas == [1, 2] and all(r["domain_loss"] > 0 for r in history.collect())


def test_domain_loss(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (1.0, 0), (0.25, 0)], "domain_score double, domain_label int")
    r = fusion.domain_bce(df).first()
    assert r["loss"] == pytest.approx((100 + 0 + 100 - np.log(0.75)) / 4)
