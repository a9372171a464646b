"""Training and scoring of the gated model whose memory must not grow with the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credence.operators import fusion
from credence.operators.sparse import SPARSE
from credence.session import arrow_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_gradient_comes_to_the_driver(spark, monkeypatch):
    """what a step sends to the driver does not grow with the partitions."""
    rows = [(i, 1.0, 1.0, 0.5, 0.25, [float(i), 1.0]) for i in range(37)]
    df = spark.createDataFrame(rows, fusion.GRADIENT_SCHEMA).repartition(5)
    sent, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    totals, grad = fusion.sum_gradients(df, 37)
    assert totals.tolist() == [37, 37, 18.5, 9.25] and grad.tolist() == [666, 37] and [len(s) for s in sent] == [1]


def test_layers_are_held_for_a_slice_of_a_batch(monkeypatch):
    """gradients and counts take a batch of any size slice by slice."""
    monkeypatch.setattr(fusion, "SCORE_BATCH", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (11, 0, 4)]
    found = list(fusion._slices(iter(batches)))
    assert [b.num_rows for b in found] == [4, 4, 3, 4]
    assert [x for b in found for x in b["x"].to_pylist()] == [*range(11), *range(4)]


def test_domain_scores_take_one_function(spark):
    """classes and domain are scored in the same Python process; the scores are the discriminator's."""
    shape = fusion.FusionShape(3, 2, 4, 2, domain_hidden=3)
    model = fusion.FittedFusion(shape, shape.init(3))
    r = np.random.default_rng(1)
    rows = [(f"d{i}", r.normal(size=3).tolist(), r.normal(size=2).tolist(), i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, text_features array<double>, context_features array<double>, context_mask int")
    out = model.domain_scores(df)
    assert _plan(out).count("ArrowEvalPython") == 1
    apart = fusion.DomainDiscriminator.of(model).score(model.score(df, with_fused=True))
    assert out.columns == apart.columns
    want = {x["id"]: x["domain_score"] for x in apart.collect()}
    assert {x["id"]: x["domain_score"] for x in out.collect()} == pytest.approx(want, abs=1e-12)


def _rows(spark, n, parts):
    rng = np.random.default_rng(4)
    rows = [
        (f"r{i // 2}" if i % 9 else None, rng.normal(size=5).tolist(), (3, [i % 3], [1.0 + i % 2]), int(i % 4 > 0), int(rng.integers(2)), i % 2)
        for i in range(n)
    ]
    schema = f"id string, text_features array<double>, context_features {SPARSE}, context_mask int, label int, domain_label int"
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_an_epoch_is_a_step_for_every_batch(spark):
    """an epoch made a single step. Adam moves a parameter by its rate at most in a step, so five steps are seen."""
    train, rate = _rows(spark, 150, 5), 1e-3
    shape = fusion.FusionShape(5, 3, 4, 2)
    model, history = fusion.train_fusion(train, train, shape, epochs=1, dropout=0.0, learning_rate=rate, batch_size=32)
    moved = np.abs(model.params - shape.init()).max()
    assert 3 * rate < moved < 5.5 * rate and history.count() == 1
    single, _ = fusion.train_fusion(train, train, shape, epochs=1, dropout=0.0, learning_rate=rate, steps_per_epoch=1)
    assert np.abs(single.params - shape.init()).max() < 1.001 * rate
    default, _ = fusion.train_fusion(train, train, shape, epochs=1, dropout=0.0, learning_rate=rate)
    assert 2 * rate < np.abs(default.params - shape.init()).max() < 3.5 * rate  # 64, 64 and 22 rows


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("lam", [None, 0.5])
def test_epoch_equals_a_loop_over_its_batches(spark, parts, lam):
    """every row is in one batch, batches run over the borders of Arrow batches, and dropout goes by key and step."""
    shape = fusion.FusionShape(5, 3, 4, 2, domain_hidden=2)
    df = _rows(spark, 150, parts).withColumn("_key", F.xxhash64("id")).withColumn("_row", F.xxhash64("_key", "text_features"))
    state = (shape.init(1), np.zeros(shape.size()), np.zeros(shape.size()))
    with arrow_rows(spark, 50):
        totals, after, steps = fusion.train_epoch(
            df, shape, state, order=F.col("_row"), size=32, step=3, learning_rate=0.01, rate=0.3, seed=7, lam=lam)
    assert steps == 8 and totals[0] == 150
    rows, loss = df.orderBy("_row").collect(), 0.0
    for k in range(5):
        part = rows[32 * k : 32 * k + 32]
        context = np.zeros((len(part), 3))
        for i, r in enumerate(part):
            context[i, r["context_features"]["indices"]] = r["context_features"]["values"]
        column = lambda c: np.array([r[c] for r in part])
        keep = fusion.dropout_masks(shape, column("_key"), 3 + k, 0.3, 7)
        found, used, _, n, grads = fusion.gradient(
            shape, state[0], column("text_features"), context, column("context_mask"), column("label"), keep,
            None if lam is None else column("domain_label"), lam or 0.0)
        g = grads[0] / used + (grads[1] / n if lam else 0.0)
        first, second = 0.9 * state[1] + 0.1 * g, 0.999 * state[2] + 0.001 * g * g
        move = 0.01 * (first / (1 - 0.9 ** (k + 4))) / (np.sqrt(second / (1 - 0.999 ** (k + 4))) + 1e-8)
        state, loss = (state[0] - move, first, second), loss + found
    assert totals[2] == pytest.approx(loss)
    for ours, theirs in zip(after, state, strict=True):
        assert np.abs(ours - theirs).max() < 1e-9
