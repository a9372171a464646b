"""Gated text + context fusion: scoring as a batch-inference column, training as
one job per epoch of small batches, or one gradient job per step.

Shapes: two encoders (ReLU) to ``h``, a gate ``sigmoid(MLP([t, c, mask])) * mask``,
``fused = (1 - gate) * t + gate * c``, and a ReLU classifier. Executors hold the
rows; the driver holds parameters and Adam state only. Steps of small batches follow one
another, so a single task makes those of an epoch, streaming the rows in the epoch's order; steps of large parts
of the rows return one summed gradient per partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from credence.operators.sparse import SparseRows, is_malformed, is_sparse, width
from credence.schema import require_columns
from credence.session import materialize

# ---- fixed values -----------------------------------------------------------
CONFIG = {
    "hidden_dim": 128,
    "num_classes": 2,
    "dropout": 0.3,
    "learning_rate": 1e-3,
    "batch_size": 64,
    "num_epochs": 30,
    "patience": 5,
    "domain_lambda": 0.5,
    "seed": 42,
}
ADAM_BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8
LOG_CLAMP = -100.0
# -----------------------------------------------------------------------------

SCORE_BATCH = 1024  # rows whose layers a worker holds at once
SUM_FAN_IN = 16  # gradients added up per task and level
INPUTS = ["text_features", "context_features", "context_mask"]


@dataclass(frozen=True)
class FusionShape:
    text_dim: int
    context_dim: int
    hidden_dim: int = CONFIG["hidden_dim"]
    num_classes: int = CONFIG["num_classes"]
    domain_hidden: int = 0  # 0: no domain head

    def layers(self) -> dict:
        h = self.hidden_dim
        shapes = {
            "text": (self.text_dim, h),
            "context": (self.context_dim, h),
            "gate_in": (2 * h + 1, h),
            "gate_out": (h, 1),
            "class_in": (h, h),
            "class_out": (h, self.num_classes),
        }
        if self.domain_hidden:
            shapes["domain_in"] = (h, self.domain_hidden)
            shapes["domain_out"] = (self.domain_hidden, 1)
        return shapes

    def size(self) -> int:
        return sum((i + 1) * o for i, o in self.layers().values())

    def init(self, seed=CONFIG["seed"]) -> np.ndarray:
        """Uniform in ``+-1/sqrt(fan_in)`` for weights and biases."""
        rng = np.random.default_rng(seed)
        parts = []
        for fan_in, fan_out in self.layers().values():
            bound = 1.0 / np.sqrt(fan_in)
            parts.append(rng.uniform(-bound, bound, (fan_in + 1) * fan_out))
        return np.concatenate(parts)

    def unpack(self, flat: np.ndarray) -> dict:
        """``{layer: (weights, bias)}`` views into a flat vector."""
        out, at = {}, 0
        for name, (i, o) in self.layers().items():
            w = flat[at : at + i * o].reshape(i, o)
            out[name] = (w, flat[at + i * o : at + (i + 1) * o])
            at += (i + 1) * o
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def forward(p: dict, text, context, mask, keep=None) -> dict:
    """Batch forward pass over dense or sparse context; ``keep`` scales the four hidden layers (dropout)."""
    m = np.asarray(mask, dtype="float64").reshape(-1, 1)

    def hidden(x, layer):
        z = np.maximum(x @ p[layer][0] + p[layer][1], 0.0)
        return z if keep is None else z * keep[layer]

    rows = context if isinstance(context, SparseRows) else np.asarray(context, dtype="float64")
    a = {"x": np.asarray(text, dtype="float64"), "c": rows * m, "m": m}
    a["t"] = hidden(a["x"], "text")
    a["k"] = hidden(a["c"], "context")
    a["g_in"] = np.concatenate([a["t"], a["k"], m], axis=1)
    a["g_hid"] = hidden(a["g_in"], "gate_in")
    a["g_raw"] = sigmoid(a["g_hid"] @ p["gate_out"][0] + p["gate_out"][1])
    a["gate"] = a["g_raw"] * m
    a["fused"] = (1.0 - a["gate"]) * a["t"] + a["gate"] * a["k"]
    a["c_hid"] = hidden(a["fused"], "class_in")
    a["logits"] = a["c_hid"] @ p["class_out"][0] + p["class_out"][1]
    return a


def discriminate(p: dict, fused: np.ndarray, keep=None) -> dict:
    """Probability that a representation is from the target domain."""
    z = np.maximum(fused @ p["domain_in"][0] + p["domain_in"][1], 0.0)
    if keep is not None:
        z = z * keep["domain_in"]
    return {"hid": z, "p": sigmoid(z @ p["domain_out"][0] + p["domain_out"][1])}


def log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def gradient(shape, flat, text, context, mask, label, keep=None, domain=None, lam=0.0):
    """Summed losses, row counts and summed gradients of a batch.

    Returns ``(class_loss, class_rows, domain_loss, rows, grads)``; ``grads`` has a
    class row and, with a domain column, a domain row. The class loss then counts
    source rows only (domain 0), and the domain row holds the gradient of the
    domain head with ``-lam`` times its gradient below the fused representation.
    """
    p = shape.unpack(flat)
    a = forward(p, text, context, mask, keep)
    n = len(a["x"])
    grads = np.zeros((1 if domain is None else 2, flat.size))

    def linear(g, layer, x, d):
        g[layer][0][...] += x.T @ d
        g[layer][1][...] += d.sum(axis=0)
        # nothing lies below sparse rows
        return None if isinstance(x, SparseRows) else d @ p[layer][0].T

    def relu(g, layer, x, hid, d):
        d = d * (hid > 0)
        return linear(g, layer, x, d if keep is None else d * keep[layer])

    def below_fused(g, d_fused):
        gate, h = a["gate"], shape.hidden_dim
        d_gate = (d_fused * (a["k"] - a["t"])).sum(axis=1, keepdims=True) * a["m"]
        d_raw = d_gate * a["g_raw"] * (1 - a["g_raw"])
        d_in = relu(g, "gate_in", a["g_in"], a["g_hid"], linear(g, "gate_out", a["g_hid"], d_raw))
        relu(g, "text", a["x"], a["t"], d_fused * (1 - gate) + d_in[:, :h])
        relu(g, "context", a["c"], a["k"], d_fused * gate + d_in[:, h : 2 * h])

    logp = log_softmax(a["logits"])
    used = np.ones(n) if domain is None else (domain == 0).astype("float64")
    loss = -(logp[np.arange(n), label] * used).sum()
    d_logits = np.exp(logp)
    d_logits[np.arange(n), label] -= 1.0
    g = shape.unpack(grads[0])
    d_hid = linear(g, "class_out", a["c_hid"], d_logits * used[:, None])
    below_fused(g, relu(g, "class_in", a["fused"], a["c_hid"], d_hid))

    domain_loss = 0.0
    if domain is not None:
        truth = domain.astype("float64").reshape(-1, 1)
        q = discriminate(p, a["fused"], keep)
        domain_loss = binary_cross_entropy(q["p"], truth).sum()
        g = shape.unpack(grads[1])
        d_hid = linear(g, "domain_out", q["hid"], q["p"] - truth)
        below_fused(g, -lam * relu(g, "domain_in", a["fused"], q["hid"], d_hid))
    return loss, used.sum(), domain_loss, n, grads


def binary_cross_entropy(p: np.ndarray, truth: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        yes, no = np.maximum(np.log(p), LOG_CLAMP), np.maximum(np.log(1 - p), LOG_CLAMP)
    return -(truth * yes + (1 - truth) * no)


# ---- dropout that does not depend on partitioning ---------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 (public-domain constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropout_masks(shape: FusionShape, keys: np.ndarray, step: int, rate: float, seed: int):
    """Inverted-dropout factors per hidden layer from (row key, step, unit)."""
    if not rate:
        return None
    masks = {}
    rows = keys.astype("int64").view("uint64")
    with np.errstate(over="ignore"):
        for layer, (name, (_, width)) in enumerate(shape.layers().items()):
            if name.endswith("_out"):
                continue
            salt = _mix(np.array([seed * 1_000_003 + step * 64 + layer], dtype="uint64"))
            units = np.arange(1, width + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
            bits = _mix(_mix(rows ^ salt)[:, None] + units[None, :])
            kept = (bits >> np.uint64(11)).astype("float64") / float(1 << 53) >= rate
            masks[name] = kept / (1.0 - rate)
    return masks


# ---- scoring ----------------------------------------------------------------


def _sparse_scores(make_predict, width: int):
    """A column function over text arrays, sparse context and mask; no row is spread out to its width."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        predict = make_predict()
        for text, context, mask in batches:
            rows, found = SparseRows.of(context["indices"].to_list(), context["values"].to_list(), width), []
            for at in range(0, len(text), SCORE_BATCH):
                stop = at + SCORE_BATCH
                found += list(predict(np.stack(text.iloc[at:stop].to_list()), rows.part(at, stop), mask.iloc[at:stop].to_numpy()))
            yield pd.Series(found, dtype=object)

    return run


@dataclass(frozen=True)
class FittedFusion:
    shape: FusionShape
    params: np.ndarray

    def score(self, df: DataFrame, with_fused=False, with_domain=False) -> DataFrame:
        """Adds ``gate``, ``logits``, ``probabilities``, ``prediction`` and ``score``
        (probability of class 1); dropout is off. Row-local."""
        require_columns(df, INPUTS)
        shape, params, k = self.shape, self.params, self.shape.num_classes

        def make_predict():
            layers = shape.unpack(params)

            def predict(text, context, mask):
                a = forward(layers, text, context, mask)
                parts = [a["gate"], a["logits"]] + ([a["fused"]] if with_fused else [])
                if with_domain:
                    parts.append(discriminate(layers, a["fused"])["p"])
                return np.concatenate(parts, axis=1)

            return predict

        if is_sparse(df, "context_features"):
            run = _sparse_scores(make_predict, shape.context_dim)
        else:
            run = predict_batch_udf(
                make_predict,
                return_type=T.ArrayType(T.DoubleType()),
                batch_size=SCORE_BATCH,
                input_tensor_shapes=[[shape.text_dim], [shape.context_dim], None],
            )
        out = df.withColumn("_out", run(*[F.col(c) for c in INPUTS]))
        out = out.withColumns(
            {"gate": F.get("_out", F.lit(0)), "logits": F.slice("_out", 2, k)}
        )
        if with_fused:
            out = out.withColumn("fused", F.slice("_out", k + 2, shape.hidden_dim))
        if with_domain:
            out = out.withColumn("domain_score", F.element_at("_out", -1))
        return class_columns(out.drop("_out"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights as a small table: layer, part, shape, values."""
        rows = []
        for name, (w, b) in self.shape.unpack(self.params).items():
            rows.append((name, "weight", list(w.shape), w.ravel().tolist()))
            rows.append((name, "bias", [b.size], b.tolist()))
        schema = "layer string, part string, shape array<int>, values array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedFusion":
        rows = {(r["layer"], r["part"]): r for r in spark.read.parquet(path).collect()}

        def dims(layer):
            return rows[(layer, "weight")]["shape"]

        domain = dims("domain_in")[1] if ("domain_in", "weight") in rows else 0
        shape = FusionShape(
            dims("text")[0], dims("context")[0], dims("text")[1], dims("class_out")[1], domain
        )
        parts = [
            np.array(rows[(name, part)]["values"])
            for name in shape.layers()
            for part in ("weight", "bias")
        ]
        return FittedFusion(shape, np.concatenate(parts))

    def domain_scores(self, df: DataFrame) -> DataFrame:
        """Adds ``domain_score``, the probability of the target domain, in the pass that scores the classes: a second
        function over the representations would be a second Python process a task."""
        DomainDiscriminator.of(self)  # raises without a domain head
        scored = self.score(df, with_fused=True, with_domain=True)
        return scored.select(*[c for c in scored.columns if c != "domain_score"], "domain_score")


def class_columns(df: DataFrame, logits="logits") -> DataFrame:
    """Softmax, arg max (first on ties) and class-1 probability as native columns."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate("_exp", F.lit(0.0), lambda acc, v: acc + v)
    return (
        df.withColumn("_exp", shifted)
        .withColumn("_sum", total)
        .withColumn("probabilities", F.transform("_exp", lambda v: v / F.col("_sum")))
        .withColumns(
            {
                "prediction": (
                    F.array_position(logits, F.array_max(logits)) - 1
                ).cast("int"),
                "score": F.get("probabilities", F.lit(1)),
            }
        )
        .drop("_exp", "_sum")
    )


@dataclass(frozen=True)
class DomainDiscriminator:
    """Linear, ReLU, linear, sigmoid over a representation column."""

    feature_dim: int
    hidden_dim: int
    layers: dict

    @staticmethod
    def of(model: FittedFusion) -> "DomainDiscriminator":
        if not model.shape.domain_hidden:
            raise ValueError("the model has no domain head")
        layers = {
            k: v for k, v in model.shape.unpack(model.params).items() if k.startswith("domain_")
        }
        return DomainDiscriminator(model.shape.hidden_dim, model.shape.domain_hidden, layers)

    def score(self, df: DataFrame, features="fused", output="domain_score") -> DataFrame:
        require_columns(df, [features])
        layers, width = self.layers, self.feature_dim

        def make_predict():
            def predict(x):
                return discriminate(layers, x.astype("float64"))["p"][:, 0]

            return predict

        run = predict_batch_udf(
            make_predict, return_type=T.DoubleType(), batch_size=SCORE_BATCH,
            input_tensor_shapes=[[width]],
        )
        return df.withColumn(output, run(F.col(features).cast("array<double>")))


def domain_bce(df: DataFrame, prob="domain_score", truth="domain_label", by=()) -> DataFrame:
    """Mean binary cross-entropy with logs clamped at -100."""
    p, y = F.col(prob), F.col(truth).cast("double")

    def log(x):
        return F.when(x > 0, F.greatest(F.log(x), F.lit(LOG_CLAMP))).otherwise(F.lit(LOG_CLAMP))

    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(-(y * log(p) + (1 - y) * log(1 - p))).alias("loss"),
    )


def feature_contract(
    df: DataFrame, text_dim: int, context_dim: int, label="label", num_classes=2
) -> DataFrame:
    """Counts of rows that break the input contract, in one aggregation."""
    mask = F.col("context_mask")
    bad_context = width(df, "context_features") != context_dim
    if is_sparse(df, "context_features"):
        bad_context |= is_malformed("context_features")
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("text_features").isNull() | F.col("context_features").isNull()).alias("null_features"),
        F.count_if(F.size("text_features") != text_dim).alias("bad_text_dim"),
        F.count_if(bad_context).alias("bad_context_dim"),
        F.count_if(F.coalesce(~mask.isin(0, 1), F.lit(True))).alias("bad_mask"),
        F.count_if(F.coalesce(~F.col(label).between(0, num_classes - 1), F.lit(True))).alias("bad_label"),
    )


def check_features(df: DataFrame, shape: FusionShape, label="label") -> int:
    """Raise when any row breaks the contract; returns the row count."""
    r = feature_contract(df, shape.text_dim, shape.context_dim, label, shape.num_classes).first()
    broken = {k: v for k, v in r.asDict().items() if k != "rows" and v}
    if broken or not r["rows"]:
        raise ValueError(f"feature contract broken: {r.asDict()}")
    return r["rows"]


# ---- training ---------------------------------------------------------------


def _matrix(column, dtype="float64") -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _context(column, width: int):
    return SparseRows.of_arrow(column, width) if pa.types.is_struct(column.type) else _matrix(column)


def _vector(column, dtype) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(dtype)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose layers fit in little memory, however many rows a batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, SCORE_BATCH):
            yield batch.slice(at, SCORE_BATCH)


GRADIENT_SCHEMA = "slot int, rows double, class_rows double, class_loss double, domain_loss double, grad array<double>"


def _gradient_row(slot, totals, grads) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([slot], pa.int32())]
        + [pa.array([float(x)], pa.float64()) for x in totals]
        + [pa.array([grads.ravel()], pa.list_(pa.float64()))],
        names=["slot", "rows", "class_rows", "class_loss", "domain_loss", "grad"],
    )


def _batch_gradient(shape, flat, b, *, step, rate, seed, lam):
    """``gradient`` of the rows of an Arrow batch."""
    return gradient(
        shape, flat,
        _matrix(b["text_features"]), _context(b["context_features"], shape.context_dim),
        _vector(b["context_mask"], "float64"), _vector(b["label"], "int64"),
        dropout_masks(shape, _vector(b["_key"], "int64"), step, rate, seed),
        None if lam is None else _vector(b["domain_label"], "int64"),
        lam or 0.0,
    )


def _mean_gradient(totals, grads) -> np.ndarray:
    """Class part over its rows plus, if there, domain part over all rows."""
    g = grads[0] / max(totals[1], 1.0)
    return g + grads[1] / totals[0] if len(grads) > 1 else g


def adam(state, g, step: int, learning_rate: float):
    """(parameters, first moment, second moment) after the ``step``-th step, counted from 1."""
    flat, first, second = state
    first = ADAM_BETAS[0] * first + (1 - ADAM_BETAS[0]) * g
    second = ADAM_BETAS[1] * second + (1 - ADAM_BETAS[1]) * g * g
    m = first / (1 - ADAM_BETAS[0] ** step)
    v = second / (1 - ADAM_BETAS[1] ** step)
    return flat - learning_rate * m / (np.sqrt(v) + ADAM_EPS), first, second


def _of_size(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size``, the last one perhaps smaller."""
    waiting, n = [], 0

    def joined():
        return waiting[0] if len(waiting) == 1 else pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            waiting.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == size:
                yield joined()
                waiting, n = [], 0
    if n:
        yield joined()


def train_epoch(df: DataFrame, shape, state, *, order, size, step, learning_rate, rate, seed, lam=None):
    """Losses and row counts of an epoch, the state after it, and the number of steps made.

    Every row is in one batch of ``size`` rows, and each batch makes a step from the state that the one before left: a
    single task reads the rows, sorted by ``order`` on disk if need be, and holds the layers of a slice at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        now, totals, done = shared.value, np.zeros(4), step
        for b in _of_size(batches, size):
            batch, grads = np.zeros(4), 0.0
            for part in _slices([b]):
                loss, used, domain_loss, n, g = _batch_gradient(shape, now[0], part, step=done, rate=rate, seed=seed, lam=lam)
                batch += [n, used, loss, domain_loss]
                grads = grads + g
            done += 1
            now = adam(now, _mean_gradient(batch, grads), done, learning_rate)
            totals += batch
        for part in now:
            yield _gradient_row(done, totals, part)

    ordered = df.repartition(1).sortWithinPartitions(order)
    rows = ordered.mapInArrow(run, GRADIENT_SCHEMA).collect()
    shared.unpersist()
    first = rows[0]
    totals = np.array([first["rows"], first["class_rows"], first["class_loss"], first["domain_loss"]])
    return totals, tuple(np.array(r["grad"]) for r in rows), first["slot"]


def gradient_rows(df: DataFrame, shape, params, *, step, rate, seed, lam=None) -> DataFrame:
    """One row per non-empty partition: losses, row counts and summed gradient.

    ``params`` is a Spark broadcast of the flat parameter vector, whose size is
    fixed by the layer widths.
    """
    adversarial = lam is not None

    def run(batches):
        from pyspark import TaskContext

        flat = params.value
        totals = np.zeros(4)
        grads = np.zeros((2 if adversarial else 1, flat.size))
        for b in _slices(batches):
            loss, used, domain_loss, n, g = _batch_gradient(shape, flat, b, step=step, rate=rate, seed=seed, lam=lam)
            totals += [n, used, loss, domain_loss]
            grads += g
        if totals[0]:
            yield _gradient_row(TaskContext.get().partitionId(), totals, grads)

    return df.mapInArrow(run, GRADIENT_SCHEMA)


def sum_gradients(rows: DataFrame, partitions: int):
    """Tree-sum the gradient rows on executors; a single row comes to the driver, however many partitions there are."""
    while partitions > 1:
        partitions = -(-partitions // SUM_FAN_IN)
        rows = (
            rows.withColumn("slot", F.pmod("slot", F.lit(partitions)))
            .groupBy("slot")
            .applyInPandas(_add_rows, GRADIENT_SCHEMA)
        )
    collected = rows.collect()
    totals = np.array(
        [[r["rows"], r["class_rows"], r["class_loss"], r["domain_loss"]] for r in collected]
    ).sum(axis=0)
    return totals, np.sum([np.array(r["grad"]) for r in collected], axis=0)


def _add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    total = pdf.drop(columns="grad").sum().to_frame().T
    total["slot"] = pdf["slot"].iloc[0]
    total["grad"] = [np.sum(np.stack(pdf["grad"].to_list()), axis=0)]
    return total.astype({"slot": "int32"})


def validation_counts(df: DataFrame, shape, params) -> DataFrame:
    """``(label, prediction, n, loss)`` summed per partition, then per class pair."""

    def run(batches):
        layers = shape.unpack(params.value)
        k = shape.num_classes
        counts, losses = np.zeros((k, k)), np.zeros((k, k))
        for b in _slices(batches):
            label = _vector(b["label"], "int64")
            logp = log_softmax(
                forward(
                    layers, _matrix(b["text_features"]), _context(b["context_features"], shape.context_dim),
                    _vector(b["context_mask"], "float64"),
                )["logits"]
            )
            cell = (label, logp.argmax(axis=1))
            np.add.at(counts, cell, 1)
            np.add.at(losses, cell, -logp[np.arange(len(label)), label])
        y, y_hat = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(y, pa.int32()), pa.array(y_hat, pa.int32()),
             pa.array(counts[y, y_hat]), pa.array(losses[y, y_hat])],
            names=["label", "prediction", "n", "loss"],
        )

    rows = df.mapInArrow(run, "label int, prediction int, n double, loss double")
    return rows.groupBy("label", "prediction").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def validation_summary(cells: DataFrame) -> DataFrame:
    """Loss per row, accuracy and support-weighted F1 as one row, from at most classes^2 rows."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("called")),
        F.struct(F.col("prediction").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("called")),
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0.0)
    whole = cells.agg(
        (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum(hit) / F.sum("n")).alias("accuracy")
    )
    per_class = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called")
    )
    hits = cells.where("label = prediction").select(F.col("label").alias("class"), F.col("n").alias("hits"))
    f1 = per_class.join(hits, "class", "left").agg(
        F.sum(F.col("support") * 2 * F.coalesce("hits", F.lit(0.0)) / (F.col("support") + F.col("called")))
        / F.sum("support")
    )
    return whole.withColumn("f1", f1.scalar())


def _summary(cells) -> tuple:
    """The same of collected rows, once an epoch."""
    n = sum(c["n"] for c in cells)
    f1 = 0.0
    for label in {c["label"] for c in cells}:
        support = sum(c["n"] for c in cells if c["label"] == label)
        called = sum(c["n"] for c in cells if c["prediction"] == label)
        hits = sum(c["n"] for c in cells if c["label"] == label == c["prediction"])
        f1 += support * 2 * hits / (support + called)
    accuracy = sum(c["n"] for c in cells if c["label"] == c["prediction"]) / n
    return sum(c["loss"] for c in cells) / n, accuracy, f1 / n


HISTORY_SCHEMA = "epoch int, train_loss double, val_loss double, val_accuracy double, val_f1 double, domain_loss double"


def train_fusion(
    train: DataFrame,
    validation: DataFrame,
    shape: FusionShape,
    *,
    id_column="id",
    epochs=CONFIG["num_epochs"],
    patience: int | None = CONFIG["patience"],
    learning_rate=CONFIG["learning_rate"],
    dropout=CONFIG["dropout"],
    seed=CONFIG["seed"],
    batch_size=CONFIG["batch_size"],
    steps_per_epoch: int | None = None,
    adversarial_lambda=None,
):
    """Cross-entropy with Adam, early stopping on validation loss, best epoch kept.

    An epoch is a step for every ``batch_size`` rows, in an order drawn anew by a hash of the row. With ``steps_per_epoch``
    it is so many steps, each one Spark job over the rows of a hash bucket.
    ``patience=None`` runs every epoch. ``adversarial_lambda`` (a number, or a
    function of the epoch) trains the domain head on ``domain_label`` and reverses
    its gradient into the encoder. Returns the model and the history frame.
    """
    spark = train.sparkSession
    columns = [*INPUTS, "label"] + (["domain_label"] if adversarial_lambda is not None else [])
    check_features(train, shape)
    check_features(validation, shape)
    key = F.xxhash64(F.col(id_column).cast("string")).alias("_key")
    # read every epoch: one reliable copy, cached on executors where it fits
    row = F.xxhash64(*columns).alias("_row")  # tells apart what shares an id
    train = materialize(train.select(*columns, key, row)).persist()
    validation = materialize(validation.select(*INPUTS, "label")).persist()
    partitions = train.rdd.getNumPartitions()

    flat = shape.init(seed)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat))
    best = (float("inf"), flat)
    history, waited, step = [], 0, 0
    for epoch in range(1, epochs + 1):
        lam = adversarial_lambda(epoch) if callable(adversarial_lambda) else adversarial_lambda
        epoch_totals = np.zeros(4)
        if steps_per_epoch is None:
            order = F.xxhash64("_key", "_row", F.lit(seed + epoch))
            epoch_totals, state, step = train_epoch(
                train, shape, state, order=order, size=batch_size, step=step, learning_rate=learning_rate, rate=dropout,
                seed=seed, lam=lam,
            )
        for bucket in range(steps_per_epoch or 0):
            rows = train
            if steps_per_epoch > 1:
                mixed = F.xxhash64("_key", F.lit(seed + epoch))
                rows = train.where(F.pmod(mixed, F.lit(steps_per_epoch)) == bucket)
            params = spark.sparkContext.broadcast(state[0])
            totals, grad = sum_gradients(
                gradient_rows(rows, shape, params, step=step, rate=dropout, seed=seed, lam=lam),
                partitions,
            )
            params.unpersist()
            step += 1
            epoch_totals += totals
            state = adam(state, _mean_gradient(totals, grad.reshape(-1, flat.size)), step, learning_rate)

        flat = state[0]
        params = spark.sparkContext.broadcast(flat)
        val_loss, val_accuracy, val_f1 = _summary(
            validation_counts(validation, shape, params).collect()
        )
        params.unpersist()
        n_rows, class_rows, class_loss, domain_loss = epoch_totals
        history.append(
            (epoch, float(class_loss / max(class_rows, 1.0)), float(val_loss), float(val_accuracy),
             float(val_f1), float(domain_loss / n_rows) if lam is not None else None)
        )
        if val_loss < best[0]:
            best, waited = (val_loss, flat), 0
        else:
            waited += 1
        if patience is not None and waited >= patience:
            break
    train.unpersist()
    validation.unpersist()
    return FittedFusion(shape, best[1]), spark.createDataFrame(history, HISTORY_SCHEMA)
