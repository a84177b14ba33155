"""Ensemble neural models: bootstrapped multilayer perceptrons, alone or on top
of the linear model.

Members are trained in parallel, a few to a task where there are fewer cores than
members, and applied batch by batch with the weights inside the function.  Every
member draws its bootstrap from all rows.  These are standardised and packed into
blocks once; each task streams all blocks to a scratch file and reads mini-batches
from there, so memory holds two row numbers (of 4 bytes below 2^31 rows) a row and
member and no features.  Steps are taken in single precision.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import with_keys
from fluxspan.operators.calibrate import CalibrationResult, calibrate
from fluxspan.operators.features import add_features, dot
from fluxspan.operators.segments import check_segments, rows_in_segments
from fluxspan.schema import COL_BTOTAL, COL_BX, COL_BY, COL_BZ, COL_DELTA_B, COL_TMI_COMPENSATED, FLIGHT, ROW, TERMS
from fluxspan.shared import checkpointed

RAW = [COL_BX, COL_BY, COL_BZ]
#: Of the numbers a member is trained on.
SINGLE = np.float32
#: Rows of a packed block; positions of a flight that are put in order together; rows predicted at once.
PACK, CHUNK, SLICE = 64, 65_536, 500
#: Most members trained by one task.
TOGETHER = 4


@dataclass(frozen=True)
class NNConfig:
    hidden_layer_sizes: tuple[int, ...] = (64, 64)
    activation: str = "relu"
    max_iter: int = 500
    n_estimators: int = 20
    random_state: int = 42


@dataclass(frozen=True)
class PINNConfig(NNConfig):
    physics_lambda: float = 1e-3
    tl_model_terms: str = "c"
    nn_feature_terms: str = "b"
    tl_pipeline_config: PipelineConfig | None = None

    def linear_config(self) -> PipelineConfig:
        return self.tl_pipeline_config or PipelineConfig(model_terms=self.tl_model_terms)


@dataclass(frozen=True)
class Ensemble:
    """Standardised inputs, then one weight set per member."""

    mean: np.ndarray
    scale: np.ndarray
    members: list[list[tuple[np.ndarray, np.ndarray]]]
    activation: str

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, out = (x - self.mean) / self.scale, np.empty((len(self.members), len(x)))
        for at in range(0, len(x), SLICE):  # few enough rows to stay in the processor's cache
            for own, m in zip(out, self.members):
                own[at : at + SLICE] = forward(z[at : at + SLICE], m, self.activation)[:, 0]
        return out.mean(axis=0), out.std(axis=0)


@dataclass(frozen=True)
class NNCalibrationResult:
    ensemble: Ensemble
    residuals: DataFrame
    config: NNConfig


@dataclass(frozen=True)
class PINNCalibrationResult:
    linear: CalibrationResult
    ensemble: Ensemble
    residuals: DataFrame
    config: PINNConfig
    linear_config: PipelineConfig = field(default_factory=PipelineConfig)


@lru_cache(maxsize=8)
def _zeros(shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    return np.zeros(shape, kind)


def _clear(delta: np.ndarray, a: np.ndarray) -> np.ndarray:
    """``delta`` where a > 0, else 0, by bits: a product with booleans would be
    converted piece by piece.  ``a`` is used up."""
    bits = a.view(f"i{a.itemsize}")
    np.negative(bits, out=bits)
    np.right_shift(bits, 8 * a.itemsize - 1, out=bits)  # all ones where a > 0
    kept = delta.view(bits.dtype)
    np.bitwise_and(kept, bits, out=kept)
    return delta


#: Both in place: the activation of z; delta by its slope, from the activation a.
_ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, _zeros(z.shape[-2:], z.dtype), out=z), _clear),
    "tanh": (lambda z: np.tanh(z, out=z), lambda delta, a: np.multiply(delta, 1 - a * a, out=delta)),
    "logistic": (lambda z: np.divide(1, 1 + np.exp(-z), out=z), lambda delta, a: np.multiply(delta, a * (1 - a), out=delta)),
    "identity": (lambda z: z, lambda delta, a: delta),
}


def forward(x: np.ndarray, layers, activation: str) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w
        x += b
        if i < len(layers) - 1:
            _ACTIVATIONS[activation][0](x)
    return x


def _blocks(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Views of ``flat`` (of its last axis): per layer the weights, by outputs,
    with the biases as last column."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(flat[..., at : at + (a + 1) * b].reshape(*flat.shape[:-1], b, a + 1))
        at += (a + 1) * b
    return out


def _layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(w[:, :-1].T, w[:, -1]) for w in _blocks(flat, sizes)]


def train_member(x: np.ndarray, y: np.ndarray, config: NNConfig, seed: int, penalty: float = 1e-4, pick: np.ndarray | None = None):
    """One perceptron by Adam on squared error, stopping when the loss no longer
    improves (ten epochs in a row).  ``pick``: the rows to train on, all if None."""
    (flat,) = _descend(np.c_[x, y].astype(SINGLE), [np.arange(len(x)) if pick is None else pick], config, [seed], penalty)
    return _layers(flat, [x.shape[1], *config.hidden_layer_sizes, 1])


def _descend(held: np.ndarray, picks: list[np.ndarray], config: NNConfig, seeds: list[int], penalty: float) -> list[np.ndarray]:
    """The weights (see ``_blocks``) of one member per pick, after training on
    those rows of ``held`` (features, then target); all picks are equally long.

    Members take their steps side by side, each on its own rows and by its own
    stopping, as the calls of a step cost about as much as the numbers of one member.
    """
    sizes, last = [held.shape[1] - 1, *config.hidden_layer_sizes, 1], len(config.hidden_layer_sizes)
    reach = 6.0 if config.activation != "logistic" else 2.0
    activate, damp = _ACTIVATIONS[config.activation]
    rngs, own, n = [np.random.default_rng(seed) for seed in seeds], np.arange(len(seeds)), len(picks[0])
    flat = np.empty((len(own), sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:]))), SINGLE)
    decay = np.full(flat.shape[1], penalty, SINGLE)
    for w, d in zip(_blocks(flat, sizes), _blocks(decay, sizes)):
        b, a = d.shape
        bound = math.sqrt(reach / (a - 1 + b))
        for m, rng in enumerate(rngs):
            w[m, :, :-1], w[m, :, -1] = rng.uniform(-bound, bound, (a - 1, b)).T, rng.uniform(-bound, bound, b)
        d[:, -1] = 0  # biases aren't held back
    first, second, order = np.zeros_like(flat), np.zeros_like(flat), np.empty((len(own), n), picks[0].dtype)
    batch, step, best, stale, found = min(200, n), 0, np.full(len(own), np.inf), np.zeros(len(own), int), [None] * len(own)

    def space(size: int):
        """Of a step: values (their last column is 1) and deltas of the hidden layers (0)."""
        outs, deltas = ([make((len(own), size, s + 1), SINGLE) for s in sizes[1:-1]] for make in (np.ones, np.zeros))
        return outs, [v[:, :, :-1] for v in outs], deltas, [v[:, :, :-1] for v in deltas]

    full = None
    for _ in range(config.max_iter):
        if full is None:  # at first, and when members have stopped
            full, grad, spare = space(batch), np.empty_like(flat), np.empty_like(flat)
            grads, blocks = _blocks(grad, sizes), _blocks(flat, sizes)
            ahead, back = [w.transpose(0, 2, 1) for w in blocks], [w[:, :, :-1] for w in blocks]
        for m, i in enumerate(own):
            order[m] = picks[i]
            rngs[i].shuffle(order[m])
        loss = np.zeros(len(own))
        for at in range(0, n, batch):
            rows = held.take(order[:, at : at + batch], axis=0)
            size = rows.shape[1]
            outs, values, deltas, slopes = full if size == batch else space(size)
            error = -rows[:, :, -1]
            rows[:, :, -1] = 1
            x = rows
            for i in range(last):
                np.matmul(x, ahead[i], out=values[i])
                x = activate(outs[i])
                x[:, :, -1] = 1
            error += np.matmul(x, ahead[last])[:, :, 0]
            np.multiply(flat, decay, out=spare)
            loss += (np.matmul(error[:, None], error[:, :, None]) + np.matmul(spare[:, None], flat[:, :, None]))[:, 0, 0] / 2
            error /= size
            delta = error[:, :, None]
            for i in range(last, -1, -1):
                np.matmul(delta.transpose(0, 2, 1), outs[i - 1] if i else rows, out=grads[i])
                if i:
                    # of one output: an outer product, for which matmul doesn't use the library
                    (np.multiply if i == last else np.matmul)(delta, back[i], out=slopes[i - 1])
                    damp(deltas[i - 1], outs[i - 1])
                    delta = slopes[i - 1]
            spare /= size
            grad += spare
            # Adam's moments, without their factors 0.1 and 0.001
            step += 1
            first *= 0.9
            first += grad
            second *= 0.999
            grad *= grad
            second += grad
            np.sqrt(second, out=spare)
            spare += 1e-8 / math.sqrt(0.001)
            np.divide(first, spare, out=spare)
            spare *= 1e-3 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) * 0.1 / math.sqrt(0.001)
            flat -= spare
            if step % 100 == 0:  # what decays for good must not become denormal, which is slow
                for v in (flat, first, second):
                    v[np.abs(v) < 1e-20] = 0
        loss /= n
        stale = np.where(loss > best - 1e-4, stale + 1, 0)
        best = np.minimum(best, loss)
        if (over := stale >= 10).any():
            for m in np.flatnonzero(over):
                found[own[m]] = flat[m].copy()
            own, flat, first, second, best, stale, order, full = *(v[~over] for v in (own, flat, first, second, best, stale)), order[: np.sum(~over)], None
            if not len(own):
                break
    for m, i in enumerate(own):
        found[i] = flat[m]
    return found


def _packed(rows: DataFrame, features: list[str], target: str, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Standardised rows in blocks: flight and position of a block's first row,
    its place among the blocks of its task, and its numbers.  In the order of the
    first three the blocks hold the rows in theirs."""
    slim = rows.select(FLIGHT, ROW, F.floor(F.col(ROW) / CHUNK).alias("_chunk"), *features, target)
    dealt = slim.repartition(FLIGHT, "_chunk").sortWithinPartitions(FLIGHT, ROW, *features, target)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth = 0
        for pdf in batches:
            held = np.c_[(pdf[features].to_numpy(float) - mean) / scale, pdf[target].to_numpy(float)].astype(SINGLE)
            keys, at = pdf[[FLIGHT, "_chunk"]], np.arange(len(pdf))
            new = (keys != keys.shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % PACK == 0)
            data = [held[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(pdf)])]
            yield pdf[[FLIGHT, ROW]].iloc[cuts].assign(nth=np.arange(nth, nth + len(cuts)), data=data)
            nth += len(cuts)

    return dealt.mapInPandas(run, f"{FLIGHT} {kind[FLIGHT]}, {ROW} {kind[ROW]}, nth bigint, data binary")


def _groups(members: int, cores: int) -> list[list[int]]:
    """Members by task: as many tasks as keep all cores busy to the end, of at
    most ``TOGETHER`` members."""
    tasks = min(members, cores * math.ceil(members / (cores * TOGETHER)))
    return [group.tolist() for group in np.array_split(np.arange(members), tasks)]


def _train(rows: DataFrame, features: list[str], target: str, config: NNConfig, penalty: float) -> Ensemble:
    """All members on bootstrap samples of the same standardised rows."""
    rows = checkpointed(rows.select(FLIGHT, ROW, *features, target))  # read for their spread, then packed
    _, *stats = rows.agg(F.count("*"), *[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    k = len(features)
    mean, scale = np.array(stats[:k], float), np.array(stats[k:], float)
    scale[scale == 0] = 1.0
    # written once and read whole by every member's task, so nothing is shuffled per member
    blocks = checkpointed(_packed(rows, features, target, mean, scale)).rdd.coalesce(1)

    sc = rows.sparkSession.sparkContext

    def fit(members: list[int]):
        def run(parts: Iterator) -> Iterator[tuple[int, np.ndarray]]:
            with tempfile.NamedTemporaryFile(prefix="fluxspan-nn-") as scratch:
                marks, at = [], 0
                for flight, row, nth, data in parts:
                    n = scratch.write(data) // (SINGLE().itemsize * (k + 1))
                    marks.append((flight, row, nth, at, n))
                    at += n
                scratch.flush()
                held = np.asarray(np.memmap(scratch.name, SINGLE, "r")).reshape(-1, k + 1)
                place = np.concatenate([np.arange(a, a + n) for *_, a, n in sorted(marks)])
                del marks
                place = place.astype(np.min_scalar_type(-len(held)))  # row numbers as short as they can be
                seeds = [config.random_state + member for member in members]
                picks = [place[np.random.default_rng(seed).integers(0, len(held), len(held))] for seed in seeds]
                del place
                yield from zip(members, _descend(held, picks, config, seeds, penalty))

        return run

    # neither sorted nor ranged by Spark, which would train all members a second time to sample the keys
    found = dict(sc.union([blocks.mapPartitions(fit(members)) for members in _groups(config.n_estimators, sc.defaultParallelism)]).collect())
    sizes = [k, *config.hidden_layer_sizes, 1]
    return Ensemble(mean, scale, [_layers(found[i].astype(float), sizes) for i in range(config.n_estimators)], config.activation)


def with_prediction(df: DataFrame, ensemble: Ensemble, features: list[str], mean: str = "nn_mean", std: str = "nn_std") -> DataFrame:
    """Adds the ensemble's mean and population spread, batch by batch; only the
    features go through Python."""

    @F.pandas_udf("mean double, std double")
    def predicted(*columns: pd.Series) -> pd.DataFrame:
        m, s = ensemble.predict(np.column_stack([c.to_numpy(float) for c in columns]))
        return pd.DataFrame({"mean": m, "std": s})

    names = df.columns
    return df.withColumn("_predicted", predicted(*features)).select(*names, F.col("_predicted.mean").alias(mean), F.col("_predicted.std").alias(std))


def _checked(df: DataFrame, segments: DataFrame, config: NNConfig) -> DataFrame:
    if config.n_estimators < 1:
        raise ValueError("n_estimators must be at least 1")
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    keyed = with_keys(df)
    check_segments(keyed, segments)
    return keyed


def calibrate_nn(df: DataFrame, segments: DataFrame, config: NNConfig = NNConfig()) -> NNCalibrationResult:
    """Ensemble from the raw vector components to ``delta_B``; needs no other columns."""
    rows = rows_in_segments(_checked(df, segments, config), segments)
    ensemble = _train(rows, RAW, COL_DELTA_B, config, 1e-4)
    slim = rows.select(FLIGHT, "seg_ord", ROW, *RAW, COL_DELTA_B)
    residuals = with_prediction(slim, ensemble, RAW).select(FLIGHT, "seg_ord", ROW, (F.col("nn_mean") - F.col(COL_DELTA_B)).alias("residual"))
    return NNCalibrationResult(ensemble, residuals, config)


def predict_nn(df: DataFrame, result: NNCalibrationResult) -> DataFrame:
    """``df`` with nn_mean and nn_std."""
    return with_prediction(with_keys(df), result.ensemble, RAW)


def compensate_nn(df: DataFrame, result: NNCalibrationResult) -> DataFrame:
    out = predict_nn(df, result)
    return out.withColumn(COL_TMI_COMPENSATED, F.col(COL_BTOTAL) - F.col("nn_mean")).drop("nn_mean", "nn_std")


def _pinn_features(config: PINNConfig) -> PipelineConfig:
    return PipelineConfig(model_terms=config.nn_feature_terms)


def _with_linear(df: DataFrame, linear: CalibrationResult, config: PipelineConfig, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with the modelled interference as ``_linear``."""
    modelled = dot(linear.coefficients, TERMS[config.model_terms]).alias("_linear")
    return add_features(df, config, keys).select(*df.columns, modelled)


def calibrate_pinn(df: DataFrame, segments: DataFrame, config: PINNConfig = PINNConfig()) -> PINNCalibrationResult:
    """Linear fit first, then an ensemble on what it leaves, held back by ``physics_lambda``."""
    if not 0 <= config.physics_lambda < math.inf:
        raise ValueError("physics_lambda must be finite and not negative")
    keyed = _checked(df, segments, config)
    linear_config = config.linear_config()
    linear = calibrate(keyed, segments, linear_config)
    features = list(TERMS[config.nn_feature_terms])
    rows = rows_in_segments(keyed, segments)
    # what the linear model leaves is reckoned beside the features: nothing is joined row by row
    left = _with_linear(rows, linear, linear_config, (FLIGHT, "seg_ord")).withColumn("_target", F.col(COL_DELTA_B) - F.col("_linear"))
    slim = add_features(left, _pinn_features(config), (FLIGHT, "seg_ord")).select(FLIGHT, "seg_ord", ROW, *features, "_target", (-F.col("_target")).alias("residual"))
    ensemble = _train(slim, features, "_target", config, config.physics_lambda)
    residuals = with_prediction(slim, ensemble, features).select(FLIGHT, "seg_ord", ROW, (F.col("residual") + F.col("nn_mean")).alias("residual"))
    return PINNCalibrationResult(linear, ensemble, residuals, config, linear_config)


def predict_pinn(df: DataFrame, result: PINNCalibrationResult) -> DataFrame:
    """``df`` with pinn_mean (linear and ensemble) and pinn_std (ensemble only)."""
    keyed = with_keys(df)
    features = list(TERMS[result.config.nn_feature_terms])
    if len(features) != len(result.ensemble.mean):
        raise ValueError("the feature terms don't match the trained ensemble")
    linear = _with_linear(keyed, result.linear, result.linear_config, (FLIGHT,))
    predicted = with_prediction(add_features(linear, _pinn_features(result.config)).select(*keyed.columns, "_linear", *features), result.ensemble, features, "_nn", "pinn_std")
    return predicted.withColumn("pinn_mean", F.col("_linear") + F.col("_nn")).select(*keyed.columns, "pinn_mean", "pinn_std")


def compensate_pinn(df: DataFrame, result: PINNCalibrationResult) -> DataFrame:
    out = predict_pinn(df, result)
    return out.withColumn(COL_TMI_COMPENSATED, F.col(COL_BTOTAL) - F.col("pinn_mean")).drop("pinn_mean", "pinn_std")
