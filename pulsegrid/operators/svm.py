"""One-versus-rest linear SVM by (sub)gradient descent, all classes in the same jobs, and the library's SVM.

Objective per class: ``½‖w‖² + C Σ max(0, 1 - y(w·x + b))``. One pass over the points gives the loss of the present
weights and the gradient of the next step for every class. Points are read as chunk rows, so margins of all points
against all classes of a scope are one matrix product per chunk.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import uniform
from ..plans.chunked import add_up, add_up_packed, packed_cells, per_group
from ..plans.spread import Spread, materialize, number_rows, spread
from ..session import KEYS
from .kmeans import one_interval
from .moments import points_of

SCOPE = KEYS[:2]
PENALTY = 100.0


@dataclass(frozen=True)
class Descent:
    rate: float
    epsilon: float
    batch: int | None  # None: all points
    smoothed: bool  # compare a running mean of the change instead of the change


# Fixed values of the workload.
MODES = {
    "BGD": Descent(rate=0.0000003, epsilon=0.25, batch=None, smoothed=False),
    "SGD": Descent(rate=0.0001, epsilon=0.001, batch=1, smoothed=True),
    "MBGD": Descent(rate=0.00001, epsilon=0.01, batch=20, smoothed=True),
}


def descent(mode: str) -> Descent:
    if mode not in MODES:
        raise ValueError(f"unsupported gradient descent {mode!r}")
    return MODES[mode]


PATIENCE = 1_000
STEP_ROWS, TASK_ROWS = 10_000, 100_000
HELD_BYTES = 16 * 1024 * 1024  # sums of one step, of all tasks, that the driver adds up itself
STATE = ["labels", "w", "b", "loss", "change", "best", "stale", "done", "steps"]


def model_bytes(width: int) -> int:
    return 8 * (width + 9)


def scope_bytes(points: Spread, models: int, width: int) -> int:
    """Average size of the models of one scope."""
    return -(-models * model_bytes(width) // max(points.groups, 1)) + 64


def start_state(labelled: DataFrame, scope: list[str], width: int) -> DataFrame:
    """Training state, one row per scope with parallel arrays: zero weights for every distinct label, in order."""
    labels = labelled.groupBy(*scope, "label").agg(F.lit(1)).groupBy(*scope).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    zeros = F.array_repeat(F.lit(0.0), F.size("labels"))
    return labels.select(
        *scope,
        F.col("labels").cast("array<double>").alias("labels"),
        F.array_repeat(F.lit(0.0), F.size("labels") * width).alias("w"),
        zeros.alias("b"),
        F.array_repeat(F.lit(float("nan")), F.size("labels")).alias("loss"),
        F.array_repeat(F.lit(float("inf")), F.size("labels")).alias("best"),
        *[zeros.alias(c) for c in ("change", "stale", "done", "steps")],
    )


def models_of(state: DataFrame, scope: list[str], width: int) -> DataFrame:
    """``scope…, label, w, b, loss, done, steps`` from the training state. Models that are stuck are not ``done``."""
    at = F.col("_i")
    cell = lambda c: F.get(F.col(c), at)
    return state.select(*scope, *STATE, F.explode(F.sequence(F.lit(0), F.size("labels") - 1)).alias("_i")).select(
        *scope,
        cell("labels").cast("int").alias("label"),
        F.slice("w", at * width + 1, width).alias("w"),
        cell("b").alias("b"),
        cell("loss").alias("loss"),
        (cell("done") == 1).alias("done"),
        cell("steps").cast("int").alias("steps"),
    )


def state_of(models: DataFrame, scope: list[str]) -> DataFrame:
    """Parallel arrays ``labels, w, b`` per scope from a table of models, in label order."""
    rows = F.array_sort(F.collect_list(F.struct("label", "w", "b")))
    packed = models.groupBy(*scope).agg(rows.alias("_m"))
    return packed.select(
        *scope,
        F.col("_m")["label"].cast("array<double>").alias("labels"),
        F.flatten(F.col("_m")["w"]).alias("w"),
        F.col("_m")["b"].alias("b"),
    )


def _sums_of(step: int, batched: bool) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    """Of a chunk and its models: hinge sum, gradient of b and gradient of w for each model."""

    def statistic(cells: dict[str, np.ndarray]) -> np.ndarray:
        x = points_of(cells)
        w = cells["w"].reshape(len(cells["labels"]), -1)
        y = np.where(cells["label"][:, None] == cells["labels"], 1.0, -1.0)
        margin = y * (x @ w.T + cells["b"])
        pull = np.where(margin < 1, -y, 0.0)
        if batched:
            pull[cells["batch"] != step % cells["batches"]] = 0.0
        hinge = np.maximum(0.0, 1.0 - margin).sum(axis=0)
        return np.concatenate([hinge[:, None], pull.sum(axis=0)[:, None], pull.T @ x], axis=1).reshape(-1)

    return statistic


def _point_columns(batched: bool) -> list[str]:
    return ["event_ids", "x", "label", *(["batch", "batches"] if batched else [])]


def loss_and_gradient(chunks: Spread, state: DataFrame, row_bytes: int, step: int = 0, batched: bool = False) -> DataFrame:
    """``scope…, stats``: per model, the hinge sum over all points and the gradient sums over the batch of ``step``.

    ``stats`` is (hinge, gradient of b, gradient of w) for each model.
    """
    used = [*_point_columns(batched), "labels", "w", "b"]
    return add_up(chunks.attach(state, row_bytes), chunks.keys, used, _sums_of(step, batched))


def _walk(plan: Descent, evaluate: bool, penalty: float, patience: int) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """One step of the models of a scope, from their state and ``stats``."""

    def walk(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        models = len(cells["labels"])
        w, b, loss, change = cells["w"].reshape(models, -1), cells["b"], cells["loss"], cells["change"]
        parts = cells["stats"].reshape(models, -1)
        live = cells["done"] == 0
        stop, best, stale, done = ~live, cells["best"], cells["stale"], cells["done"]
        if evaluate:
            fresh = 0.5 * (w * w).sum(axis=1) + penalty * parts[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                percent = np.abs(loss - fresh) / loss * 100
            # The first evaluation has no earlier loss: nothing is compared, nothing is averaged.
            tested = ~np.isnan(loss)
            moved = np.where(tested, 0.5 * change + 0.5 * percent if plan.smoothed else percent, change)
            stop = stop | (tested & (moved < plan.epsilon)) | (fresh == 0)
            done = np.where(live & stop, 1.0, done)
            stale = np.where(fresh < best, 0.0, stale + 1)
            best = np.minimum(best, fresh)
            done = np.where((done == 0) & (stale >= patience), 2.0, done)
            stop = done > 0
            loss, change = np.where(live, fresh, loss), np.where(live, moved, change)
        go = ~stop
        w = np.where(go[:, None], w - plan.rate * (w + penalty * parts[:, 2:]), w)
        b = np.where(go, b - plan.rate * penalty * parts[:, 1], b)
        new = {"labels": cells["labels"], "w": w, "b": b, "loss": loss, "change": change, "best": best, "stale": stale}
        return new | {"done": done, "steps": cells["steps"] + go}

    return walk


def advance(
    chunks: Spread, state: DataFrame, plan: Descent, row_bytes: int, step: int, penalty: float, eval_every: int, batched: bool, patience: int = PATIENCE
) -> DataFrame:
    """Test each model for convergence with the loss of its weights, then take one step if it has not converged.

    ``done`` becomes 1 for a model that has met its stop rule, and 2 for one whose loss has not gone below its best in
    ``patience`` tests: it is stuck, and its rule may never be met.
    """
    sums = loss_and_gradient(chunks, state.select(*chunks.keys, "labels", "w", "b"), row_bytes, step, batched)
    walk = _walk(plan, step % eval_every == 0, penalty, patience)
    return per_group(sums.join(state, chunks.keys), chunks.keys, ["stats", *STATE], STATE, walk)


def _step_tasks(points: Spread) -> int:
    """Tasks of a step: one for each ``STEP_ROWS`` points up to the number of cores, more only if they would be large."""
    cores = points.sizes.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-points.total // STEP_ROWS)), -(-points.total // TASK_ROWS))


def _descend_held(
    chunks: Spread, state: DataFrame, tasks: int, plan: Descent, max_steps: int | None, until_done: bool, penalty: float, eval_every: int, batched: bool, patience: int
) -> DataFrame:
    """All steps with the models on the driver: a step is one job of one stage over points that executors keep.

    A descent takes a thousand steps and more, so what a step costs besides its sums decides. Points stay in the tasks;
    each hands on one vector per scope. Points that are lost are read from ``chunks`` again.
    """
    session, keys = state.sparkSession, chunks.keys
    packed = packed_cells(chunks.points, keys, _point_columns(batched)).repartition(tasks)
    held = packed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    models = {tuple(r[k] for k in keys): {c: np.array(r[c], dtype=np.float64) for c in STATE} for r in state.collect()}
    try:
        for step in itertools.count() if max_steps is None else range(max_steps):
            sums = add_up_packed(held, {k: {c: m[c] for c in ("labels", "w", "b")} for k, m in models.items()}, _sums_of(step, batched))
            walk = _walk(plan, step % eval_every == 0, penalty, patience)
            models = {k: walk(m | {"stats": sums[k]}) for k, m in models.items() if k in sums}
            if until_done and all((m["done"] != 0).all() for m in models.values()):
                break
    finally:
        held.unpersist()
    rows = [(*k, *[np.ravel(m[c]).tolist() for c in STATE]) for k, m in models.items()]
    return session.createDataFrame(rows, state.select(*keys, *STATE).schema)


def with_batches(labelled: DataFrame, scope: list[str], batch: int, seed: int) -> DataFrame:
    """Seeded shuffle and batch number: position in hash order, cut every ``batch`` rows."""
    order = [c for c in ("event_id", "channel") if c in labelled.columns]
    drawn = labelled.withColumn("_u", uniform(seed, 0, *[F.col(c) for c in order]))
    placed = number_rows(drawn, scope, ["_u", *order], "_at").drop("_u")
    sized = materialize(placed)
    groups = spread(sized, scope)
    return groups.attach(groups.sizes.select(*scope, F.ceil(F.col("n") / batch).alias("batches"))).select(
        *labelled.columns, F.floor(F.col("_at") / batch).alias("batch"), "batches"
    )


def fit_svm(
    labelled: DataFrame,
    mode: str = "MBGD",
    width: int = 10,
    scope: list[str] = SCOPE,
    penalty: float = PENALTY,
    max_steps: int | None = None,
    fixed_steps: int | None = None,
    eval_every: int = 1,
    seed: int = 1,
    patience: int = PATIENCE,
) -> DataFrame:
    """``scope…, label, w, b, loss, done, steps`` from ``scope…, event_id, x, label``.

    Steps go on until every class has met the stop rule of its mode (``done``), is stuck, or ``max_steps`` were taken.
    A class is stuck, and not ``done``, if its loss has not fallen below its best in ``patience`` tests.
    ``fixed_steps`` takes exactly that many steps without testing, and leaves the loss before the last one.
    """
    plan = descent(mode)
    batched = plan.batch is not None
    if batched:
        labelled = with_batches(labelled, scope, plan.batch, seed)
    points = spread(labelled, scope)
    state = materialize(start_state(labelled, scope, width))
    models = state.agg(F.coalesce(F.sum(F.size("labels")), F.lit(0))).first()[0]
    row_bytes = scope_bytes(points, models, width)
    chunks = points.chunks(["x", "label", *(["batch", "batches"] if batched else [])], row_bytes).settle()
    if fixed_steps is not None:
        plan, max_steps, patience = replace(plan, epsilon=-1.0), fixed_steps, fixed_steps + 1
    tasks = _step_tasks(chunks)
    if chunks.groups * row_bytes * tasks <= HELD_BYTES:
        state = _descend_held(chunks, state, tasks, plan, max_steps, fixed_steps is None, penalty, eval_every, batched, patience)
        return models_of(state, scope, width)
    for step in itertools.count() if max_steps is None else range(max_steps):
        state = chunks.hold(advance(chunks, state, plan, row_bytes, step, penalty, eval_every, batched, patience), row_bytes)
        if fixed_steps is None and state.filter("exists(done, d -> d = 0)").isEmpty():
            break
    return models_of(state, scope, width)


def svm_loss(labelled: DataFrame, models: DataFrame, width: int, scope: list[str] = SCOPE, penalty: float = PENALTY) -> DataFrame:
    """``scope…, label, loss`` of given models."""
    points = spread(labelled, scope)
    row_bytes = scope_bytes(points, models.count(), width)
    state = materialize(state_of(models, scope))
    sums = loss_and_gradient(points.chunks(["x", "label"], row_bytes), state, row_bytes).join(state, scope)

    def total(cells: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w = cells["w"].reshape(len(cells["labels"]), -1)
        hinge = cells["stats"].reshape(len(w), -1)[:, 0]
        return {"labels": cells["labels"], "loss": 0.5 * (w * w).sum(axis=1) + penalty * hinge}

    losses = per_group(sums, scope, ["stats", "labels", "w"], ["labels", "loss"], total)
    return losses.select(*scope, F.explode(F.arrays_zip("labels", "loss")).alias("_m")).select(
        *scope, F.col("_m.labels").cast("int").alias("label"), "_m.loss"
    )


def predict(samples: DataFrame, models: DataFrame, scope: list[str] = SCOPE, width: int = 10) -> DataFrame:
    """Samples with ``predicted`` and ``score``: the class of highest ``w·x + b``, the lowest label on ties.

    Samples travel whole in chunk rows, and a chunk meets the models of its scope as one matrix, so scores are a
    matrix product in a task. A sample of a scope without a model stays, with nulls, as does one without ``x``.
    """
    number = F.col("event_id") if "event_id" in samples.columns else F.xxhash64("x")
    vector = F.coalesce(F.col("x"), F.array_repeat(F.lit(float("nan")), width))
    packed = samples.select(*scope, number.cast("bigint").alias("event_id"), vector.alias("x"), F.struct(*[F.col(f"`{c}`") for c in samples.columns]).alias("_s"))
    points = spread(packed, scope)
    size = scope_bytes(points, models.count(), width)
    rows = points.chunks(["x", "_s"], size).attach(state_of(models, scope), size, "left").select("_s", "x", "labels", "w", "b")
    labels, scores = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([rows.schema["_s"], T.StructField("predicted", labels), T.StructField("score", scores)])
    scored = rows.mapInArrow(_scored, schema).select(F.explode(F.arrays_zip("_s", "predicted", "score")).alias("_r"))
    return scored.select(*[F.col(f"_r._s.`{c}`") for c in samples.columns], "_r.predicted", "_r.score")


def _scored(batches):
    for batch in batches:
        parts = []
        for whole, x, labels, w, b in zip(*[batch.column(i) for i in range(5)]):
            n = len(whole)
            if not labels.is_valid:
                parts.append((np.full(n, -1), np.zeros(n), np.zeros(n, bool)))
                continue
            labels, w, b, x = (v.values.to_numpy(zero_copy_only=False) for v in (labels, w, b, x))
            x = x.reshape(n, -1)
            score = x @ w.reshape(len(labels), -1).T + b
            best = score.argmax(axis=1)  # models are in label order, and the first of equal scores is taken
            parts.append((labels[best].astype(np.int32), score[np.arange(n), best], ~np.isnan(x).any(axis=1)))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32))
        label, score, known = (np.concatenate(p) for p in zip(*parts))
        columns = [pa.array(label.astype(np.int32), mask=~known), pa.array(score, mask=~known)]
        made = [pa.ListArray.from_arrays(offsets, c) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["_s", "predicted", "score"])


def library_svm(labelled: DataFrame, penalty: float = PENALTY, max_iter: int = 100) -> DataFrame:
    """``label, w, b`` of the library's one-versus-rest SVM with the same objective, for a table of one interval.

    The library minimises the mean hinge loss plus ``λ/2 ‖w‖²``, so ``λ = 1 / (C n)``.
    """
    one_interval(labelled)
    labels = [r.label for r in labelled.select("label").distinct().orderBy("label").collect()]
    n = labelled.count()
    index = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")) - 1).cast("double")
    vectors = labelled.select(array_to_vector("x").alias("features"), index.alias("label"))
    # Up to eight classes are fitted side by side, an evaluation of the loss a job each: few tasks to each of them, as
    # long as these stay small. Four or fewer partial sums need no further level in the library's tree of sums.
    together = min(8, max(len(labels), 1))
    cores = labelled.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.coalesce(max(-(-cores // together), -(-n // TASK_ROWS)))
    base = LinearSVC(regParam=1.0 / (penalty * n), standardization=False, maxIter=max_iter)
    model = OneVsRest(classifier=base, parallelism=together).fit(vectors)
    rows = [(label, [float(v) for v in m.coefficients], float(m.intercept)) for label, m in zip(labels, model.models)]
    return labelled.sparkSession.createDataFrame(rows, "label int, w array<double>, b double")
