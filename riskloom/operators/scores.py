"""Risk scores: plain and group-penalised logistic models, prediction tables, attribute melt."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.functions.joins import fits_broadcast, lookup_join, salted_join
from riskloom.session import bucketed, materialize, scratch_path
from riskloom.sources.omop import union_all

# Smallest probability inside a logarithm, column of the intercept.
LOG_FLOOR = 1e-15
BIAS = -1
#: Features up to which a fit keeps its few vectors of weights on the driver, as MLlib does; beyond, in a table.
LOCAL_WEIGHTS = 1_000_000
#: Features up to which a fit's second derivatives are a matrix on the driver (32 MB), steps after which it is made
#: anew, and rows that a task writes out in full to add them up.
DENSE_WEIGHTS, DENSE_STEPS, DENSE_ROWS = 2_000, 20, 1_000
PENALTY_MODES = ("unconditional", "conditional", "conditional_pos", "conditional_neg")


def sigmoid(z: Column) -> Column:
    """Logistic function that does not overflow for large negative inputs."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def softmax_score(df: DataFrame, outputs: Sequence[str] = ("output_0", "output_1")) -> DataFrame:
    """Add the class-1 probability and its logarithm from two raw outputs."""
    margin = F.col(outputs[1]) - F.col(outputs[0])
    # log(1 / (1 + e^-m)) without overflow on either side.
    log_prob = -(F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))))
    return df.withColumn("pred_probs", sigmoid(margin)).withColumn("log_prob", log_prob)


def with_vectors(sparse: DataFrame, n_cols: int, name: str = "features") -> DataFrame:
    """Index and value arrays as ML sparse vectors, as a stored table.

    A vector is a struct to Parquet. So the struct is written by SQL expressions and read
    back under the vector type: no row passes a Python function.
    """
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(n_cols).cast("int").alias("size"),
        F.col("indices").cast("array<int>").alias("indices"),
        F.col("values").cast("array<double>").alias("values"),
    )
    path = scratch_path(sparse.sparkSession, "vectors")
    sparse.withColumn(name, vector).write.parquet(path)
    schema = StructType([*[f for f in sparse.schema if f.name != name], StructField(name, VectorUDT())])
    return sparse.sparkSession.read.schema(schema).parquet(path)


def fit_logistic(train: DataFrame, c: float = 0.001, max_iter: int = 1000) -> LogisticRegressionModel:
    """L2-penalised logistic regression to convergence; ``c`` is the inverse strength on the summed loss."""
    n = train.count()
    return LogisticRegression(
        featuresCol="features",
        labelCol="labels",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-12,
    ).fit(train)


def score_logistic(model: LogisticRegressionModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Class-1 probability and raw output per row."""
    return model.transform(df).select(
        *columns,
        F.element_at(vector_to_array("rawPrediction"), 2).alias("outputs"),
        F.element_at(vector_to_array("probability"), 2).alias("pred_probs"),
    )


def prediction_table(
    phases: dict[str, DataFrame], cohort: DataFrame, task: str, row_id: str = "row_id"
) -> DataFrame:
    """Predictions of all phases with their cohort columns and the task name."""
    long = union_all([df.withColumn("phase", F.lit(name)) for name, df in phases.items()])
    return long.join(cohort, row_id).withColumn("task", F.lit(task))


def melt_attributes(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per prediction and attribute, with ``attribute`` and ``group`` columns."""
    rest = [c for c in df.columns if c not in attributes]
    return df.unpivot(rest, list(attributes), "attribute", "group")


def _strata(mode: str) -> Column:
    """Which rows share one penalty term; null rows carry none."""
    label = F.col("labels")
    if mode == "unconditional":
        return F.lit(0)
    if mode == "conditional":
        return label
    if mode == "conditional_pos":
        return F.when(label == 1, label)
    if mode == "conditional_neg":
        return F.when(label == 0, label)
    raise ValueError(f"mode must be one of {PENALTY_MODES}")


def penalty_slopes(scored: DataFrame, mode: str, lam: float, n_rows: int) -> DataFrame:
    """Per row, the derivative of mean loss + lam * penalty with respect to its logit.

    ``scored`` holds ``row_id, labels, group, z``. The penalty is the sum over
    groups of the squared gap between the mean log-probability of the group and
    of its stratum. The groups' means are a small table that is joined back with
    a salt, since a group may hold most rows.
    """
    prob = sigmoid(F.col("z"))
    loss = (prob - F.col("labels")) / F.lit(float(n_rows))
    if lam == 0:
        return scored.select("row_id", loss.alias("slope"))
    log_prob = -(F.greatest(-F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("z")))))
    rows = scored.withColumn("_s", _strata(mode))
    groups = rows.where(F.col("_s").isNotNull()).groupBy("_s", "group").agg(
        F.count(F.lit(1)).alias("_ng"), F.sum(log_prob).alias("_sum")
    )
    # A window over the groups of a stratum; their number is that of the attribute's values.
    stratum = Window.partitionBy("_s")
    size = F.sum("_ng").over(stratum)
    gap = 2.0 * (F.col("_sum") / F.col("_ng") - F.sum("_sum").over(stratum) / size)
    table = (
        groups.withColumns({"_gap": gap, "_n": size})
        .withColumn("_w", F.col("_gap") / F.col("_ng") - F.sum("_gap").over(stratum) / F.col("_n"))
        .select("_s", "group", "_w")
    )
    joined = salted_join(rows, table, ["_s", "group"], spread=["row_id"], how="left")
    pull = F.lit(lam) * F.coalesce(F.col("_w"), F.lit(0.0)) * (1.0 - prob)
    return joined.select("row_id", (loss + pull).alias("slope"))


def _with_bias(long: DataFrame, rows: DataFrame) -> DataFrame:
    """Features of ``rows`` plus a constant 1 under col_id -1."""
    typed = long.select(
        "row_id", F.col("col_id").cast("bigint").alias("col_id"), F.col("value").cast("double").alias("value")
    )
    bias = rows.select("row_id", F.lit(BIAS).cast("bigint").alias("col_id"), F.lit(1.0).alias("value"))
    return typed.join(rows.select("row_id"), "row_id", "left_semi").unionByName(bias)


def _objective(lines: DataFrame, mode: str, lam: float, n_rows: int, steps: Sequence[float]) -> list[float]:
    """Mean loss + lam * penalty at ``z + t * dz`` for several t, by one sum over the rows."""
    sums = []
    for i, t in enumerate(steps):
        z = F.col("z") + F.lit(float(t)) * F.col("dz")
        log_prob = -(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
        # log(1 + e^z) - y z, and log p is -log(1 + e^-z).
        sums += [F.sum((1.0 - F.col("labels")) * z - log_prob).alias(f"l{i}"), F.sum(log_prob).alias(f"p{i}")]
    groups = lines.groupBy(_strata(mode).alias("_s"), "group").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    values = []
    for i in range(len(steps)):
        total = sum(g[f"l{i}"] for g in groups) / n_rows
        for stratum in {g["_s"] for g in groups if g["_s"] is not None} if lam else ():
            own = [g for g in groups if g["_s"] == stratum]
            mean = sum(g[f"p{i}"] for g in own) / sum(g["n"] for g in own)
            total += lam * sum((g[f"p{i}"] / g["n"] - mean) ** 2 for g in own)
        values.append(total)
    return values


def _direction(products: dict[tuple[str, str], float], pairs: Sequence[int]) -> dict[str, float]:
    """Coefficients of the quasi-Newton direction over the basis of steps ``s``, gradient changes ``y``
    and the gradient ``g``, from their scalar products alone (two-loop recursion)."""

    def dot(x: dict[str, float], name: str) -> float:
        return sum(c * products[min(k, name), max(k, name)] for k, c in x.items())

    q, alphas = {"g": -1.0}, {}
    for i in reversed(pairs):
        alphas[i] = dot(q, f"s{i}") / products[f"s{i}", f"y{i}"]
        q[f"y{i}"] = q.get(f"y{i}", 0.0) - alphas[i]
    if pairs:
        last = pairs[-1]
        scale = products[f"s{last}", f"y{last}"] / products[f"y{last}", f"y{last}"]
        q = {k: scale * c for k, c in q.items()}
    for i in pairs:
        beta = dot(q, f"y{i}") / products[f"s{i}", f"y{i}"]
        q[f"s{i}"] = q.get(f"s{i}", 0.0) + alphas[i] - beta
    return q


def fit_score_fair(
    long: DataFrame,
    rows: DataFrame,
    lam: float = 0.0,
    mode: str = "unconditional",
    ridge: float = 0.0,
    tol: float = 1e-8,
    memory: int = 6,
) -> DataFrame:
    """Linear model that minimises mean loss + lam * group penalty + ridge / 2 * |weights|^2.

    ``long`` holds ``row_id, col_id, value`` and ``rows`` holds ``row_id, labels, group``.
    Returns ``col_id, weight`` with the intercept, which has no ridge, under col_id -1.

    Up to ``LOCAL_WEIGHTS`` features :func:`_fit_rows` does it by two short jobs a step. Beyond,
    limited-memory quasi-Newton without a vector on the driver: weights, gradient and the
    last ``memory`` steps are columns of one stored table by feature, and the driver sees
    only their scalar products, of which the direction's coefficients follow. A step needs
    two passes over the features, for the logits of the direction and for the gradient;
    the line search is a sum over rows. The fit ends when no entry of the gradient exceeds
    ``tol``, or when no step along the direction lowers the objective any more (rounding).
    Features are stored bucketed by row id, so only rows and weights move.
    """
    if mode not in PENALTY_MODES:
        raise ValueError(f"mode must be one of {PENALTY_MODES}")
    n_rows = rows.count()
    seen = materialize(_with_bias(long, rows).where(F.col("value").isNotNull()), "seen")
    columns = materialize(seen.select("col_id").where(F.col("col_id").isNotNull()).distinct(), "columns")
    if columns.count() <= LOCAL_WEIGHTS:
        return _fit_rows(seen, columns, rows, n_rows, lam, mode, ridge, tol, memory)
    with bucketed(_with_bias(long, rows), "row_id") as features:

        def gradient(scored: DataFrame) -> DataFrame:
            slopes = penalty_slopes(scored, mode, lam, n_rows)
            return features.join(slopes, "row_id").groupBy("col_id").agg(F.sum(F.col("value") * F.col("slope")).alias("_g"))

        shrink = F.when(F.col("col_id") != BIAS, F.lit(ridge) * F.col("w")).otherwise(0.0)
        scored = rows.withColumn("z", F.lit(0.0))
        state = gradient(scored).select("col_id", F.lit(0.0).alias("w"), F.col("_g").alias("g"))
        state = materialize(state, "state")
        small = fits_broadcast(state.select("col_id", "w"))
        pairs: list[int] = []
        turn = 0
        while True:
            basis = [*[f"{v}{i}" for i in pairs for v in "sy"], "g"]
            wanted = [(a, b) for a in basis for b in basis if a <= b]
            found = state.agg(
                F.max(F.abs("g")).alias("largest"),
                *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in wanted],
            ).first()
            if found["largest"] is None or found["largest"] <= tol:
                break
            products = {(a, b): found[f"{a}_{b}"] for a, b in wanted}
            coefficients = _direction(products, pairs)
            slope = sum(c * products[min(k, "g"), max(k, "g")] for k, c in coefficients.items())
            if slope >= 0:
                coefficients, pairs = {"g": -1.0}, []
                slope = -products["g", "g"]
            d = sum((F.lit(float(c)) * F.col(k) for k, c in coefficients.items()), F.lit(0.0))
            moved = state.withColumn("d", d)
            lines = materialize(
                logits(features, moved.select("col_id", F.col("d").alias("weight")), scored, small, "dz"), "lines"
            )
            free = F.when(F.col("col_id") != BIAS, 1.0).otherwise(0.0)
            squares = moved.agg(*[F.sum(free * F.col(a) * F.col(b)) for a, b in (("w", "w"), ("w", "d"), ("d", "d"))]).first()

            def value(data: float, t: float) -> float:
                return data + ridge / 2 * (squares[0] + 2 * t * squares[1] + t * t * squares[2])

            first = 1.0 if pairs else min(1.0, 1.0 / math.sqrt(products["g", "g"]))
            step, now = None, None
            while step is None and first > 1e-14:
                tried = [first / 2**j for j in range(4)]
                now, *values = _objective(lines, mode, lam, n_rows, [0.0, *tried])
                now = value(now, 0.0)
                # The last term is the rounding of the objective.
                bounds = [now + 1e-4 * t * slope + 1e-14 * abs(now) for t in tried]
                step = next((t for t, v, b in zip(tried, values, bounds) if value(v, t) <= b), None)
                first = tried[-1] / 2
            if step is None:
                break
            scored = materialize(
                lines.select("row_id", "labels", "group", (F.col("z") + F.lit(step) * F.col("dz")).alias("z")), "logits"
            )
            turn += 1
            kept = [*pairs, turn][-memory:]
            next_ = moved.withColumns({"w": F.col("w") + F.lit(step) * F.col("d"), f"s{turn}": F.lit(step) * F.col("d")})
            next_ = next_.join(gradient(scored), "col_id").withColumn("_g", F.col("_g") + shrink)
            next_ = next_.withColumn(f"y{turn}", F.col("_g") - F.col("g")).withColumn("g", F.col("_g"))
            state = materialize(
                next_.select("col_id", "w", "g", *[f"{v}{i}" for i in kept for v in "sy"]), "state"
            )
            bend = state.agg(F.sum(F.col(f"s{turn}") * F.col(f"y{turn}"))).first()[0]
            pairs = kept if bend > 0 else pairs
    return state.select("col_id", F.col("w").alias("weight"))


class _Rows:
    """Training rows in the tasks: sparse rows as arrays, and sums over them for given weights.

    ``stored`` has one row per row id: ``cols`` (0..n_cols-1), ``values``, ``labels`` and ``cell``,
    the number of its stratum and group, -1 for no stratum. Functions of the tasks name nothing of
    this module, so the workers need not have it.
    """

    def __init__(self, stored: DataFrame, n_cols: int, n_cells: int, n_rows: int, lam: float):
        self.stored, self.n_cols, self.n_cells, self.n_rows, self.lam = stored, n_cols, n_cells, n_rows, lam

    def _total(self, part: Callable[[np.ndarray, ...], np.ndarray], size: int, tasks: int | None = None) -> np.ndarray:
        """The sum of a vector that ``part`` makes of each batch, added up in each task and then by Spark.

        Of a long vector a few ``tasks`` make fewer rows to add up.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                cols, values = batch.column("cols"), batch.column("values")
                owner = np.repeat(np.arange(len(batch)), np.diff(cols.offsets.to_numpy()))
                total += part(
                    owner,
                    cols.flatten().to_numpy(),
                    values.flatten().to_numpy(),
                    batch.column("labels").to_numpy(),
                    batch.column("cell").to_numpy(),
                )
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["j", "x"])

        stored = self.stored if tasks is None else self.stored.coalesce(tasks)
        found = stored.mapInArrow(run, "j bigint, x double").groupBy("j").agg(F.sum("x").alias("x")).toArrow()
        result = np.zeros(size)
        result[found["j"].to_numpy()] = found["x"].to_numpy()
        return result

    def curvature(self) -> np.ndarray:
        """Per column, the mean of a quarter of the squared values: a bound of the loss's second derivative."""
        n_cols, n_rows = self.n_cols, self.n_rows
        return self._total(lambda owner, cols, values, *_: np.bincount(cols, values * values / (4 * n_rows), n_cols), n_cols)

    def second(self, w: np.ndarray, groups: int) -> np.ndarray:
        """Second derivatives at ``w``: those of the mean loss, and of the penalty the part that is never negative."""
        n_cols, n_cells, n_rows, chunk = self.n_cols, self.n_cells, self.n_rows, DENSE_ROWS

        def part(owner, cols, values, labels, cell):
            z = np.bincount(owner, values * w[cols], len(labels))
            prob = np.exp(-np.logaddexp(0.0, -z))
            # As a sum of squares; what single precision loses only makes a step a little worse.
            root = np.sqrt(prob * (1.0 - prob) / n_rows)
            loss, gaps, counts = np.zeros((n_cols, n_cols)), np.zeros((n_cells, n_cols)), np.zeros(n_cells)
            for first in range(0, len(labels), chunk):
                rows = min(chunk, len(labels) - first)
                own = slice(*np.searchsorted(owner, (first, first + rows)))
                at = (owner[own] - first) * n_cols + cols[own]
                x = np.bincount(at, values[own], rows * n_cols).reshape(rows, n_cols).astype(np.float32)
                here = slice(first, first + rows)
                y = x * root[here, None].astype(np.float32)
                loss += y.T @ y
                for c in np.unique(cell[here][cell[here] >= 0]):
                    mine = cell[here] == c
                    gaps[c] += (1.0 - prob[here][mine]) @ x[mine]
                    counts[c] += mine.sum()
            return np.concatenate([loss.ravel(), gaps.ravel(), counts])

        size = n_cols * n_cols + n_cells * (n_cols + 1)
        total = self._total(part, size, self.stored.sparkSession.sparkContext.defaultParallelism)
        result = total[: n_cols * n_cols].reshape(n_cols, n_cols)
        gaps, n = total[n_cols * n_cols : -n_cells].reshape(n_cells, n_cols), total[-n_cells:]
        for first in range(0, n_cells, groups) if self.lam else ():
            own = first + np.flatnonzero(n[first : first + groups])
            if len(own):
                turns = gaps[own] / n[own, None] - gaps[own].sum(axis=0) / n[own].sum()
                result = result + 2.0 * self.lam * turns.T @ turns
        return result

    def sums(self, w: np.ndarray, d: np.ndarray, steps: Sequence[float]) -> np.ndarray:
        """At ``w + t * d`` for several t: the summed loss, then per cell the rows and their log-probabilities."""
        n_cells = self.n_cells

        def part(owner, cols, values, labels, cell):
            z = np.bincount(owner, values * w[cols], len(labels))
            dz = np.bincount(owner, values * d[cols], len(labels))
            have = cell >= 0
            out = []
            for t in steps:
                at = z + t * dz
                log_prob = -np.logaddexp(0.0, -at)
                # log(1 + e^z) - y z, and log p is -log(1 + e^-z).
                out.append([((1.0 - labels) * at - log_prob).sum()])
                out.append(np.bincount(cell[have], minlength=n_cells))
                out.append(np.bincount(cell[have], log_prob[have], n_cells))
            return np.concatenate(out)

        return self._total(part, len(steps) * (1 + 2 * n_cells)).reshape(len(steps), -1)

    def penalty(self, sums: np.ndarray, groups: int) -> tuple[float, np.ndarray]:
        """The penalty and, per cell, its derivative by a row's log-probability, from one line of :meth:`sums`."""
        n, p = sums[1 : 1 + self.n_cells], sums[1 + self.n_cells :]
        value, pull = 0.0, np.zeros(self.n_cells)
        for first in range(0, self.n_cells, groups):
            own = first + np.flatnonzero(n[first : first + groups])
            if len(own):
                gap = p[own] / n[own] - p[own].sum() / n[own].sum()
                value += self.lam * float(gap @ gap)
                pull[own] = self.lam * 2.0 * (gap / n[own] - gap.sum() / n[own].sum())
        return value, pull

    def slopes(self, w: np.ndarray, pull: np.ndarray) -> np.ndarray:
        """The gradient of mean loss + penalty."""
        n_cols, n_rows = self.n_cols, self.n_rows

        def part(owner, cols, values, labels, cell):
            z = np.bincount(owner, values * w[cols], len(labels))
            prob = np.exp(-np.logaddexp(0.0, -z))
            slope = (prob - labels) / n_rows + np.where(cell >= 0, pull[cell], 0.0) * (1.0 - prob)
            return np.bincount(cols, values * slope[owner], n_cols)

        return self._total(part, n_cols)


def _fit_rows(
    seen: DataFrame,
    columns: DataFrame,
    rows: DataFrame,
    n_rows: int,
    lam: float,
    mode: str,
    ridge: float,
    tol: float,
    memory: int,
) -> DataFrame:
    """:func:`fit_score_fair` with the weights on the driver: limited-memory quasi-Newton, two jobs a step.

    Rows are stored once as sparse arrays and stay in the tasks. A step is a job for the line search,
    whose group sums also give the penalty's derivative, and a job for the gradient. Steps start from the
    second derivatives, made anew every ``DENSE_STEPS`` steps, where these are a matrix of moderate size: then a
    few dozen steps do, however many rows there are and however weak the ridge. Else columns are scaled by a bound
    of their curvature, as features differ much in frequency.
    """
    spark = rows.sparkSession
    ids = np.sort(columns.toArrow()["col_id"].to_numpy())
    if not len(ids):
        return columns.select("col_id", F.lit(0.0).alias("weight"))
    places = materialize(
        spark.createDataFrame(pa.table({"col_id": ids, "j": np.arange(len(ids), dtype=np.int32)})), "places"
    )
    # Null is a value of the attribute like others, as in the windows over strata.
    keys = rows.select(_strata(mode).alias("_s"), "group").distinct().collect()
    strata = sorted({k["_s"] for k in keys if k["_s"] is not None})
    groups = sorted({k["group"] for k in keys}, key=lambda g: (g is None, str(g)))
    cells = [(s, g, i * len(groups) + j) for i, s in enumerate(strata) for j, g in enumerate(groups)]
    typed = rows.select(_strata(mode).cast("bigint").alias("_s"), "group").schema
    cell_table = spark.createDataFrame(cells, StructType([*typed.fields, StructField("cell", LongType())]))
    marked = rows.where(F.col("labels").isNotNull()).withColumn("_s", _strata(mode).cast("bigint")).alias("r").join(
        F.broadcast(cell_table.alias("c")),
        (F.col("r._s") == F.col("c._s")) & F.col("r.group").eqNullSafe(F.col("c.group")),
        "left",
    )
    marked = marked.select(
        "r.row_id", F.col("r.labels").cast("double").alias("labels"), F.coalesce("c.cell", F.lit(-1)).alias("cell")
    )
    arrays = (
        lookup_join(seen, places, ["col_id"], spread=["row_id"])
        .groupBy("row_id")
        .agg(F.collect_list("j").alias("cols"), F.collect_list("value").alias("values"))
    )
    stored = materialize(marked.join(arrays, "row_id").drop("row_id"), "rows")
    data = _Rows(stored, len(ids), max(1, len(cells)), n_rows, lam)
    free = np.where(ids != BIAS, 1.0, 0.0)
    dense = len(ids) <= DENSE_WEIGHTS and len(cells) <= DENSE_WEIGHTS

    def inverse(w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """What turns a gradient into a step."""
        if dense:
            second = data.second(w, max(1, len(groups)))
            # Columns that say the same, without a ridge, leave a matrix that has no inverse.
            second[np.diag_indices_from(second)] += ridge * free + 1e-10 * (np.trace(second) / len(ids) + 1e-12)
            try:
                np.linalg.cholesky(second)
                return np.linalg.inv(second).__matmul__
            except np.linalg.LinAlgError:
                pass
        scale = 1.0 / np.maximum(data.curvature() + ridge * free, 1e-12)
        return lambda v: scale * v

    def state(sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        value, pull = data.penalty(sums, max(1, len(groups)))
        return sums[0] / n_rows + value + ridge / 2 * float(free @ (w * w)), pull

    w = np.zeros(len(ids))
    now, pull = state(data.sums(w, w, [0.0])[0], w)
    g = data.slopes(w, pull) + ridge * free * w
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    turn, solve = 0, inverse(w)
    while np.abs(g).max() > tol:
        if dense and turn and turn % DENSE_STEPS == 0:
            pairs, solve = [], inverse(w)
        turn += 1
        # Two-loop recursion.
        q, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append((s @ q) / (s @ y))
            q = q - alphas[-1] * y
        d = solve(q)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ solve(y)))
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            d = d + (alpha - (y @ d) / (s @ y)) * s
        slope = float(g @ d)
        if slope >= 0:
            d, pairs = -solve(g), []
            slope = float(g @ d)
        first = 1.0 if pairs or dense else min(1.0, 1.0 / math.sqrt(-slope))
        step = None
        while step is None and first > 1e-14:
            tried = [first / 2**j for j in range(4)]
            for t, sums in zip(tried, data.sums(w, d, tried)):
                value, pull = state(sums, w + t * d)
                # The last term is the rounding of the objective.
                if value <= now + 1e-4 * t * slope + 1e-14 * abs(now):
                    step, now = t, value
                    break
            first = tried[-1] / 2
        if step is None:
            break
        w = w + step * d
        before, g = g, data.slopes(w, pull) + ridge * free * w
        s, y = step * d, g - before
        if s @ y > 0:
            pairs = [*pairs, (s, y)][-memory:]
    return materialize(spark.createDataFrame(pa.table({"col_id": ids, "weight": w})), "weights")


def logits(
    features: DataFrame, weights: DataFrame, rows: DataFrame, small: bool | None = None, name: str = "z"
) -> DataFrame:
    """``rows`` with their linear score; a weight table of proven size is broadcast."""
    weighted = lookup_join(features, weights, ["col_id"], spread=["row_id"], small=small)
    z = weighted.groupBy("row_id").agg(F.sum(F.col("value") * F.col("weight")).alias(name))
    return rows.join(z, "row_id")


def apply_weights(long: DataFrame, weights: DataFrame, rows: DataFrame) -> DataFrame:
    """Score ``rows`` with fitted weights: adds ``outputs`` and ``pred_probs``."""
    scored = logits(_with_bias(long, rows), weights, rows)
    return scored.withColumn("pred_probs", sigmoid(F.col("z"))).withColumnRenamed("z", "outputs")
