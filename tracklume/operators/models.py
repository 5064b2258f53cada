"""Learned scores, uncertainties and corrections: Spark ML where there is an optimiser, moments where there is a closed form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import ranked

FRAME = ["sequence_id", "time_s"]


def _prepared(features: list[str], scale: bool = True) -> list:
    filled = [f"_f_{f}" for f in features]
    steps = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw")]
    return steps + ([StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)] if scale else [VectorAssembler(inputCols=["_raw"], outputCol="_x")])


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, what is not finite as null."""
    return df.withColumns({f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")) for f in features})


def balanced(df: DataFrame, label: str) -> DataFrame:
    """A weight column that gives both classes the same mass."""
    n, ones = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0.0))).first()
    return df.withColumn("_weight", F.when(F.col(label) == 1, F.lit(n / (2 * max(ones, 1)))).otherwise(F.lit(n / (2 * max(n - ones, 1)))))


def fit_classifier(df: DataFrame, features: list[str], label: str, kind: str = "logistic", l2: float = 1e-3, balance: bool = True, seed: int = 13) -> PipelineModel:
    """A pipeline with a ``probability``: standardised logistic regression, random forest or gradient-boosted trees."""
    d = _doubles(df, features).withColumn("_label", F.col(label).cast("double"))
    d = balanced(d, "_label") if balance else d.withColumn("_weight", F.lit(1.0))
    common = {"featuresCol": "_x", "labelCol": "_label", "weightCol": "_weight"}
    if kind == "logistic":
        last = LogisticRegression(regParam=l2, maxIter=500, standardization=False, **common)
    elif kind == "forest":
        last = RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed, **common)
    elif kind == "boosted":
        last = GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **common)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=[*_prepared(features), last]).fit(d)


def scored(model: PipelineModel, df: DataFrame, features: list[str], name: str = "model_score") -> DataFrame:
    """df with the model's probability of the positive class."""
    out = model.transform(_doubles(df, features)).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def fit_platt(df: DataFrame, probability: str, label: str) -> PipelineModel:
    """One-feature logistic calibration."""
    return fit_classifier(df, [probability], label, l2=0.0, balance=False)


def leave_one_out(df: DataFrame, features: list[str], label: str, group: str, groups: list[str], kind: str = "logistic") -> DataFrame:
    """Scores of each group by a model of all others (a model per group: groups are few, such as flights)."""
    out = None
    for g in groups:
        model = fit_classifier(df.where(F.col(group) != g), features, label, kind)
        part = scored(model, df.where(F.col(group) == g), features)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no groups")
    return out


def ranking_quality(df: DataFrame, score: str, error: str, k: int = 1) -> DataFrame:
    """Per sequence and pooled: how often the best-scored candidate of a frame is the one of least error, mean error of the choice and of the best."""
    d = ranked(ranked(df, FRAME, [F.col(score).desc(), F.col("key")], "_s"), FRAME, [F.col(error), F.col("key")], "_e")
    f = d.groupBy(*FRAME).agg(F.max(F.when(F.col("_s") == 1, F.col(error))).alias("chosen"), F.min(F.when(F.col("_s") <= k, F.col(error))).alias("best_k"), F.min(error).alias("best"))
    hit = (F.col("chosen") <= F.col("best")).cast("double")
    return f.groupingSets([[], [F.col("sequence_id")]], F.col("sequence_id")).agg(F.count(F.lit(1)).alias("frames"), F.avg(hit).alias("hit_rate"), F.avg("chosen").alias("chosen_m"), F.avg("best_k").alias("best_k_m"), F.avg("best").alias("best_m"))


def fit_uncertainty(df: DataFrame, features: list[str], error: str, kind: str = "linear", l2: float = 1.0, seed: int = 13) -> PipelineModel:
    """A regression of log(1 + error)."""
    d = _doubles(df, features).withColumn("_label", F.log1p(F.col(error))).where(F.col("_label").isNotNull())
    common = {"featuresCol": "_x", "labelCol": "_label"}
    last = LinearRegression(regParam=l2, **common) if kind == "linear" else GBTRegressor(maxIter=20, maxDepth=4, seed=seed, **common)
    return Pipeline(stages=[*_prepared(features), last]).fit(d)


def predicted_sigma(model: PipelineModel, df: DataFrame, features: list[str], least: float = 1.0, most: float = 30.0) -> DataFrame:
    """df with predicted_sigma_m, within bounds."""
    out = model.transform(_doubles(df, features))
    return out.select(*df.columns, F.least(F.greatest(F.expm1("prediction"), F.lit(least)), F.lit(most)).alias("predicted_sigma_m"))


def log_variance(df: DataFrame, features: list[str], residual: str, l2: float = 1.0) -> PipelineModel:
    """A head of heteroscedastic noise: ridge regression of log(residual^2)."""
    d = _doubles(df, features).withColumn("_label", F.log(F.col(residual) * F.col(residual) + 1e-6)).where(F.col("_label").isNotNull())
    return Pipeline(stages=[*_prepared(features), LinearRegression(regParam=l2, featuresCol="_x", labelCol="_label")]).fit(d)


def ridge(df: DataFrame, keys: list[str], features: list[str], target: str, alpha: float = 1.0, least: int = 5) -> DataFrame:
    """Ridge coefficients per key from moments: (keys, n, intercept, coefficients); zeros for keys with fewer than ``least`` rows.

    The normal equations are sums, so a key costs one row of moments whatever its size.
    """
    d = df.dropna(subset=[*features, target])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    sums = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("_my"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)]]
    sums += [F.covar_pop(f, target).alias(f"_y{i}") for i, f in enumerate(features)] + [F.covar_pop(a, b).alias(f"_c{k}") for k, (a, b) in enumerate(pairs)]
    g = d.groupBy(*keys).agg(*sums)

    def solved(parts):
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                k = len(features)
                c = np.zeros((k, k))
                for v, (a, b) in enumerate(pairs):
                    i, j = features.index(a), features.index(b)
                    c[i, j] = c[j, i] = r[f"_c{v}"]
                if r["n"] >= least:
                    beta = np.linalg.solve(r["n"] * c + alpha * np.eye(k), r["n"] * np.array([r[f"_y{i}"] for i in range(k)]))
                    start = r["_my"] - float(beta @ np.array([r[f"_m{i}"] for i in range(k)]))
                else:
                    beta, start = np.zeros(k), 0.0
                rows.append([*(r[x] for x in keys), r["n"], start, beta.tolist()])
            yield pd.DataFrame(rows, columns=[*keys, "n", "intercept", "coefficients"])

    return g.mapInPandas(solved, ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, intercept double, coefficients array<double>")


def corrected(df: DataFrame, coefficients: DataFrame, keys: list[str], features: list[str], value: str) -> DataFrame:
    """value less the predicted bias of its key; keys without coefficients stay as they are."""
    d = df.join(coefficients.select(*keys, "intercept", "coefficients"), keys, "left")
    bias = F.col("intercept") + sum((F.get("coefficients", i) * F.coalesce(F.col(f), F.lit(0.0)) for i, f in enumerate(features)), F.lit(0.0))
    return d.withColumn(value, F.col(value) - F.coalesce(bias, F.lit(0.0))).drop("intercept", "coefficients")


def source_transforms(pairs: DataFrame, key: str, mode: str, a: list[str], b: list[str], least: int = 3) -> DataFrame:
    """Per source the map a -> b of least squares: identity, translation, rigid (SVD) or affine; too few pairs give the identity.

    A source is one row of moments; matrix is row by row, then the shift.
    """
    if mode not in ("identity", "translation", "rigid", "affine"):
        raise ValueError(f"unknown mode {mode!r}")
    n = len(a)
    moments = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_a{i}") for i, c in enumerate(a)], *[F.avg(c).alias(f"_b{i}") for i, c in enumerate(b)]]
    moments += [F.covar_pop(x, y).alias(f"_ab{i}{j}") for i, x in enumerate(a) for j, y in enumerate(b)] + [F.covar_pop(x, y).alias(f"_aa{i}{j}") for i, x in enumerate(a) for j, y in enumerate(a)]
    g = pairs.groupBy(key).agg(*moments)

    def solved(parts):
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                ma, mb = (np.array([r[f"_{s}{i}"] for i in range(n)]) for s in "ab")
                ab, aa = (np.array([[r[f"_{s}{i}{j}"] for j in range(n)] for i in range(n)]) for s in ("ab", "aa"))
                m = np.eye(n)
                if mode == "rigid" and r["n"] >= least:
                    u, _, vt = np.linalg.svd(ab)
                    m = vt.T @ np.diag([*np.ones(n - 1), np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
                elif mode == "affine" and r["n"] > n:
                    m = np.linalg.lstsq(aa, ab, rcond=None)[0].T
                shift = mb - m @ ma if mode != "identity" and r["n"] >= (least if mode != "affine" else n + 1) else np.zeros(n)
                rows.append([r[key], r["n"], m.ravel().tolist(), shift.tolist()])
            yield pd.DataFrame(rows, columns=[key, "n", "matrix", "shift"])

    return g.mapInPandas(solved, f"{key} {pairs.schema[key].dataType.simpleString()}, n long, matrix array<double>, shift array<double>")


def transformed(df: DataFrame, transforms: DataFrame, key: str, axes: list[str]) -> DataFrame:
    d = df.join(transforms.select(key, "matrix", "shift"), key, "left")
    n = len(axes)
    moved = {c: F.coalesce(sum((F.get("matrix", i * n + j) * F.col(x) for j, x in enumerate(axes)), F.lit(0.0)) + F.get("shift", i), F.col(c)) for i, c in enumerate(axes)}
    return d.withColumns(moved).drop("matrix", "shift")


def score_calibration(df: DataFrame, keys: list[str], good: Column, probability: str, shrink: float = 50.0, epsilon: float = 1e-3) -> DataFrame:
    """Logit offsets per key: log odds of being good less the mean log odds of the score, drawn to 0 by n / (n + shrink)."""
    clip = lambda c: F.least(F.greatest(c, F.lit(epsilon)), F.lit(1 - epsilon))
    logit = lambda c: F.log(c / (1 - c))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(good.cast("double")).alias("rate"), F.avg(logit(clip(F.col(probability)))).alias("_l"))
    return g.select(*keys, "n", "rate", ((logit(clip(F.col("rate"))) - F.col("_l")) * F.col("n") / (F.col("n") + F.lit(shrink))).alias("offset"))


def offset_grid(df: DataFrame, offsets: list[dict[str, float]], column: str, score: str, error: str, k: int) -> DataFrame:
    """Configurations of score offsets by a column's values (none: 0), each scored by the least error within each frame's best k:
    (config, sequence_id, frames, error_sum).  The configurations are exploded onto the rows, so the table is read once."""
    grid = F.array(*[F.struct(F.lit(i).alias("config"), _by_value(column, o).alias("_o")) for i, o in enumerate(offsets)])
    d = df.withColumn("_g", F.explode(grid)).withColumn("config", F.col("_g.config")).withColumn("_s", F.col(score) + F.col("_g._o")).drop("_g")
    d = ranked(d, ["config", *FRAME], [F.col("_s").desc(), F.col("key")], "_r").where(F.col("_r") <= k)
    f = d.groupBy("config", *FRAME).agg(F.min(error).alias("_e"))
    return f.groupBy("config", "sequence_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("_e").alias("error_sum"))


def _by_value(column: str, offsets: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for value, o in sorted(offsets.items()):
        out = F.when(F.col(column) == value, F.lit(float(o))).otherwise(out)
    return out


def held_out_choice(grid: DataFrame) -> DataFrame:
    """For each sequence the configuration of least mean error on all others (ties: the first), and its error on the sequence.

    Leave-one-out sums are the whole less the sequence's own, so no fold reads the table again."""
    total = grid.groupBy("config").agg(F.sum("frames").alias("_f"), F.sum("error_sum").alias("_e"))  # a row per configuration
    d = grid.join(F.broadcast(total), "config")
    d = d.withColumn("train_error", F.round(F.try_divide(F.col("_e") - F.col("error_sum"), F.col("_f") - F.col("frames")), 9))
    best = d.groupBy("sequence_id").agg(F.min_by(F.struct("config", "train_error", "frames", "error_sum"), F.struct("train_error", "config")).alias("b"))
    return best.select("sequence_id", "b.config", "b.train_error", (F.col("b.error_sum") / F.col("b.frames")).alias("heldout_error"), F.col("b.frames").alias("frames"))
