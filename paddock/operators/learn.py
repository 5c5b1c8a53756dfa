"""Small regressions on sweep tables: split by group, fit, score, compare, and the log of runs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scalars import hex_number
from paddock.schemas import require_columns

FEATURE, TARGET = "absolute_parameter_delta_from_baseline", "front_slip_angle_deg"


def group_split(df: DataFrame, group: str = "seed", test_size: float = 0.2, random_state: int = 42) -> DataFrame:
    """``df`` with ``is_test``: all rows of a group are on one side, the first ceil(test_size · n) groups by the MD5 of ``group:random_state`` are the test groups."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    groups = df.select(group).distinct().withColumn("__h", hex_number(F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{random_state}")))))
    # where the last test group lies: counts of 1,024 ranges of hashes, then ranks within the one range that is cut
    ranged = groups.withColumn("__range", F.shiftright("__h", 50))
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, cut = math.ceil(sum(counts.values()) * test_size), None
    for cut in sorted(counts):
        if left <= counts[cut]:
            break
        left -= counts[cut]
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__h", group))
    inside = ranged.where(F.col("__range") == F.lit(cut)).select(group, (rank <= left).alias("is_test"))
    outside = ranged.where(F.col("__range") != F.lit(cut)).select(group, (F.col("__range") < F.lit(cut)).alias("is_test"))
    return df.join(inside.unionByName(outside), group)


def simple_regression(df: DataFrame, by: tuple[str, ...] = (), x: str = FEATURE, y: str = TARGET) -> DataFrame:
    """Least squares line of each group: slope, intercept and rows."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("coefficient"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("rows"))


def predict_line(df: DataFrame, lines: DataFrame, by: tuple[str, ...], x: str = FEATURE) -> DataFrame:
    return df.join(lines.select(*by, "coefficient", "intercept"), list(by)).withColumn("prediction", F.col("coefficient") * F.col(x) + F.col("intercept")).drop("coefficient", "intercept")


def pressure_feature(df: DataFrame, pressure: str, baseline: float) -> DataFrame:
    return df.withColumn(FEATURE, F.abs(F.col(pressure) - baseline))


def fit_line(df: DataFrame, features: tuple[str, ...] = (FEATURE,)):
    """A linear model over ``features``; rows that lack one are left out."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip"), LinearRegression(featuresCol="x", labelCol=TARGET)]).fit(df)


def predict(model, rows: DataFrame, features: tuple[str, ...] = (FEATURE,)) -> DataFrame:
    """``rows`` with ``prediction``; a column that is missing raises, as does a row that lacks a value."""
    require_columns(rows, features, "prediction input")
    lacking = reduce(lambda a, b: a | b, (F.col(f).isNull() for f in features))
    checked = {f: F.when(lacking, F.raise_error(F.lit(f"a row lacks one of {', '.join(features)}")).cast("double")).otherwise(F.col(f)) for f in features[:1]}
    return model.transform(rows.withColumns(checked)).drop("x")


def metrics(df: DataFrame, by: tuple[str, ...] = (), y: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R² of each group; R² is null where the target doesn't vary."""
    error = F.col(y) - F.col(prediction)
    square = F.sum(F.pow(F.col(y), 2)) - F.pow(F.sum(y), 2) / F.count(y)
    return df.groupBy(*by).agg(F.count(y).alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.when(F.min(y) < F.max(y), 1 - F.sum(error * error) / square).alias("r2"))


def residuals(df: DataFrame, y: str = TARGET, prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(prediction))


def _models(trees: int, seed: int) -> dict[str, list]:
    return {
        "linear": [LinearRegression(featuresCol="x", labelCol=TARGET)],
        "polynomial_2": [PolynomialExpansion(degree=2, inputCol="x", outputCol="x2"), LinearRegression(featuresCol="x2", labelCol=TARGET)],
        "random_forest": [RandomForestRegressor(featuresCol="x", labelCol=TARGET, numTrees=trees, seed=seed)],
    }


#: Most training rows of a task: the forest keeps each of them with its number of draws for every tree, some 1 KB at 200 trees
ROWS_TOGETHER = 50_000


def evenly(df: DataFrame, rows: int = ROWS_TOGETHER) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, however few bytes, files or groups it has."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


def compare_models(split: DataFrame, features: tuple[str, ...] = (FEATURE,), trees: int = 200, seed: int = 42) -> DataFrame:
    """Test metrics of a line, a parabola and a random forest on the same split."""
    data = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip").transform(split)
    train = evenly(data.where("not is_test").select("x", TARGET))
    scored = None
    for name, steps in _models(trees, seed).items():
        one = Pipeline(stages=steps).fit(train).transform(data.where("is_test")).select(F.lit(name).alias("model"), TARGET, "prediction")
        scored = one if scored is None else scored.unionByName(one)
    return metrics(scored, ("model",))


def fit_parabola(df: DataFrame, x: str = FEATURE, y: str = TARGET) -> DataFrame:
    """Least squares parabola c0 + c1·x + c2·x² in one row: the normal equations of the sums of powers, which one aggregation gives; nulls if the values of x are too few."""
    power = lambda k: F.sum(F.pow(F.col(x), F.lit(k)))
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(power(k).alias(f"x{k}") for k in (1, 2, 3, 4)), F.sum(y).alias("y0"), F.sum(F.col(x) * F.col(y)).alias("y1"), F.sum(F.pow(F.col(x), F.lit(2)) * F.col(y)).alias("y2")
    )
    return sums.selectExpr(*(f"try_divide({e}, {PARABOLA['d']}) AS {c}" for c, e in PARABOLA.items() if c != "d"))


#: Cramer's rule for the normal equations, over the sums n, x1 to x4 (of powers of x) and y0 to y2 (of y times powers of x)
PARABOLA = {
    "d": "(n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2))",
    "c0": "(y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - y2 * x3) + x2 * (y1 * x3 - y2 * x2))",
    "c1": "(n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1))",
    "c2": "(n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2))",
}


def compare_curves(split: DataFrame, x: str = FEATURE, y: str = TARGET) -> DataFrame:
    """Test metrics of the least squares line and parabola of one feature on the same split, each fitted by one aggregation."""
    train, test = split.where("not is_test"), split.where("is_test")
    line = simple_regression(train, (), x, y).select(F.struct("coefficient", "intercept").alias("f")).scalar()
    curve = fit_parabola(train, x, y).select(F.struct("c0", "c1", "c2").alias("f")).scalar()
    made = {"linear": line["intercept"] + line["coefficient"] * F.col(x), "polynomial_2": curve["c0"] + curve["c1"] * F.col(x) + curve["c2"] * F.col(x) * F.col(x)}
    scored = [test.select(F.lit(name).alias("model"), y, p.alias("prediction")) for name, p in made.items()]
    return metrics(scored[0].unionByName(scored[1]), ("model",), y)


def evaluate(df: DataFrame, predictions: DataFrame, test_seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Metrics on the rows of the recorded test seeds."""
    return metrics(df.join(predictions, [c for c in df.columns if c in predictions.columns]).join(test_seeds, "seed", "left_semi"), by)


def run_analytics(runs: DataFrame) -> DataFrame:
    """All logged runs in one row: models, mean errors, best ones and number of data sets."""
    return runs.agg(
        F.count(F.lit(1)).alias("run_count"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.avg("mae").alias("average_mae"), F.avg("rmse").alias("average_rmse"), F.avg("r2").alias("average_r2"),
        F.min("mae").alias("best_mae"), F.max("r2").alias("best_r2"), F.countDistinct("dataset").alias("dataset_count"),
    )
