"""One global regression on lookback sequences, and its recursive forecast.

The window of the last rows is flattened into one feature vector; the fit is
MLlib's distributed least squares, which scales its inputs the same way when it
fits and when it predicts. Validation is by date.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from .. import params as P
from ..functions.guards import one_row
from ..session import reuse
from .forecast import dot
from .metrics import METRICS, evaluate
from .sequences import last_rows, lookback_sequences

SIGNALS = ("er_visits", "pharmacy_sales", "negative_sentiment", "aqi", "temperature_c")


@dataclass(frozen=True)
class LagModel:
    """Coefficients over the flattened window, oldest row first."""

    features: tuple[str, ...]
    lookback: int
    weights: tuple[float, ...]
    intercept: float

    def table(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        row = ("lag_regression", list(self.features), self.lookback, list(self.weights), self.intercept)
        return spark.createDataFrame(
            [row], "model string, features array<string>, lookback int, weights array<double>, intercept double"
        )

    @staticmethod
    def from_table(table: DataFrame) -> "LagModel":
        row = table.first()
        if row is None:
            raise FileNotFoundError("no stored model")
        return LagModel(tuple(row.features), row.lookback, tuple(row.weights), row.intercept)


def windows(df: DataFrame, features: Sequence[str], target: str, lookback: int) -> DataFrame:
    rows = lookback_sequences(df, features, target, lookback)
    return rows.withColumn("x", F.flatten("x"))


def fit(
    df: DataFrame,
    features: Sequence[str] = SIGNALS,
    target: str = P.TARGET,
    lookback: int = P.LOOKBACK,
    validation: float = 0.2,
    ridge: float = 1e-4,
) -> tuple[LagModel, DataFrame]:
    """Fit on the earlier dates; also the train and validation errors."""
    rows = reuse(windows(df, features, target, lookback))
    span = one_row(rows, a=F.min("date"), b=F.max("date"))
    cut = F.date_add(span["a"], F.floor(F.datediff(span["b"], span["a"]) * (1 - validation)).cast("int"))
    labelled = rows.withColumn("_cut", cut).withColumn(
        "split", F.when(F.col("date") <= F.col("_cut"), "train").otherwise("validation")
    )
    vectors = labelled.filter("split = 'train'").select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    solved = LinearRegression(regParam=ridge, solver="normal").fit(vectors)
    model = LagModel(tuple(features), lookback, tuple(float(w) for w in solved.coefficients), float(solved.intercept))
    history = evaluate(predict(model, labelled), ["split"])
    return model, history


def predict(model: LagModel, rows: DataFrame) -> DataFrame:
    weights = F.array(*[F.lit(w) for w in model.weights])
    return rows.withColumn("yhat", dot(F.col("x"), weights) + F.lit(model.intercept))


def evaluate_sequences(model: LagModel, df: DataFrame, target: str = P.TARGET, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metrics over all sequences of the frame, one global row."""
    rows = predict(model, windows(df, model.features, target, model.lookback))
    return evaluate(rows.withColumn("model", F.lit("lag_regression")), ["model"], metrics=metrics)


def forecast(model: LagModel, df: DataFrame, horizon: int = P.FORECAST_HORIZON, target: str = P.TARGET) -> DataFrame:
    """Recursive forecast: each prediction becomes the newest target lag of the next step.

    Regions with fewer rows than the lookback are left out. Other signals stay at
    their last value. The state is one window per region, folded in one expression.
    """
    features, n = list(model.features), len(model.features)
    tail = last_rows(df.na.drop(subset=features), model.lookback)
    row = F.struct("date", F.array(*[F.col(f).cast("double") for f in features]).alias("v"))
    state = (
        tail.groupBy("zipcode")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max("date").alias("last"))
        .filter(F.size("rows") == model.lookback)
        .withColumn("window", F.flatten(F.transform("rows", lambda r: r["v"])))
    )
    weights = F.array(*[F.lit(w) for w in model.weights])
    at = features.index(target)
    empty = F.array().cast("array<double>")

    def step(acc, _):
        value = dot(acc["window"], weights) + F.lit(model.intercept)
        newest = F.slice(acc["window"], -n, n)
        following = F.concat(F.slice(newest, 1, at), F.array(value), F.slice(newest, at + 2, n))
        moved = F.concat(F.slice(acc["window"], n + 1, n * model.lookback), following)
        return F.struct(moved.alias("window"), F.concat(acc["made"], F.array(value)).alias("made"))

    steps = F.sequence(F.lit(1), F.lit(horizon))
    made = F.aggregate(steps, F.struct("window", empty.alias("made")), step, lambda acc: acc["made"])
    return (
        state.select("zipcode", "last", F.posexplode(made).alias("i", "value"))
        .select(
            "zipcode",
            F.date_add("last", F.col("i") + 1).alias("ds"),
            F.greatest("value", F.lit(0.0)).alias("yhat"),
        )
    )
