"""A pluggable three-class model over prepared features, and its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import prep as P

CATEGORICAL = ["author", "category", "market_regime", "sector", "market_cap_bucket"]


def prepared(df: DataFrame, numerical: list[str], categorical: list[str], order: str, *, temporal: bool = True, buy_boost: float = 1.0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows with ``split, label, weight`` and encoded, scaled features, and the artifacts.

    Everything that is fitted is fitted on the rows of the train split only, and the split
    is kept with the rows, so that evaluation never makes a new one.
    """
    df = P.feature_columns(P.reliable_rows(df), numerical, categorical)
    df = P.split_by_time(df, [order, "tweet_hash"]) if temporal else P.split_by_hash(df)
    df = df.withColumn("label", P.label_id(F.col("label_1d_3class")))
    train = df.where("split = 'train'")
    maps = {c: P.encodings(train, c, order) for c in categorical}
    fitted = P.scaler(train, numerical)
    weights = P.class_weights(train, buy_boost=buy_boost)
    rows = P.scaled(P.encoded(df, maps), numerical, fitted).join(F.broadcast(weights.select("label", "weight")), "label", "left")
    return rows, {**{f"encoding_{c}": m for c, m in maps.items()}, "scaler": fitted, "weights": weights}


def vectors(rows: DataFrame, numerical: list[str], categorical: list[str], text_slots: int = 1024) -> DataFrame:
    """``rows`` with ``features``: numbers, one-hot category hashes and hashed words."""
    tags = F.array(*[F.concat(F.lit(f"{c}="), F.col(f"{c}_idx").cast("string")) for c in categorical])
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    rows = rows.withColumn("__terms", F.concat(tags, words))
    rows = HashingTF(inputCol="__terms", outputCol="__hashed", numFeatures=text_slots).transform(rows)
    return VectorAssembler(inputCols=[*numerical, "__hashed"], outputCol="features").transform(rows).drop("__terms", "__hashed")


def trained(rows: DataFrame, grid=(0.0, 0.01, 0.1), most: int = 30, tolerance: float = 1e-6) -> LogisticRegressionModel:
    """The weighted model whose macro F1 on the validation rows is best.

    A fit ends after ``most`` passes, or when the loss falls by less than ``tolerance``.
    """
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    best = None
    for reg in grid:
        model = LogisticRegression(weightCol="weight", regParam=reg, maxIter=most, tol=tolerance, family="multinomial").fit(train)
        score = M.scores(predicted(model, val, "tweet_hash")).first()["f1_macro"] or 0.0
        if best is None or score > best[0]:
            best = (score, model)
    return best[1]


def predicted(model: LogisticRegressionModel, rows: DataFrame, key: str) -> DataFrame:
    """``(id, p_sell, p_hold, p_buy, pred, label, ret)``."""
    p = vector_to_array("probability")
    out = model.transform(rows).withColumn("__p", p)
    ret = F.col("return_to_next_open") if "return_to_next_open" in rows.columns else F.lit(None).cast("double")
    return out.select(F.col(key).alias("id"), *[F.get("__p", F.lit(k)).alias(n) for k, n in enumerate(("p_sell", "p_hold", "p_buy"))], F.col("prediction").cast("int").alias("pred"), "label", ret.alias("ret"))


def scored_by(rows: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], key: str) -> DataFrame:
    """Predictions of any model: ``score`` maps a frame of rows to three probabilities."""

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            p = score(pdf)
            yield pd.DataFrame({"id": pdf[key].astype(str), "p_sell": p.iloc[:, 0], "p_hold": p.iloc[:, 1], "p_buy": p.iloc[:, 2], "label": pdf["label"], "ret": pdf["return_to_next_open"]})

    out = rows.mapInPandas(run, "id string, p_sell double, p_hold double, p_buy double, label int, ret double")
    best = M.confidence()
    return out.withColumn("pred", F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2))


def evaluated(predictions: DataFrame) -> dict[str, DataFrame]:
    """All reports over one set of predictions."""
    return {"scores": M.scores(predictions), "classes": M.class_report(predictions), "confusion": M.confusion(predictions), "baselines": M.baselines(predictions), "improvements": M.improvements(predictions), "trading": M.trading_report(predictions), "sweep": M.confidence_sweep(predictions)}
