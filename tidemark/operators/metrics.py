"""Classification and trading metrics over ``(p_sell, p_hold, p_buy, pred, label, ret)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .ranks import average_rank, correlation, correlation_p, positions

COST, TOP, CONFIDENT, YEAR = 0.001, 0.3, 0.6, 252
THRESHOLDS = (0.0, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9)
CLASSES = (0, 1, 2)


def confidence() -> Column:
    return F.greatest("p_sell", "p_hold", "p_buy")


def bullish() -> Column:
    return F.col("p_buy") - F.col("p_sell")


def traded(cost: float = COST) -> Column:
    """What following a prediction earns; HOLD earns nothing."""
    return F.when(F.col("pred") == 2, F.col("ret") - cost).when(F.col("pred") == 0, -F.col("ret") - cost).otherwise(0.0)


def has_return() -> Column:
    return F.col("ret").isNotNull() & ~F.isnan("ret")


def confusion(df: DataFrame) -> DataFrame:
    """``(label, pred_0, pred_1, pred_2)``."""
    return df.groupBy("label").agg(*[F.count_if(F.col("pred") == c).alias(f"pred_{c}") for c in CLASSES])


def class_report(df: DataFrame, *by: str) -> DataFrame:
    """``(by, class, tp, predicted, support, precision, recall, f1)`` for each class."""
    each = df.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    hit, own = F.col("pred") == F.col("class"), F.col("label") == F.col("class")
    n = each.groupBy(*by, "class").agg(F.count_if(hit & own).alias("tp"), F.count_if(hit).alias("predicted"), F.count_if(own).alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return n.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))})


def scores(df: DataFrame, *by: str) -> DataFrame:
    """``(by, n, accuracy, f1_macro, f1_weighted)``; F1 over classes that occur at all."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    report = class_report(df, *by)
    return report.groupBy(*by).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def _shares(df: DataFrame) -> DataFrame:
    n = df.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per class


def baselines(df: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Majority class (the least of a tie) and its share, even odds, and the sum of squares
    of the classes' shares, which are those of the rows ``train`` where these are given."""
    own = _shares(df).agg(F.max("p").alias("naive_accuracy"), F.max_by("label", F.struct("n", -F.col("label"))).alias("majority_class"), (1 / F.count("*")).alias("random_accuracy"), F.sum(F.col("p") * F.col("p")).alias("weighted_random_accuracy"))
    if train is None:
        return own
    known = _shares(train.where("label is not null")).agg(F.sum(F.col("p") * F.col("p")).alias("weighted_random_accuracy"))
    return own.drop("weighted_random_accuracy").join(known)  # one row each


def improvements(df: DataFrame) -> DataFrame:
    """``(accuracy, improvement_vs_naive, improvement_vs_random)``, as shares of the baselines."""
    both = scores(df).select("accuracy").join(baselines(df))  # one row each
    gain = lambda c: ((F.col("accuracy") - F.col(c)) / F.nullif(F.col(c), F.lit(0.0)))
    return both.select("accuracy", gain("naive_accuracy").alias("improvement_vs_naive"), gain("random_accuracy").alias("improvement_vs_random"))


def sharpe(returns: Column, active: Column) -> list[Column]:
    """Sharpe ratio (population deviation) and annual return of active trades, 0 if flat."""
    r = F.when(active, returns)
    flat = F.coalesce(F.stddev_pop(r), F.lit(0.0)) <= 0
    return [F.when(flat, 0.0).otherwise(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))), F.when(flat, 0.0).otherwise(F.avg(r) * YEAR)]


def directional(df: DataFrame) -> DataFrame:
    """``(directional_accuracy, n_directional)`` of predictions other than HOLD."""
    moved = df.where(has_return() & (F.col("pred") != 1) & (F.col("ret") != 0))
    right = F.when(F.col("pred") == 2, F.col("ret") > 0).otherwise(F.col("ret") < 0)
    return moved.agg(F.coalesce(F.count_if(right) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("directional_accuracy"), F.count("*").alias("n_directional"))


def top_trades(df: DataFrame, share: float = TOP, cost: float = COST, key: str = "id") -> DataFrame:
    """``(n_top_trades, sharpe_top, return_top)`` of the most confident predictions."""
    valid = df.where(has_return()).withColumn("__conf", confidence())
    n = max(1, int(share * valid.count()))
    top = positions(valid, ["__conf", key], "__at", descending=True).where(F.col("__at") < n)
    s, r = sharpe(traded(cost), F.lit(True))
    return top.agg(F.count("*").alias("n_top_trades"), s.alias("sharpe_top"), r.alias("return_top"))


def precision_at(df: DataFrame, threshold: float = CONFIDENT, least: int = 10) -> DataFrame:
    sure = df.where(has_return() & (confidence() > threshold))
    return sure.agg(F.count("*").alias("n_high_confidence"), F.when(F.count("*") >= least, F.count_if(F.col("pred") == F.col("label")) / F.nullif(F.count("*"), F.lit(0))).alias("precision_at_confidence"))


def information_coefficient(df: DataFrame) -> DataFrame:
    """``(n, ic)``: rank correlation of p_buy - p_sell and the return."""
    valid = df.where(has_return()).select(bullish().alias("b"), "ret")
    ranked = average_rank(average_rank(valid, "b", "rb"), "ret", "rr")
    return ranked.agg(F.count("*").alias("n"), F.coalesce(correlation("rb", "rr"), F.lit(0.0)).alias("ic"))


def trading_report(df: DataFrame) -> DataFrame:
    """All trading metrics in one row, the p-value of the coefficient included."""
    ic = information_coefficient(df)
    ic = ic.withColumn("ic_pvalue", correlation_p(F.col("ic"), F.col("n")))
    return reduce(lambda a, b: a.join(b), [ic, directional(df), top_trades(df), precision_at(df)])  # one row each


def confidence_sweep(df: DataFrame, thresholds=THRESHOLDS, cost: float = COST, least: int = 20) -> DataFrame:
    """A row per threshold: coverage, accuracy, F1, coefficient, direction, active trades.

    Predictions are cut into confidence bands first; metrics other than ranks add up over
    bands, so that no prediction is copied for each threshold it passes.
    """
    spark = df.sparkSession
    limits = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    band = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= confidence()))
    rows = df.withColumn("__band", band).withColumn("__ok", has_return()).withColumn("__r", traded(cost))
    ok, r = F.col("__ok"), F.col("__r")
    active = ok & (r != 0)
    moved = ok & (F.col("pred") != 1)
    right = F.when(F.col("pred") == 2, F.col("ret") > 0).otherwise(F.col("ret") < 0)
    sums = {
        "n_samples": F.count("*"), "n_valid": F.count_if(ok), "hits": F.count_if(F.col("pred") == F.col("label")),
        "n_calls": F.count_if(moved), "n_moved": F.count_if(moved & (F.col("ret") != 0)), "n_right": F.count_if(moved & (F.col("ret") != 0) & right),
        "n_trades": F.count_if(active), "wins": F.count_if(active & (r > 0)), "earned": F.sum(F.when(active, r).otherwise(0.0)), "squares": F.sum(F.when(active, r * r).otherwise(0.0)), "conf": F.sum(confidence()),
        **{f"tp{c}": F.count_if((F.col("pred") == c) & (F.col("label") == c)) for c in CLASSES}, **{f"pred{c}": F.count_if(F.col("pred") == c) for c in CLASSES}, **{f"own{c}": F.count_if(F.col("label") == c) for c in CLASSES},
    }
    bands = rows.groupBy("__band").agg(*[v.alias(k) for k, v in sums.items()])  # one row per band
    order = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("threshold")))
    met = limits.withColumn("__at", order).join(F.broadcast(bands), F.col("__band") >= F.col("__at"), "left")
    at = met.groupBy("threshold").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums])
    total = F.lit(df.count())
    share = lambda a, b: F.when(b > 0, a / b)
    f1 = [F.when(F.col(f"pred{c}") + F.col(f"own{c}") > 0, 2 * F.col(f"tp{c}") / (F.col(f"pred{c}") + F.col(f"own{c}"))) for c in CLASSES]
    classes = sum((x.isNotNull().cast("int") for x in f1), F.lit(0))
    n = F.col("n_trades")
    mean = share(F.col("earned"), n)
    deviation = F.sqrt(F.greatest(F.lit(0.0), share(F.col("squares"), n) - mean * mean))
    enough = F.when(F.col("n_samples") < least, "insufficient_samples").when(F.col("n_valid") < least, "insufficient_valid_returns").otherwise("ok")
    trades = (n > 10) & (deviation > 0)
    out = at.withColumn("status", enough)
    fine = F.col("status") == "ok"
    out = out.select(
        "threshold", "n_samples", "status", share(F.col("n_samples"), total).alias("coverage"),
        F.when(fine, share(F.col("hits"), F.col("n_samples"))).alias("accuracy"),
        F.when(fine, sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)) / classes).alias("f1_macro"),
        *[F.when(fine, share(F.col(f"tp{c}"), F.col(f"own{c}"))).alias(f"{name}_accuracy") for c, name in enumerate(("sell", "hold", "buy"))],
        F.when(fine & (F.col("n_calls") > 10), share(F.col("n_right"), F.col("n_moved"))).alias("directional_accuracy"),
        F.when(fine & (F.col("n_calls") > 10), F.col("n_moved")).otherwise(0).alias("n_directional"),
        F.when(fine, n).alias("n_trades"),
        F.when(fine & trades, mean / F.nullif(deviation, F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        F.when(fine & trades, mean * YEAR).alias("ann_return"),
        F.when(fine & trades, share(F.col("wins"), n)).alias("win_rate"),
        F.when(fine, share(F.col("conf"), F.col("n_samples"))).alias("mean_confidence"),
    )
    return out


def sweep_with_ic(df: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The sweep with ``ic, ic_pvalue, ic_significant`` per threshold.

    Ranks differ from threshold to threshold, so a prediction's two numbers are copied for
    each that it passes, and all thresholds are ranked together.
    """
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= confidence())
    rows = df.where(has_return()).select(F.explode(passed).alias("threshold"), bullish().alias("b"), "ret")
    ranked = average_rank(average_rank(rows, "b", "rb", ["threshold"]), "ret", "rr", ["threshold"])
    ics = ranked.groupBy("threshold").agg(F.count("*").alias("n"), F.coalesce(correlation("rb", "rr"), F.lit(0.0)).alias("ic"))
    p = F.when(F.col("n").isNull(), 1.0).otherwise(correlation_p(F.col("ic"), F.col("n")))
    out = confidence_sweep(df, thresholds).join(F.broadcast(ics), "threshold", "left")  # a row per threshold
    return out.withColumn("ic_pvalue", p).withColumns({"ic": F.coalesce("ic", F.lit(0.0)), "ic_significant": F.col("ic_pvalue") < 0.05}).drop("n")


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """``(objective, threshold, value)``: the best of each objective with enough support."""
    rules = (("sharpe", F.col("n_trades") >= 100), ("accuracy", F.col("n_samples") >= 500), ("directional_accuracy", F.col("n_directional") >= 100))
    if "ic_significant" in sweep.columns:
        rules = (("ic", F.col("ic_significant")), *rules)
    parts = []
    for name, rule in rules:
        fit = sweep.where((F.col("status") == "ok") & rule & F.col(name).isNotNull())
        best = fit.agg(F.max_by("threshold", F.struct(F.col(name), -F.col("threshold"))).alias("threshold"), F.max(name).alias("value"))
        parts.append(best.where("threshold is not null").select(F.lit(name).alias("objective"), "threshold", "value"))
    return reduce(DataFrame.unionByName, parts)


def ensemble(models: DataFrame) -> DataFrame:
    """Mean probabilities over models per id, and the likeliest class (least of a tie)."""
    mean = models.groupBy("id").agg(*[F.avg(c).alias(c) for c in ("p_sell", "p_hold", "p_buy")], F.count("*").alias("n_models"))
    best = confidence()
    return mean.withColumn("pred", F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2))


def quantiles(df: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row of exact quantiles of the confidence, null without predictions."""
    found = ranks.quantiles(df.select(confidence().alias("c")), "c", shares)
    names = ", ".join(f"conf_p{int(q * 100)} double" for q in shares)
    return df.sparkSession.createDataFrame([tuple(found)], names)


def ensemble_report(models: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """Scores of each model and of their mean, over ``(model, id, p_sell, p_hold, p_buy)``
    and ``(id, label, ret)``; and the trading report and gains of the mean."""
    best = confidence()
    each = models.withColumn("pred", F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2)).join(truth, "id")
    mean = ensemble(models).join(truth, "id")
    rows = scores(each, "model").unionByName(scores(mean).withColumn("model", F.lit("ensemble")))
    return {"models": rows, "trading": trading_report(mean), "improvements": improvements(mean)}


def signal_correlation(df: DataFrame, signal: str = "score", ret: str = "ret") -> DataFrame:
    """``(n, correlation, signal)``: Pearson's, and whether it is beyond 0.05 either way."""
    valid = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    out = valid.agg(F.count("*").alias("n"), correlation(signal, ret).alias("correlation"))
    return out.withColumn("signal", F.coalesce(F.abs("correlation") > 0.05, F.lit(False)))
