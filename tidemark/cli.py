"""Commands: ``python -m tidemark.cli <flow> <command> ...``; see ``--help``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import market, text
from .operators import bars, metrics, state, validate
from .operators.indicators import NUMERICAL
from .plans import enrich, model, network
from .sources import crawl, raw, sinks
from .sources.versioned import Store, upserted


def _between(df: DataFrame, since: str | None, until: str | None, ts: str = "ts") -> DataFrame:
    """Both days are included as a whole."""
    if since:
        df = df.where(F.col(ts) >= F.lit(since).cast("date"))
    if until:
        df = df.where(F.col(ts) < F.date_add(F.lit(until).cast("date"), 1))
    return df


def _function(name: str):
    """``package.module:function`` as the function."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _bars(spark: SparkSession, path: str) -> DataFrame:
    """A store that is merged in place, or folders by symbol."""
    rows = Store(spark, path).read()
    return raw.read_bars(spark, path) if rows is None else rows


def twitter_sync(spark: SparkSession, a) -> None:
    """Crawl with ``--source`` (a page function, or a search function where ``--since`` is
    given), land what is new, and store what landed."""
    if a.estimate:
        print(json.dumps(state.estimate(a.accounts, 30 * a.months)))
        return
    from .streaming.ingest import sync

    if a.source:
        names = spark.createDataFrame([(x,) for x in a.account], "account string") if a.account else spark.read.text(a.accounts_file).toDF("account")
        known = None if a.full else _stored(spark, f"{a.store}/raw")
        if a.since:
            days = names.withColumns({"since": F.lit(a.since).cast("date"), "until": F.lit(a.until).cast("date") if a.until else F.date_add(F.current_date(), 1)})
            new, journal = crawl.searched(days, _function(a.source), known, pause=a.pause)
            journal.write.mode("append").parquet(f"{a.store}/searches")
            errors = journal.where("error is not null").select("account", "error")
        else:
            cursors = Store(spark, f"{a.store}/cursors", ["account"], 8)
            open_ = cursors.read() if a.resume else None
            got = crawl.crawled(names, _function(a.source), known, until=date.fromisoformat(a.backfill_to) if a.backfill_to else None, most=a.max_tweets, cursors=open_ and open_.select("account", "cursor"), pause=a.pause)
            # Where each account stands: at the page that failed, or at its start again.
            failed = got.where("error is not null").groupBy("account").agg(F.max("cursor").alias("cursor"))
            cursors.merge(names.select("account").distinct().join(failed, "account", "left"), upserted(["account"]))
            counts = got.where("id is not null").groupBy("account").agg(F.max("id").alias("last_tweet_id"), F.count("*").alias("total_tweets"))
            counts = names.select("account").distinct().join(counts, "account", "left").join(failed, "account", "left")
            changes = counts.select("account", "last_tweet_id", F.col("cursor").alias("last_cursor"), F.coalesce("total_tweets", F.lit(0)).cast("long").alias("total_tweets"))
            Store(spark, f"{a.store}/state", ["account"], 8).merge(changes, state.upsert_state)
            new, errors = got.where("id is not null"), got.where("error is not null").select("account", "error")
        new.select(F.concat(F.lit('{"tweets":['), "json_data", F.lit("]}")).alias("value")).write.mode("append").text(a.landing)
        errors.show(truncate=False)
    sync(spark, a.landing, a.store, f"{a.store}/checkpoint", files_per_batch=a.files_per_batch).awaitTermination()


def twitter_test(spark: SparkSession, a) -> None:
    """Whether the service answers for an account; an error ends the command with status 1."""
    error = crawl.reachable(_function(a.source), a.account)
    print(error or "ok")
    if error:
        raise SystemExit(1)


def twitter_status(spark: SparkSession, a) -> None:
    """Stored tweets as a whole, by account with its state and days, and the last searches."""
    if (processed := _stored(spark, f"{a.store}/processed")) is not None:
        state.table_stats(processed).show(truncate=False)
    stored = spark.read.parquet(f"{a.store}/raw")
    searches, states = _stored(spark, f"{a.store}/searches"), Store(spark, f"{a.store}/state").read()
    raw_rows = stored.select(F.coalesce(F.nullif("username", F.lit("")), "author").alias("account"))
    none = spark.createDataFrame([], "account string, last_tweet_id string, last_cursor string, total_tweets long")
    states = none if states is None else states
    journal = spark.createDataFrame([], "account string, fetch_date date") if searches is None else searches.where("error is null").select("account", F.explode(F.sequence("since", F.date_sub("until", 1))).alias("fetch_date"))
    accounts = raw_rows.union(states.select("account")).union(journal.select("account")).where("account is not null").distinct()
    state.status_report(accounts, states, raw_rows, journal).orderBy("account").show(a.rows, truncate=False)
    if searches is not None:
        searches.orderBy(F.desc("since"), "account").show(20, truncate=False)


def twitter_export(spark: SparkSession, a) -> None:
    rows = _between(spark.read.parquet(f"{a.store}/processed"), a.since, a.until)
    sinks.export_csv(state.selected(rows, author=a.account, ticker=a.ticker), a.output)


def ohlcv_sync(spark: SparkSession, a) -> None:
    """Merge landed bars into the store in place: only the symbols' buckets are written."""
    time = "bar_ts" if a.intraday else "bar_date"
    fetched = raw.read_feather_bars(spark, a.landing, time)
    store = Store(spark, a.store, ["symbol"], a.buckets)
    merge = bars.prepended if a.backfill else bars.appended
    print(f"version {store.merge(fetched, lambda old, new: merge(old, new, time), order=['symbol', time])}")
    store.vacuum()


def ohlcv_status(spark: SparkSession, a) -> None:
    daily, intraday = _bars(spark, a.daily_dir), _bars(spark, a.intraday_dir)
    report = bars.coverage(daily.select("symbol").distinct(), daily, intraday).orderBy("symbol")
    report.show(10 if a.details else 0, truncate=False)
    report.groupBy("status").count().show()


def prepare(spark: SparkSession, a) -> None:
    tweets = spark.read.option("header", True).csv(a.tweets) if a.tweets.endswith(".csv") else spark.read.parquet(a.tweets)
    tweets = _between(tweets.withColumn("ts", F.col("ts").cast("timestamp_ntz")), a.since, a.until)
    if a.exclude:
        tweets = tweets.join(spark.read.text(a.exclude).toDF("ticker"), "ticker", "left_anti")
    daily, intraday = _bars(spark, a.daily_dir), _bars(spark, a.intraday_dir)
    seen = Observation("prepare")
    out = enrich.enriched(tweets, daily, intraday, daily.where("symbol = 'SPY'"), spark.read.json(a.metadata), market.calendar(spark), observation=seen)
    sinks.write_dataset(out, a.output)
    print(json.dumps(seen.get))


def train(spark: SparkSession, a) -> None:
    rows, artifacts = model.prepared(raw.read_dataset(spark, a.data), NUMERICAL, model.CATEGORICAL, "timestamp", temporal=a.temporal_split, buy_boost=a.buy_weight_boost)
    rows.write.mode("overwrite").parquet(f"{a.output_dir}/rows")
    sinks.save_artifacts(artifacts, f"{a.output_dir}/artifacts")
    scratch.remove(spark, f"{a.output_dir}/network")  # of an earlier training
    if a.patience:
        rows = spark.read.parquet(f"{a.output_dir}/rows")
        net, history = network.trained(rows, NUMERICAL, epochs=a.epochs, batches=a.batches, rate=a.learning_rate, patience=a.patience)
        network.stored(net, spark).write.mode("overwrite").parquet(f"{a.output_dir}/network")
        print(json.dumps({"val_f1_macro": history}))
        return
    rows = model.vectors(spark.read.parquet(f"{a.output_dir}/rows"), NUMERICAL, model.CATEGORICAL)
    model.trained(rows, a.penalties, a.max_iter, a.tolerance).write().overwrite().save(f"{a.output_dir}/model")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Of the network that was trained there, or of the regression."""
    rows = spark.read.parquet(f"{folder}/rows").where("split = 'test'")
    if (stored := _stored(spark, f"{folder}/network")) is not None:
        net = network.loaded(stored)
        return network.predicted(net, network.inputs(rows, net.numerical, net.categorical))
    from pyspark.ml.classification import LogisticRegressionModel

    rows = model.vectors(rows, NUMERICAL, model.CATEGORICAL)
    return model.predicted(LogisticRegressionModel.load(f"{folder}/model"), rows, "tweet_hash")


def _reported(found: dict[str, DataFrame], output: str | None) -> None:
    for name, df in found.items():
        print(json.dumps({name: [r.asDict() for r in df.collect()]}, default=str))  # reports of a few rows
    if output:
        sinks.write_results(found, output)


def evaluate(spark: SparkSession, a) -> None:
    _reported(model.evaluated(_predictions(spark, a.model)), a.output)


def evaluate_ensemble(spark: SparkSession, a) -> None:
    """Models that were trained on one dataset and split, and the mean of their probabilities."""
    each = [_predictions(spark, folder).withColumn("model", F.lit(folder)) for folder in a.models]
    models = reduce(DataFrame.unionByName, each)
    _reported(metrics.ensemble_report(models.select("model", "id", "p_sell", "p_hold", "p_buy"), each[0].select("id", "label", "ret").dropDuplicates(["id"])), a.output)


def confidence_report(spark: SparkSession, a) -> None:
    """The sweep over confidence, quantiles, and the best threshold of each objective."""
    rows = scratch.saved(_predictions(spark, a.model), "predictions")
    sweep = scratch.saved(metrics.sweep_with_ic(rows), "sweep")
    sweep.orderBy("threshold").show(100, truncate=False)
    metrics.quantiles(rows).show()
    metrics.best_thresholds(sweep).show(truncate=False)
    if a.output:
        sinks.write_results({"sweep": sweep, "best": metrics.best_thresholds(sweep)}, a.output)


def filter_volume(spark: SparkSession, a) -> None:
    bars.liquid(raw.read_bars(spark, a.data_dir), a.min_volume).orderBy("symbol").coalesce(1).write.mode("overwrite").csv(a.output)


def check(spark: SparkSession, a) -> None:
    rows = raw.read_dataset(spark, a.data)
    if a.ticker:
        rows = rows.where(F.col("ticker") == a.ticker)
    if a.sample:
        rows = scratch.saved(state.sampled(rows, a.sample, "tweet_hash"), "sample")
    found = validate.violations(rows)
    found.show(truncate=False)
    if found.where("n_bad > 0").take(1):
        sys.exit(1)


def categorize(spark: SparkSession, a) -> None:
    df = spark.read.text(a.input).withColumn("category", text.categorized(F.col("value")))
    df.groupBy("category").count().orderBy(F.desc("count")).show(truncate=False)


#: command -> (function, options as (flag, keyword arguments))
COMMANDS = {
    "twitter-sync": (twitter_sync, [("--landing", {}), ("--store", {}), ("--source", {}), ("--account", {"nargs": "*"}), ("--accounts-file", {}), ("--full", {"action": "store_true"}), ("--resume", {"action": "store_true"}), ("--max-tweets", {"type": int}), ("--backfill-to", {}), ("--since", {}), ("--until", {}), ("--pause", {"type": float, "default": 0.2}), ("--estimate", {"action": "store_true"}), ("--accounts", {"type": int, "default": 6}), ("--months", {"type": int, "default": 1}), ("--files-per-batch", {"type": int})]),
    "twitter-test": (twitter_test, [("--source", {"required": True}), ("--account", {"required": True})]),
    "twitter-status": (twitter_status, [("--store", {"required": True}), ("--rows", {"type": int, "default": 100})]),
    "twitter-export": (twitter_export, [("--store", {"required": True}), ("--output", {"required": True}), ("--since", {}), ("--until", {}), ("--account", {}), ("--ticker", {})]),
    "ohlcv-sync": (ohlcv_sync, [("--landing", {"required": True}), ("--store", {"required": True}), ("--buckets", {"type": int, "default": 64}), ("--intraday", {"action": "store_true"}), ("--backfill", {"action": "store_true"})]),
    "ohlcv-status": (ohlcv_status, [("--daily-dir", {"required": True}), ("--intraday-dir", {"required": True}), ("--details", {"action": "store_true"})]),
    "prepare": (prepare, [("--tweets", {"required": True}), ("--output", {"required": True}), ("--daily-dir", {"required": True}), ("--intraday-dir", {"required": True}), ("--metadata", {"required": True}), ("--since", {}), ("--until", {}), ("--exclude", {})]),
    "train": (train, [("--data", {"required": True}), ("--output-dir", {"required": True}), ("--temporal-split", {"action": "store_true"}), ("--buy-weight-boost", {"type": float, "default": 1.0}), ("--penalties", {"type": float, "nargs": "*", "default": [0.0, 0.01, 0.1]}), ("--max-iter", {"type": int, "default": 30}), ("--tolerance", {"type": float, "default": 1e-6}), ("--patience", {"type": int}), ("--epochs", {"type": int, "default": 20}), ("--batches", {"type": int, "default": 4}), ("--learning-rate", {"type": float, "default": 3e-3})]),
    "evaluate": (evaluate, [("--model", {"required": True}), ("--output", {})]),
    "evaluate-ensemble": (evaluate_ensemble, [("--models", {"nargs": "+", "required": True}), ("--output", {})]),
    "confidence-report": (confidence_report, [("--model", {"required": True}), ("--output", {})]),
    "filter-volume": (filter_volume, [("--data-dir", {"required": True}), ("--min-volume", {"type": float, "default": 1e6}), ("--output", {"required": True})]),
    "validate": (check, [("--data", {"required": True}), ("--sample", {"type": int}), ("--ticker", {})]),
    "categorize": (categorize, [("--input", {"required": True})]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (function, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        for flag, how in options:
            sub.add_argument(flag, **how)
        sub.set_defaults(function=function)
    return top


def main(args: Sequence[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.function(spark, a)


if __name__ == "__main__":
    main()
