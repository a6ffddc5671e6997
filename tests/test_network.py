"""The network: gradients, early stopping, the same result twice, the command."""

import json

import numpy as np
import pandas as pd
import pytest

from tidemark import cli
from tidemark.operators import metrics as M
from tidemark.operators import prep as P
from tidemark.operators.indicators import NUMERICAL
from tidemark.plans import model, network


def data(n=900, seed=3):
    r = np.random.default_rng(seed)
    sector = r.integers(0, 3, n)
    pdf = pd.DataFrame({c: r.normal(size=n) for c in NUMERICAL})
    # What decides: a category and a number together, and a word now and then.
    label = np.where(pdf["return_5d"] > 0, sector, (sector + 1) % 3)
    words = np.where(r.random(n) < 0.3, [f"word{k}" for k in label], "other")
    pdf = pdf.assign(text=words, label_1d_3class=[P.LABELS[k] for k in label], is_reliable_label=True, timestamp=pd.date_range("2024-01-01", periods=n, freq="h"), tweet_hash=[f"{k * 977:08x}{k:04x}" for k in range(n)], return_to_next_open=(label - 1) * 0.02, sector=[f"s{k}" for k in sector])
    for c in {*model.CATEGORICAL, "author", "category"} - {"sector"}:
        pdf[c] = r.choice(["x", "y"], n)
    return pdf


def test_gradients_equal_differences():
    net = network.fresh(["a", "b"], ["sector"], seed=1)
    r = np.random.default_rng(2)
    x, c = r.normal(size=(5, 2)), r.integers(0, 3, (5, 1))
    row, word = np.array([0, 0, 1, 3, 3, 3]), np.array([1, 2, 2, 7, 7, 1])
    label, weight = np.array([0, 1, 2, 1, 0]), np.array([1.0, 0.5, 2.0, 1.0, 3.0])

    def loss():
        p = network.forward(net, x, c, row, word)[2]
        return float((-np.log(p[np.arange(5), label]) * weight).sum())

    found = network.gradients(net, x, c, row, word, label, weight)
    for name, at in (("w1", (0, 3)), ("w1", (9, 7)), ("b1", (5,)), ("w2", (4, 1)), ("b2", (2,)), ("sector", (1, 3)), ("words", (7, 2)), ("words", (1, 0)), ("words", (9, 0))):
        v = net.values[name]
        kept, step = v[at], 1e-5
        v[at] = kept + step
        up = loss()
        v[at] = kept - step
        down = loss()
        v[at] = kept
        assert found[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-5), (name, at)


@pytest.fixture(scope="module")
def rows(spark):
    made, _ = model.prepared(spark.createDataFrame(data()), NUMERICAL, model.CATEGORICAL, "timestamp")
    return made.cache()


def test_it_beats_the_majority_and_gives_the_same_twice(spark, rows):
    net, history = network.trained(rows, NUMERICAL, epochs=12, batches=3, rate=1e-2, patience=4)
    test = network.inputs(rows.where("split = 'test'"), NUMERICAL, model.CATEGORICAL)
    out = network.predicted(net, test)
    score, base = M.scores(out).first(), M.baselines(out).first()
    assert out.count() == test.count() and score.accuracy > base.naive_accuracy + 0.15
    best = int(np.argmax(history))
    assert len(history) <= best + 1 + 4
    again, other = network.trained(rows.repartition(5), NUMERICAL, epochs=2, batches=3, rate=1e-2)
    first, one = network.trained(rows, NUMERICAL, epochs=2, batches=3, rate=1e-2)
    assert one == other and all(np.array_equal(first.values[k], again.values[k]) for k in first.values)
    kept = network.loaded(network.stored(net, spark))
    assert all(np.array_equal(net.values[k], kept.values[k]) for k in net.values) and kept.categorical == net.categorical


def test_training_stops_when_validation_gets_no_better(rows):
    _, history = network.trained(rows, NUMERICAL, epochs=30, batches=1, rate=0.0, patience=2)
    assert len(history) == 3


def test_odd_rows_and_none(spark, rows):
    odd = rows.limit(1).drop("text", *NUMERICAL).crossJoin(spark.createDataFrame([(None,), ("",), ("w " * 20_000,)], "text string"))
    for c in NUMERICAL:
        odd = odd.withColumn(c, M.F.lit(None).cast("double"))
    net = network.fresh(NUMERICAL, model.CATEGORICAL)
    out = network.predicted(net, network.inputs(odd, NUMERICAL, model.CATEGORICAL)).collect()
    assert len(out) == 3 and all(abs(x.p_sell + x.p_hold + x.p_buy - 1) < 1e-9 for x in out)
    _, history = network.trained(rows.where("false"), NUMERICAL, epochs=1)
    assert history == [0.0]


def test_train_with_patience(spark, tmp_path, capfd):
    spark.createDataFrame(data(400)).write.parquet(f"{tmp_path}/data")

    def run(*args):
        a = cli.parser().parse_args([str(x) for x in args])
        a.function(spark, a)

    run("train", "--data", f"{tmp_path}/data", "--output-dir", f"{tmp_path}/m", "--temporal-split", "--patience", 1, "--epochs", 2, "--batches", 1)
    assert json.loads(capfd.readouterr().out.splitlines()[-1])["val_f1_macro"]
    run("evaluate", "--model", f"{tmp_path}/m")
    assert json.loads(capfd.readouterr().out.splitlines()[0])["scores"][0]["n"] == 40
