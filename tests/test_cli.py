"""Commands, run as a user would."""

import json

import numpy as np
import pandas as pd
import pytest

from tidemark import cli
from tidemark.operators import prep as P
from tidemark.operators.indicators import NUMERICAL
from tidemark.plans import model


def run(spark, *args):
    a = cli.parser().parse_args([str(x) for x in args])
    a.function(spark, a)


def test_sync_by_account_range_and_status(spark, tmp_path, capfd):
    store, landing = tmp_path / "store", tmp_path / "landing"
    source = ("--landing", landing, "--store", store, "--pause", 0, "--source")
    run(spark, "twitter-sync", *source, "test_crawl:page", "--account", "1", "2", "11", "--max-tweets", 5)
    ids = lambda: sorted(int(r.id) for r in spark.read.parquet(f"{store}/raw").collect())
    assert ids() == [1000, 1001, 1002, 1003, 1004, 2000, 2001, 2002, 2003, 2004]
    run(spark, "twitter-sync", *source, "test_crawl:page", "--account", "1", "2")
    assert len(ids()) == 10  # the first tweet is known
    (tmp_path / "accounts").write_text("1\n")
    run(spark, "twitter-sync", *source, "test_crawl:search", "--accounts-file", tmp_path / "accounts", "--since", "2024-02-29", "--until", "2024-03-01")
    assert ids()[:12] == list(range(1000, 1012)) and len(ids()) == 17
    run(spark, "twitter-status", "--store", store)
    assert "no such account" in capfd.readouterr().out


def test_sync_resumes_where_a_page_failed(spark, tmp_path, capfd):
    folder = str(tmp_path / "broken")
    pages_of = tmp_path / "pages_of.py"
    pages_of.write_text(f"""
import os, sys
from pyspark import cloudpickle


def page(account, cursor):
    at = int(cursor or 0)
    with open({folder!r} + "-asked", "a") as f:
        f.write(f"{{account}}:{{at}} ")
    if at == 1 and not os.path.exists({folder!r}):
        raise OSError("gone")
    return [{{"id": f"{{account}}{{9 - at}}", "createdAt": "Wed Jan 10 10:00:00 +0000 2024", "text": "x"}}], str(at + 1) if at < 2 else None


cloudpickle.register_pickle_by_value(sys.modules[__name__])
""")
    import sys

    sys.path.insert(0, str(tmp_path))
    source = ("--landing", tmp_path / "landing", "--store", tmp_path / "store", "--pause", 0, "--source", "pages_of:page", "--account", "a", "b")
    run(spark, "twitter-sync", *source)
    ids = lambda: {r.id for r in spark.read.parquet(f"{tmp_path}/store/raw").collect()}
    assert ids() == {"a9", "b9"}
    open(folder, "w").close()
    open(f"{folder}-asked", "w").close()
    run(spark, "twitter-sync", *source, "--resume")
    assert ids() == {x + str(k) for x in "ab" for k in (9, 8, 7)}
    assert sorted(open(f"{folder}-asked").read().split()) == ["a:1", "a:2", "b:1", "b:2"]
    capfd.readouterr()
    run(spark, "twitter-status", "--store", tmp_path / "store")
    assert "|a      |a8" in capfd.readouterr().out


def test_train_evaluate_ensemble_and_confidence(spark, tmp_path, capfd):
    r = np.random.default_rng(3)
    n = 300
    label = r.integers(0, 3, n)
    pdf = pd.DataFrame({c: r.normal(size=n) + (label if c == "return_5d" else 0) for c in NUMERICAL})
    pdf = pdf.assign(text=[f"word{k}" for k in label], label_1d_3class=[P.LABELS[k] for k in label], is_reliable_label=True, timestamp=pd.date_range("2024-01-01", periods=n, freq="h"), tweet_hash=[f"{k * 97:08x}0000" for k in range(n)], return_to_next_open=(label - 1) * 0.02)
    for c in {*model.CATEGORICAL, "author", "category"}:
        pdf[c] = r.choice(["x", "y"], n)
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/data")
    run(spark, "train", "--data", f"{tmp_path}/data", "--output-dir", f"{tmp_path}/m", "--temporal-split", "--penalties", 0.01, "--max-iter", 10)
    capfd.readouterr()
    run(spark, "evaluate-ensemble", "--models", f"{tmp_path}/m", f"{tmp_path}/m", "--output", f"{tmp_path}/e")
    found = spark.read.json(f"{tmp_path}/e").first()
    assert {x.model for x in found.models} == {f"{tmp_path}/m", "ensemble"} and all(x.n == 30 for x in found.models if x.model == "ensemble")
    assert json.loads(capfd.readouterr().out.splitlines()[0])["models"]
    run(spark, "confidence-report", "--model", f"{tmp_path}/m", "--output", f"{tmp_path}/c")
    assert len(spark.read.json(f"{tmp_path}/c").first().sweep) == 13


def test_unknown_commands_are_refused():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["evaluate-ensemble"])
