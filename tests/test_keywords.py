"""The automaton against plain substring search; cleaning of rows of all kinds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import keywords, text
from tidemark.functions.keywords import Automaton


def plain(texts, topics, other="Other"):
    return [next((name for name, words in topics.items() if any(w in (t or "") for w in words)), other) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abé ", min_size=1, max_size=4), min_size=1, max_size=5), min_size=1, max_size=5), st.lists(st.none() | st.text("abcé ", max_size=30), max_size=12))
def test_topics_equal_plain_search(words, texts):
    topics = {f"t{k}": w for k, w in enumerate(words)}
    assert Automaton(topics).topics(pa.array(texts, pa.string()), "Other").to_pylist() == plain(texts, topics)


@pytest.mark.parametrize(("width", "lanes"), [(7, 3), (64, 2), (512, 8192)])
def test_the_full_table_on_long_texts_at_every_cut(monkeypatch, width, lanes):
    monkeypatch.setattr(keywords, "WIDTH", width)
    monkeypatch.setattr(keywords, "LANES", lanes)
    assert sum(map(len, text.TOPICS.values())) == 247
    r = random.Random(width)
    all_words = [w for words in text.TOPICS.values() for w in words]
    texts = ["", None, "x" * 2000] + ["".join(r.choice("xyz é") for _ in range(r.randrange(900))) + r.choice(["", r.choice(all_words)]) + "z" * r.randrange(40) for _ in range(300)] + all_words
    assert Automaton(text.TOPICS).topics(pa.array(texts), "Other").to_pylist() == plain(texts, text.TOPICS)
    sliced = pa.array(texts).slice(100, 150)
    assert Automaton(text.TOPICS).topics(sliced, "Other").to_pylist() == plain(texts[100:250], text.TOPICS)


def test_a_text_does_not_reach_into_the_next_and_empty_tables_pass():
    assert Automaton({"a": ["ab"]}).topics(pa.array(["xa", "bx"]), "-").to_pylist() == ["-", "-"]
    assert Automaton({"a": ["ab"]}).topics(pa.array([], pa.string()), "-").to_pylist() == []
    assert np.array_equal(Automaton({"a": [""], "b": ["x"]}).found(np.frombuffer(b"x", np.uint8), np.array([0, 1])), [3])


def test_categorized_lower_cases_and_takes_odd_rows(spark):
    rows = [("FDA approves",), ("nothing here",), (None,), ("",), ("Keep Q1",), ("word " * 100_000 + "Takeover",)]
    got = [x.c for x in spark.createDataFrame(rows, "text string").select(text.categorized(text.F.col("text")).alias("c")).collect()]
    assert got == ["Regulatory & Legal", "Other", "Other", "Other", "Earnings", "Mergers & Acquisitions"]
