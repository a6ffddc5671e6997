"""n-gram Jaccard join and exact dedup against brute force."""

import hashlib
import random
import re
import string

import pytest

from tidemark.llm.components import components
from tidemark.llm.exact_dedup import deduplicated, exact_duplicates, rice_decode, rice_encode
from tidemark.llm.ngram_jaccard import jaccard_components, link_counts, representatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, sig long, n string, a int, row long, owner string, body int"


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(s), repr(least.get(find(i), d))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, i = [], 0
    passage = [r.choice(vocab) for _ in range(60)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 40, 120]))]
        if r.random() < 0.3:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                k = r.randrange(len(copy))
                copy[k : k + r.choice([0, 1])] = [r.choice(vocab)]
            rows.append((i, " ".join(copy) if r.random() < 0.8 else "\t".join(copy).upper()))
            i += 1
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO"), (1005, "one two three"), (None, "one two"), (1003, "One two"), (1006, "x" * 50_000), (1007, "x" * 50_000 + " y"), (1008, "é Ä é Ä é Ä"), (1009, "é Ä é Ä é ä")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "x", 2, 3, "o", 4) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = corpus(seed) + EDGES
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows)


def test_truncated_copies_of_documents_with_a_shared_passage(spark):
    """Whole documents lead their truncated copies; only the copies of two of them are linked."""
    texts = []
    for g in range(40):
        words = iter(f"g{g}w{k}" for k in range(1000))
        passage = [next(words) for _ in range(84)]
        for _ in range(2):
            whole = passage + [next(words) for _ in range(25)]
            texts += [" ".join(whole), " ".join(whole + [next(words) for _ in range(3)]), " ".join(whole[:97])]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = jaccard_components(frame(spark, rows)).collect()
    assert sorted((repr(x.doc_id), x.n_shingles, repr(x.component_id)) for x in got) == brute(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).collect() == []
    assert [r.component_id for r in jaccard_components(frame(spark, [(5, None)])).collect()] == [5]


def test_link_counts_equal_brute_force(spark):
    rows = corpus(6) + EDGES
    sets = [shingles(t) for _, t in rows]
    want = [(repr(d), sum(j != i and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets) if t) if s else 0) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    assert sorted((repr(r.doc_id), r.n_links) for r in link_counts(frame(spark, rows)).collect()) == sorted(want)


def test_representatives_keep_the_least_id(spark):
    rows = corpus(3)
    got = {r.doc_id for r in representatives(frame(spark, rows)).collect()}
    assert got == {int(c) for d, _, c in brute(rows) if d == c}


def test_representatives_of_repeated_and_null_ids(spark):
    words = [f"v{k}" for k in range(60)]
    a, near, other, third = " ".join(words), " ".join([*words, "x"]), " ".join(reversed(words)), " ".join(f"u{k}" for k in range(20))
    rows = [(1, a), (7, near), (7, other), (9, third), (9, third), (None, near), (None, third + " x"), (None, "lone words"), (None, "lone words"), (3, None), (3, None), (5, "p q r"), (5, "p Q r"), (None, None)]
    got = sorted((repr(r.doc_id), (r.text or "").lower()) for r in representatives(frame(spark, rows)).collect())
    assert got == sorted([("1", a), ("7", other), ("9", third), ("None", "lone words"), ("3", ""), ("3", ""), ("5", "p q r"), ("None", "")])


def test_components_of_a_long_chain_in_many_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (None, 3)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(links, task_links=20).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_rice_codes_round_trip():
    import numpy as np

    r = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 10), (1000, 2**50), (300, 400)):
        values = np.unique(r.integers(0, top, n))
        k, unary, rest = rice_encode(values)
        assert (rice_decode(len(values), k, unary, rest) == values).all()


def test_exact_duplicates_equal_brute_force(spark):
    rows = corpus(4) + EDGES
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for body, members in groups.items():
        keep = min(members)
        taken = False
        for m in members:
            first = m == keep and not taken
            taken |= first
            want.append((repr(m[3]), repr(keep[3]), len(members), first, hashlib.sha256(body.encode()).hexdigest()))
    got = [(repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_deduplicated_keeps_one_row_of_each_text(spark):
    rows = corpus(5) + EDGES + [(1001, "another text"), (7, "another text")]
    out = deduplicated(frame(spark, rows)).collect()
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out]
    assert len(bodies) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    assert exact_duplicates(frame(spark, [])).collect() == []
