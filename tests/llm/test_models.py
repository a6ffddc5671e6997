"""Nearest neighbours, toxicity, mixing, packing and the pipeline."""

import itertools
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ann import Block, anisotropy, fit, nearest, packed_codes, scan
from tidemark.llm.mixing import mixed, mixture
from tidemark.llm.packing import Knapsack, configuration_lp, packed, plan, tokenizer_path
from tidemark.llm.toxicity import Ftrl, clean, toxicity_scores


def exact(rows, every=20, k=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = {}
    for q in (i for i in good if i % every == 0):
        near = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_on_small_data_is_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] + [1.0] * 7), (None, [1.0] * 8), (204, [1.0]), (205, [float("inf")] * 8), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, id int, score double")
    got = {}
    for x in nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = exact(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize("shape", ["gauss", "signs", "clusters"])
@pytest.mark.parametrize(("dims", "n"), [(64, 3000), (768, 1000), (1024, 1000), (4096, 500)])
def test_codes_keep_recall_on_wide_vectors(shape, dims, n):
    r = np.random.default_rng(dims)
    if shape == "gauss":
        x = r.normal(size=(n, dims))
    elif shape == "signs":
        x = r.choice([-1.0, 1.0], (n, dims))
    else:
        x = r.normal(size=(50, dims))[r.integers(50, size=n)] + 0.5 * r.normal(size=(n, dims))
    eta = anisotropy(dims)
    block, hits = Block(np.arange(n), x, fit(x[:200], eta, rounds=3), eta), []
    for q in range(0, n, n // 12):
        s = x @ x[q]
        s[q] = -np.inf
        least = np.sort(s)[-20] - 1e-6  # ties count alike
        hits.append(sum(-v >= least for v, _ in block.nearest(q, x[q], 20, 150)) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("blocks", [1, 13])
def test_recall_on_the_table(spark, blocks):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = table.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = nearest(table, every=100, blocks=blocks).toPandas()
    hits = []
    for q, rows in got.sort_values("rank").groupby("query_id"):
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        assert np.allclose(rows.score, [s[ids == v][0] for v in rows.vec_id], atol=1e-12) and (np.diff(rows.score) <= 0).all()
        hits.append(len(set(rows.vec_id) & set(ids[np.argsort(-s)[:20]])) / 20)
    assert len(hits) == (ids % 100 == 0).sum() and np.mean(hits) >= 0.97


def test_a_vector_that_a_third_of_all_rows_have(spark):
    r = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else r.normal(size=8).tolist()) for i in range(900)]
    got = {}
    for x in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=45, blocks=7).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in exact(rows, every=45).items()}


def test_ftrl_equals_the_plain_form():
    """Per-coordinate updates of the paper, one number at a time."""
    alpha, beta, l1, l2 = 0.3, 1.0, 0.5, 1e-3
    r = random.Random(3)
    examples = [(sorted(r.sample(range(12), r.randint(1, 5))), float(r.random() < 0.4)) for _ in range(400)]
    model, z, n = Ftrl(12, alpha, beta, l1, l2), [0.0] * 12, [0.0] * 12

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for features, label in examples:
        model.learn(np.array(features), label)
        w = {i: weight(i) for i in features}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in features:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert model.weights(np.arange(12)).tolist() == pytest.approx([weight(i) for i in range(12)])


def test_mixing_meets_its_targets(spark):
    rows = [(i, "word " * (1 + i % 7) + ("1234" if i % 3 == 0 else ""), "en" if i % 4 else "de", f"s{min(i % 10, 4)}", 1) for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __x int")
    want = {"source": {f"s{k}": 0.2 for k in range(5)}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.7, "numeric": 0.3}}
    got = mixed(docs, targets=want).withColumn("e", F.col("__tokens") * F.col("__probability"))
    for key, shares in want.items():
        sums = {r[0]: r[1] for r in got.groupBy("__topic" if key == "topic" else key).sum("e").collect()}
        for value, share in shares.items():
            assert sums[value] / sum(sums.values()) == pytest.approx(share, abs=1e-3)
    drawn = got.where("__kept").agg(F.sum("__tokens")).first()[0] / got.agg(F.sum("e")).first()[0]
    assert drawn == pytest.approx(1, abs=0.05)
    assert got.agg(F.max("__probability")).first()[0] == pytest.approx(1)


def raked(cells, targets):
    """Plain raking of {(source, lang, topic): tokens} to shares."""
    w = dict(cells)
    for _ in range(2000):
        for at, shares in enumerate(targets):
            sums = {}
            for k, v in w.items():
                sums[k[at]] = sums.get(k[at], 0) + v
            w = {k: v * shares.get(k[at], 0) / sums[k[at]] if sums[k[at]] else 0.0 for k, v in w.items()}
    return w


def test_mixing_equals_plain_raking(spark):
    r = random.Random(8)
    rows = [(i, "word " * r.randint(0, 9) + r.choice(["", "1234", "a@b", "Copyright"]), r.choice(["en", "de", None]), r.choice(["a", "b", "c"])) for i in range(3000)]
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    topic = {i: "legal" if "Copyright" in t else "contact" if "@" in t else "numeric" if "1234" in t else "prose" for i, t, *_ in rows}
    cells, targets = {}, []
    for i, _, lang, source in rows:
        key = (source, lang or "<null>", topic[i])
        cells[key] = cells.get(key, 0) + words[i]
    for at in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[at]] = sums.get(k[at], 0) + v
        total = sum(v**0.8 for v in sums.values())
        targets.append({k: v**0.8 / total for k, v in sums.items()})
    w = raked(cells, targets)
    ratio = {k: w[k] / t for k, t in cells.items() if t}
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    for x in got:
        want = ratio[(x.source, x.lang or "<null>", topic[x.doc_id])] / max(ratio.values()) if words[x.doc_id] else 1.0
        assert x["__topic"] == topic[x.doc_id] and x["__tokens"] == words[x.doc_id]
        assert x["__probability"] == pytest.approx(want, abs=2e-3)


def test_contradicting_targets_are_reported(spark):
    docs = spark.createDataFrame([(1, "x y", "en", "a"), (2, "x y", "de", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="off by"):
        assert len(mixed(docs, sweeps=3, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}).collect()) == 2


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x y", None, "a"), (3, "x y", None, "a"), (None, "z " * 50_000, "en", None)]
    docs = spark.createDataFrame([(*r, 9, 9, 9, 9, 9) for r in rows], "doc_id long, text string, lang string, source string, topic int, tokens int, __topic int, __tokens int, __cell_source int")
    out = mixed(docs).collect()
    assert len(out) == 5 and all(0 <= r["__probability"] <= 1 for r in out) and {r["__topic"] for r in out} == {9}
    assert {r["__topic_"] for r in out} == {"prose"} and {r["__topic_"] for r in mixed(docs, topic_col="topic").collect()} == {"9"}
    assert mixture(docs).count() == sum(r["__kept"] for r in out)
    assert mixture(docs).columns == docs.columns and mixture(docs.limit(0)).collect() == []


def test_scan_of_wide_vectors_does_not_wrap_round():
    import numpy as np

    centres = np.zeros((600, 16, 2))
    centres[:, 0] = 1.0
    codes = np.ones((3, 600), np.int64)
    codes[0], codes[1, :250] = 0, 0  # sums of 153,000, 63,750 and 0
    assert scan(np.ones(1200), packed_codes(codes), centres, 1).tolist() == [0]


def test_packing_is_whole_and_tight(spark, sf):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, "a", 1) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(9001, None, "a", 1), (9002, "", "a", 1), (None, "x", "a", 1), (9003, "Z\u00a0z É ﬁ <|endoftext|> a\u0301\x1cb " * 900, "a", 1), (9003, "again", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, number int")
    got = packed(docs).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(repr(d), p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    ids = [repr(None) if x != x else repr(int(x)) for x in got.doc_id]
    assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum([0, *s.length])[:-1]).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 * 1.02 + 1
    assert packed(docs.limit(0)).collect() == []


def test_knapsack_equals_brute_force():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = int(r.integers(1, 5))
        lengths, value, most, capacity = np.sort(r.choice(np.arange(1, 12), n, replace=False)), r.random(n), r.integers(1, 4, n), int(r.integers(12, 20))
        table = Knapsack(value, lengths, most, capacity)
        rooms = np.arange(capacity + 1)
        fillings = table.fillings(rooms)
        assert (fillings @ lengths <= rooms).all() and (fillings <= most).all()
        for room in rooms.tolist():
            best = max(float(np.dot(x, value)) for x in itertools.product(*(range(m + 1) for m in most)) if np.dot(x, lengths) <= room)
            assert table.worth[room] == pytest.approx(best) and float(fillings[room] @ value) == pytest.approx(best)


def optimum(pieces: list[int], capacity: int) -> int:
    pieces = sorted(pieces, reverse=True)
    for n in range(max(1, -(-sum(pieces) // capacity)), len(pieces) + 1):

        @lru_cache(None)
        def fits(i, rooms):
            return i == len(pieces) or any(fits(i + 1, tuple(sorted(rooms[:j] + (x - pieces[i],) + rooms[j + 1 :]))) for j, x in enumerate(rooms) if x >= pieces[i] and x not in rooms[:j])

        if fits(0, (capacity,) * n):
            return n


def test_plans_of_tiny_histograms_are_optimal():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice([10, 12, 20, 30])
        pieces = [r.randint(1, capacity) for _ in range(r.randint(1, 10))]
        histogram = {k: pieces.count(k) for k in set(pieces)}
        assert sum(n for n, _ in plan(histogram, capacity)) == optimum(pieces, capacity)


def test_the_program_beats_best_fit_where_that_goes_wrong():
    # 34 + 33 + 33 fills a sequence; best fit pairs the 34s first and needs 405.
    assert sum(n for n, _ in plan({34: 600, 33: 300, 50: 10}, 100)) == 380


def test_plans_hold_all_pieces_and_are_tight():
    r = np.random.default_rng(1)
    for top in (30, 2000):
        lengths, counts = np.unique(r.integers(1, top, 5000), return_counts=True)
        held: dict[int, int] = {}
        bins = 0
        for number, filling in plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 2048):
            assert sum(k * v for k, v in filling.items()) <= 2048
            bins += number
            for k, v in filling.items():
                held[k] = held.get(k, 0) + number * v
        assert held == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        assert bins <= math.ceil((lengths * counts).sum() / 2048) * 1.012
    fractions, bound = configuration_lp(lengths, counts, 2048, 0.03, 0.02)
    covered = np.zeros(len(lengths))
    for x, some, each in fractions:
        covered[some] += x * each
    assert (covered >= counts - 1e-6).all() and bound <= sum(x for x, *_ in fractions) + 1e-6
    assert plan({}, 2048) == [] and plan({2048: 3}, 2048) == [(3, {2048: 1})]


INTERNAL = "id label_id y slots slot weight score predicted held_out row sig n tokens doc_id_ text_sha256 points twin block owner __id __h __sha __s __points __row __suspect body keep keep_row stay t w s target chance kept topic probability __topic __tokens __probability __kept __source __lang __cell_source __cell_chance h last".split()


def test_every_stage_keeps_odd_rows_and_columns(spark):
    """Nulls in all columns, empty, long and repeated texts, ties, and the names the stages use."""
    import corpus_pipeline as c

    near = [f"n{k}" for k in range(80)]
    plain = " ".join(f"p{k}" for k in range(30))
    texts = [(None, None), (1, None), (1, None), (2, ""), (3, " \n"), (None, plain), (None, plain), (4, plain), (4, plain + " "), (5, " ".join(near)), (6, " ".join([*near, "x"])), (7, "long " * 60_000), (8, "A b C"), (8, "a B c"), (9, "vile words"), (10, "w1 w2 w3")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in INTERNAL)
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *[1] * len(INTERNAL)) for k, (i, t) in enumerate(texts)], schema)

    class Session:
        """A session whose labels are these."""

        def __getattr__(self, name):
            return self if name == "read" else getattr(spark, name)

        def parquet(self, path):
            return spark.createDataFrame([(100 + k, k % 2, 1) for k in range(20)] + [(None, None, 1)], "doc_id long, toxic int, __id int")

    kept = {"toxicity": 16, "exact_dedup": 9, "ngram_jaccard": 7}
    for name, stage in c.STAGES:
        docs_out = stage(Session(), near if name == "packing" else docs, "")  # the draw leaves few
        rows = docs_out.collect()
        near = docs_out if name == "ngram_jaccard" else near if name in ("mixing", "packing") else None
        if name != "packing":
            assert docs_out.columns == docs.columns
            docs = docs_out
            assert len(rows) == kept.get(name, len(rows)), name
        empty = stage(Session(), docs.limit(0), "")
        assert empty.collect() == []
    assert {(r.doc_id, r.piece) for r in rows} >= {(7, 0), (7, 1)}


def test_pipeline_equals_brute_force(spark, sf):
    """Every stage again in plain Python over all documents (the classifier's verdicts are given)."""
    import hashlib

    import corpus_pipeline as c
    from test_sets import shingles
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r.text or ""), r.doc_id)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), r)
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    topic = lambda t: "legal" if re.search("[Ll]icen[cs]e|[Cc]opyright", t) else "contact" if re.search("@|://", t) else "numeric" if re.search("[0-9]{3}", t) else "prose"
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    cell = {r.doc_id: (r.source or "<null>", r.lang or "<null>", topic(r.text or "")) for r in rows}
    cells, targets = {}, []
    for r in rows:
        cells[cell[r.doc_id]] = cells.get(cell[r.doc_id], 0) + words[r.doc_id]
    for at in range(3):
        sums = {}
        for k, v in cells.items():
            sums[k[at]] = sums.get(k[at], 0) + v
        targets.append({k: v**0.8 / sum(x**0.8 for x in sums.values()) for k, v in sums.items()})
    w = raked(cells, targets)
    top = max(w[k] / t for k, t in cells.items() if t)
    chance = {r.doc_id: w[cell[r.doc_id]] / cells[cell[r.doc_id]] / top if words[r.doc_id] else 1.0 for r in rows}
    draw = {r.doc_id: int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32 for r in rows}
    edge = {d for d in draw if abs(draw[d] - chance[d]) < 2e-3}  # raking stops within a tolerance
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), set()
    for r in rows:
        if draw[r.doc_id] < chance[r.doc_id] and r.doc_id not in edge:
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want |= {(r.doc_id, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))}
    got = c.run(spark, sf).toPandas()
    assert {x for x in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True) if x[0] not in edge} == want and len(want) > 20
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert (x.offset.to_numpy() == np.cumsum([0, *x.length])[:-1]).all() and x.length.sum() <= 2048


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    final = c.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(final.columns) and final.count() > 0
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
