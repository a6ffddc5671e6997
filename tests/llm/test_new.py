"""Hard negatives, spelling variants and byte-level BPE against plain forms."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.llm import hard_negatives as hard
from tidemark.llm import exact_dedup, ngram_jaccard, spelling, toxicity
from tidemark.llm.byte_bpe import Encoder, decoded, encoded, read_ranks, tokenizer_path, tokenizer_pattern
from tidemark.llm.common import BYTES, LANES, MIX, POSITION
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.toxicity import clean, toxicity_scores


def mined(rows, every=100):
    by = {}
    for name, label, v in rows:
        if None in (name, label, v) or len(v) != 6 or any(x is None or not math.isfinite(x) for x in v):
            continue
        by[name] = min(by.get(name, (label, v)), (label, v))
    x = {k: (label, [math.floor(256 * c) for c in v]) for k, (label, v) in by.items()}
    out = set()
    for a in (k for k in x if k % every == 0):
        score = {k: sum(p * q for p, q in zip(x[a][1], v, strict=True)) for k, (_, v) in x.items() if k != a}
        first = sorted((-s, k) for k, s in score.items() if x[k][0] == x[a][0])[:5]
        for s, positive in ((-m, k) for m, k in first):
            window = sorted((-n, k) for k, n in score.items() if x[k][0] != x[a][0] and 80 * s <= 100 * n <= 100 * s)[:5]
            out |= {(a, positive, r, k, s, -m) for r, (m, k) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("anchor_bytes", [1 << 24, 100])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, anchor_bytes):
    monkeypatch.setattr(hard, "SCORES", 500)
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(4)), np.round(r.normal(size=6), 2).tolist()) for i in range(1500)]
    # A third of all rows are one vector, so that ties fill every window.
    rows += [(2000 + i, i % 5, [0.5] * 6) for i in range(700)]
    rows += [(5, 0, [1.0] * 6), (None, 1, [1.0] * 6), (4001, None, [1.0] * 6), (4002, 1, None), (4003, 1, [None] * 6), (4100, 1, [float("nan")] * 6), (4200, 1, [float("inf")] + [1.0] * 5), (4300, 2, [0.0] * 6), (4400, 3, []), (4500, 3, [1.0])]
    df = spark.createDataFrame([(i, label, v, 1, 2) for i, label, v in rows], "vec_id long, label int, embedding array<double>, id int, v int").repartition(7)
    got = [tuple(x) for x in hard.hard_negatives(df, anchor_bytes=anchor_bytes).collect()]
    assert set(got) == mined(rows) and len(got) == len(set(got)) > 100


def test_hard_negatives_of_nothing_and_of_huge_numbers(spark):
    df = spark.createDataFrame([(100, 1, [1e9] * 2), (101, 1, [1e9] * 2)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="2\\^53"):
        hard.hard_negatives(df)
    assert hard.hard_negatives(df.limit(0)).collect() == []
    assert hard.hard_negatives(df.where("vec_id = 101")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3)), min_size=1, max_size=60), st.integers(1, 3), st.integers(1, 7))
def test_best_keeps_the_first_of_each_slot(rows, k, step):
    best, want = hard.Best(4, k), defaultdict(list)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        best.add(np.array([s for s, _ in part]), np.array([float(v) for _, v in part]), np.arange(at, at + len(part)))
    for i, (slot, score) in enumerate(rows):
        want[slot].append((-score, i))
    slot, ids, score = best.rows()
    assert sorted(zip(slot.tolist(), (-score).tolist(), ids.tolist(), strict=True)) == sorted((s, *x) for s, v in want.items() for x in sorted(v)[:k])


def plain_words(docs, damage):
    found = Counter()
    for name, text in docs:
        for run in spelling_runs(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
            if damage and h % damage == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def spelling_runs(text):
    import re

    return re.findall("[A-Za-zÀ-ÿ]+", text)


def plain_variants(n):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, {}
    for w in n:
        found = sorted((-n[x], x) for x in n if x != w and near(w, x))
        best = found[0][1] if found and n[found[0][1]] >= 5 * n[w] else None
        form[w] = best
        out[w] = (best, n[w], len(found), n[best] if best else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


@pytest.mark.parametrize(("shard_words", "compared"), [(50_000, 24), (20, 2)])
def test_variants_equal_brute_force(spark, monkeypatch, shard_words, compared):
    monkeypatch.setattr(spelling, "COMPARED", compared)
    r = random.Random(4)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["inter" + "".join(r.choice("ab") for _ in range(3)) for _ in range(30)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = stems[min(int(r.expovariate(0.05)), len(stems) - 1)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("ab") + w[k:], w[:k] + r.choice("ab") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "1"]).join(words)))
    rows += [(None, "abcdefg " * 6), (7, None), (8, ""), (9, "ÉABCDEF éabcdef " * 3), (10, "word " * 50_000), rows[0]]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, word int, n int").repartition(5)
    want = plain_variants(plain_words(rows, 7))
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.spelling_variants(spelling.word_counts(docs, damage=7), shard_words=shard_words).collect()}
    assert got == want
    assert sum(v[0] is not None for v in got.values()) > 20 and any(v[1] != v[0] for v in got.values() if v[0])


def test_roots_of_a_long_chain_and_of_no_words(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(21)], "word string, form string")
    assert {x.root for x in spelling.roots(forms).collect()} == {"w21"}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(docs)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_one_edit(a, b):
    edits = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in "ab"} | {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in "ab"}
    assert spelling.one_edit(a, b) == (b in edits and a != b)


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(tokenizer_path())


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  \n\t x", "it's they'll we'LL 'd '", "a" * 5000, "x1y2" * 800, "   " * 900 + "z", "é中文字符" * 700, "́‍👩‍👩‍👧 <|endoftext|>" * 60, "\r\n" * 900, "'ll" * 700, "!?" * 1500 + " end", "word " * 900, "\x00\x1f", "a  b   c    d" * 200]


@pytest.fixture(scope="module")
def small(ranks):
    return [Encoder(ranks, tokenizer_pattern(), leaf=leaf, piece_leaf=0, window=window, piece_window=1) for leaf, window in ((1, 1), (3, 2), (17, 4), (200, 64))]


def test_encoding_of_odd_texts_equals_the_library(library, small):
    for encoder in small:
        for text in ODD:
            ids = encoder.encode(text[: 400 * encoder.leaf]).tolist()
            assert ids == library.encode_ordinary(text[: 400 * encoder.leaf])
            assert encoder.decode(ids) == text[: 400 * encoder.leaf].encode()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aelst'LR \n\t.!1٣é中  👍"), max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoding_equals_the_library(library, small, text):
    want = library.encode_ordinary(text)
    assert all(encoder.encode(text).tolist() == want for encoder in small)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(["ab", "ACGT", "0", "aeinrst", "é中a", "=-"]))
def test_long_matches_equal_the_library(ranks, library, small, seed, letters):
    r = random.Random(seed)
    text = "".join(r.choice(letters) * r.choice([1, 1, 2, 30]) for _ in range(400))
    encoder = small[2]
    assert encoder.long_match(text.encode()) == library._encode_single_piece(text)


def test_parts_are_a_monoid(small):
    encoder, text = small[2], "It's  the\n\n end, isn't it?  'll " * 9
    whole = encoder.part(text, 0, len(text))
    for cut in range(1, len(text)):
        both = encoder.join(text, encoder.part(text, 0, cut), encoder.part(text, cut, len(text)))
        assert both.ids.tolist() == whole.ids.tolist() and both.starts.tolist() == whole.starts.tolist()


def test_op13_round_trip(spark, library):
    rows = [(k, t, 1, 2) for k, t in enumerate(ODD)] + [(None, None, 1, 2), (3, "again", 1, 2), (3, "again", 1, 2), (99, "Long text, é. " * 100_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded int")
    got = Counter((x.doc_id, tuple(x.ids), bytes(x.decoded)) for x in decoded(encoded(docs)).collect())
    assert got == Counter((k, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in rows)
    assert decoded(encoded(docs.limit(0))).collect() == []
    with pytest.raises(Exception, match="KeyError"):
        decoded(spark.createDataFrame([([999_999],)], "ids array<int>")).collect()


def test_op13_on_the_table(spark, sf, library):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in QUERIES["op13_byte_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(texts[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()


def test_op12_on_the_table(spark, sf):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in QUERIES["op12_spelling"](spark, sf).collect()}
    assert got == plain_variants(plain_words(rows, 199)) and got


def test_op11_equals_its_sql(spark, sf, duck, same):
    same(QUERIES["op11_hard_negatives"](spark, sf).toPandas(), duck(sf, ORACLES["op11_hard_negatives"]))


# ---------------------------------------------------------------- op8


def toxic_rows(n=1200):
    r = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = list(r.choice(vocab, r.integers(5, 60)))
        toxic = i % 8 == 0
        if toxic:
            words.insert(r.integers(len(words)), r.choice(["Vile!", "vile", "awful,"]))
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    rows += [(5000, None, "x", 0.5), (5001, "", "x", 0.5), (None, "vile vile", "x", 0.5), (5002, "w1 " * 100_000 + "vile", "x", 0.5), (3, rows[3][1], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity_scores(docs, lab).toPandas()
    assert len(out) == len(rows)
    known = out[out.doc_id < 1200].drop_duplicates("doc_id").set_index("doc_id")
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert set(known.index[known.held_out]) == set(held)
    assert np.mean([known.predicted[i] == (i % 8 == 0) for i in held]) > 0.97
    assert out[out.doc_id == 5002].predicted.item() == 1 and out[out.doc_id == 5000].score.item() == out[out.doc_id == 5001].score.item()
    kept = {x.doc_id for x in clean(docs, lab).collect()}
    assert kept == set(out[out.predicted == 0].doc_id.dropna().astype(int)) | ({None} if (out[out.doc_id.isna()].predicted == 0).all() else set())
    none = toxicity_scores(docs.limit(3), lab.limit(0)).collect()
    assert [x.score for x in none] == [0.0] * 3 and toxicity_scores(docs.limit(0), lab).collect() == []


def plain_slots(text, bits):
    """Slots of a text's words, pairs and skip-grams, one number at a time."""
    import re

    mask = 2**64 - 1

    def mixed(h):
        for m in MIX:
            h = ((h ^ (h >> 33)) * int(m)) & mask
        return h ^ (h >> 33)

    words = []
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        h = sum(int(BYTES[b]) * pow(int(POSITION), k, 2**64) for k, b in enumerate(w)) & mask
        words.append(mixed(h))
    lane = [int(x) for x in LANES[:6]]
    found = {mixed(w * lane[0] & mask) for w in words}
    for gap in (1, 2):
        found |= {mixed((a * lane[2 * gap] + b * lane[2 * gap + 1]) & mask) for a, b in zip(words, words[gap:], strict=False)}
    return {h >> (64 - bits) for h in found}


def test_scores_equal_plain_learning(spark):
    rows, labels = toxic_rows(200)
    rows += [(900, None, "x", 0.5), (901, "", "x", 0.5), (902, "Äpfel-Birnen vile 1st", "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string, score double")
    lab = spark.createDataFrame([*labels, (900, 1), (17, 0)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity_scores(docs, lab).collect()}
    order = [x.doc_id for x in docs.orderBy(F.xxhash64("doc_id")).collect()]
    truth = dict([*labels, (900, 1)])
    bits = toxicity.BITS
    slots = {i: [*plain_slots(t, bits), "bias"] for i, t, *_ in rows}
    learnt = [i for i in order if i in truth and zlib.crc32(str(i).encode()) % 4 != 2]
    model = toxicity.Ftrl(1)
    alpha, beta, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    z, n = defaultdict(float), defaultdict(float)

    def weight(s):
        return 0.0 if abs(z[s]) <= l1 else -(z[s] - math.copysign(l1, z[s])) / ((beta + math.sqrt(n[s])) / alpha + l2)

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(learnt)):
            own = slots[learnt[k]]
            w = {s: weight(s) for s in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - truth[learnt[k]]
            for s in own:
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / alpha * w[s]
                n[s] += g * g
    want = {i: 1 / (1 + math.exp(-sum(map(weight, own)))) for i, own in slots.items()}
    assert got == pytest.approx(want, abs=1e-9) and len({round(x, 6) for x in got.values()}) > 2


# ---------------------------------------------------------------- op1 and the pipeline


def test_a_list_of_very_many_unlinked_sets_is_handed_on_in_parts(spark, monkeypatch):
    """Texts that share one passage are in one list and linked with nothing."""
    monkeypatch.setattr(ngram_jaccard, "FOUND", 500)
    r = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} {' '.join(f'{i}w{k}' for k in range(r.choice([12, 13, 14])))}", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in sets}


def test_the_pipeline_leaves_only_what_its_stages_return(spark, sf):
    import corpus_pipeline

    before = len(scratch._saved)
    assert corpus_pipeline.run(spark, sf).count() > 0
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._saved[before:]]
    assert names[:4] == ["stage-toxicity", "stage-exact_dedup", "stage-ngram_jaccard", "stage-mixing"]
    assert spark.read.parquet(scratch._saved[before]).count() > 0


# ---------------------------------------------------------------- op4


def test_lists_of_many_splits_are_dense_at_thousands_of_owners(spark):
    """Below seven bytes a fingerprint with a list's fixed columns, against eight uncoded."""
    n = 2 * exact_dedup.BLOCK_ROWS
    rows = spark.range(n, numPartitions=40).select(F.col("id").alias("doc_id"), F.lit("s").alias("text_sha256"), F.lit(1).cast("long").alias("points"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("print"))
    lists = exact_dedup._blocks(rows.coalesce(2), 12).where("kind = 1")
    size = lists.agg(F.sum(F.octet_length("unary") + F.octet_length("rest") + 28).alias("b"), F.sum("slot").alias("n")).first()
    assert size.n == n and size.b / size.n < 7


@pytest.mark.parametrize("limit", [0, 10**9])
def test_copies_in_many_blocks_by_either_plan(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", limit)
    r = random.Random(2)
    rows = [(i, r.choice(["hot text", " hot  text", f"own {i}", f"pair {i // 2}"]), 1) for i in range(700)] + [(None, None, 1), (1000, "", 1), (1001, " \n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(9)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups["".join((t or "").split())].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for body, members in groups.items():
        keep = min(members)[3]
        for *_, i in members:
            want[i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    got = Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.exact_duplicates(docs).collect())
    assert got == want
