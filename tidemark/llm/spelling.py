"""Spelling variants: words one edit apart, found by automatons over their halves.

One insertion, deletion or replacement leaves one half of a word as it is: the first half
then begins the other word, or the second half ends it.  So

1.  Words are counted over all texts; what is rare is left out.
2.  Each word gives two segments, its halves.  Automaton shards are dealt by the first three
    characters of a first half and the last three of a second one, as a word can only hold
    a segment at that end if it shares those: a word is scanned by the shards of its own
    two ends only, and not by all.  Ends that very many words share are cut into several
    shards, and words with such an end are scanned by each of them.
3.  A shard's automaton (Aho-Corasick) holds the halves of its words; every word of its ends
    runs through it.  A hit counts if its offset is the segment's and the lengths differ by
    one at most; then the distance is verified.  Where very many words share a segment, the
    rest of the scanned word is looked up among the rests with one character left out, so
    that no two words of a segment need be compared that can't be near.
4.  A shard sums up per word: how many words are near, and which of them is most frequent.

Words that are near are found twice, once from each; a pair that both halves show counts
for the first half alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, tidy

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a word's end that choose its shard; no half of a word may be shorter.
END = 3
#: Words whose halves an automaton holds, on average and for one end at most.
SHARD_WORDS = 50_000
#: Words of one segment from which on their rests are looked up instead of compared.
COMPARED = 24


def damaged(word: Column, doc_id: Column, every: int) -> Column:
    """``word``, one character left out where ``every`` divides the sum of the row's checks."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, shortest: int = 6, damage: int | None = None) -> DataFrame:
    """``(word, n)``: runs of letters of whole texts, lower-cased in A-Z, with ``n`` of ``least``.

    Words of fewer than ``shortest`` characters are left out.  ``damage`` leaves out a
    character of one in so many occurrences, by a check sum of ``<id>:<word>`` (a null id
    is empty there).  Null and empty texts have no words; other columns are ignored.
    """
    if shortest < 2 * END:
        raise ValueError(f"words need {2 * END} characters, so that each half has {END}")
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= shortest).withColumn("word", F.translate("run", UPPER, LOWER))
    if damage:
        runs = runs.withColumn("word", damaged(F.col("word"), F.col("id"), damage)).where(F.char_length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def shortened(rest: str) -> set[str]:
    return {rest, *(rest[:k] + rest[k + 1 :] for k in range(len(rest)))}


class Shard:
    """An automaton over one half of each of its words."""

    def __init__(self, words: list[str], sides: list[int]):
        import ahocorasick

        self.words = words
        self.near = np.zeros(len(words), np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(words)
        self.rests: dict[tuple[int, str], dict[str, list[int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for k, (word, side) in enumerate(zip(words, sides, strict=True)):
            half = len(word) // 2
            segment = word[half:] if side else word[:half]
            held = self.automaton.get(segment, None)
            if held is None:
                held = (segment, {}, {})
                self.automaton.add_word(segment, held)
            held[1 + side].setdefault(len(word), []).append(k)
        if words:
            self.automaton.make_automaton()

    def candidates(self, segment: str, side: int, by_length: dict[int, list[int]], text: str) -> set[int] | list[int]:
        """Words of a segment whose lengths fit, all of them or those that share a rest."""
        fit = [k for n in (len(text) - 1, len(text), len(text) + 1) for k in by_length.get(n, ())]
        if len(fit) <= COMPARED:
            return fit
        if (side, segment) not in self.rests:
            table: dict[str, list[int]] = {}
            for k in (k for words in by_length.values() for k in words):
                for rest in shortened(self.rest(self.words[k], len(segment), side)):
                    table.setdefault(rest, []).append(k)
            self.rests[side, segment] = table
        table = self.rests[side, segment]
        return {k for rest in shortened(self.rest(text, len(segment), side)) for k in table.get(rest, ())}

    @staticmethod
    def rest(word: str, length: int, side: int) -> str:
        return word[: len(word) - length] if side else word[length:]

    def scan(self, text: str, n: int, side: int) -> None:
        """Meet the shard's words with ``text``, whose end of that side brought it here."""
        last = len(text) - 1
        for end, (segment, *by_side) in self.automaton.iter(text):
            if (end != last) if side else (end != len(segment) - 1):
                continue  # the segment isn't at its place
            for k in self.candidates(segment, side, by_side[side], text) if by_side[side] else ():
                word = self.words[k]
                if side and text.startswith(word[: len(word) // 2]):
                    continue  # the first half shows this pair
                if one_edit(self.rest(word, len(segment), side), self.rest(text, len(segment), side)):
                    self.near[k] += 1
                    if (best := self.best[k]) is None or (-n, text) < best:
                        self.best[k] = (-n, text)


def _near(batches):
    """Per word of each shard the number of near words and the most frequent one.

    Rows ``(shard, scanned, side, word, n)`` come with a shard's own words first.
    """
    shard, at, words, sides = None, None, [], []

    def result(done: Shard):
        hit = np.flatnonzero(done.near)
        columns = [pa.array([done.words[k] for k in hit], pa.string()), pa.array(done.near[hit]), pa.array([-done.best[k][0] for k in hit], pa.int64()), pa.array([done.best[k][1] for k in hit], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        for number, scanned, side, word, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if number != at:
                if shard is not None:
                    yield result(shard)
                shard, at, words, sides = None, number, [], []
            if not scanned:
                words.append(word)
                sides.append(side)
                continue
            if shard is None:
                shard = Shard(words, sides)
            shard.scan(word, n, side)
    if shard is not None:
        yield result(shard)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n_near, best, best_n)`` for words of ``(word, n)`` that are one edit from another.

    ``best`` is the near word with the largest ``n``, the first in code-point order of those
    that tie.  Words are distinct, not null, and of ``2 * END`` characters at least.
    """
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, END).alias("end")), F.struct(F.lit(1).alias("side"), F.substring("word", -END, END).alias("end")))
    rows = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    shards = max(partitions(words.sparkSession), -(-2 * words.count() // shard_words))
    # Ends that fill more than a shard: so few that their number is below that of shards.
    full = rows.groupBy("side", "end").agg(F.count("*").alias("held")).where(F.col("held") > shard_words)
    full = full.select("side", "end", F.ceil(F.col("held") / shard_words).cast("int").alias("cuts"))
    rows = rows.join(full, ["side", "end"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))

    def number(cut: Column) -> Column:
        return F.pmod(F.xxhash64("side", "end", cut.cast("long")), F.lit(shards)).cast("int")

    own = rows.select(number(F.pmod(F.xxhash64("word"), F.col("cuts"))).alias("shard"), F.lit(False).alias("scanned"), "side", "word", "n")
    # A word is scanned once by each shard that may hold an end of its own.
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), number))
    met = rows.select(F.explode(every).alias("shard"), F.lit(True).alias("scanned"), "side", "word", "n")
    dealt = own.unionByName(met).repartition(shards, "shard").sortWithinPartitions("shard", "scanned")
    found = dealt.mapInArrow(tidy(_near), "word string, n_near long, best_n long, best string")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return merged.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` rows: the last word that forms lead to.

    Forms lead to more frequent words, so there is no circle; each round doubles the steps.
    """
    step = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = step.select(F.col("word").alias("root"), F.col("root").alias("then"))
        both = step.join(then, "root", "left")
        moved = saved(both.select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def spelling_variants(words: DataFrame, ratio: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per row of ``(word, n)``.

    A word's form is its near word of largest ``n`` (the first in code-point order of those
    that tie) if that is ``ratio`` times its own at least; its root is where forms end, the
    word itself without one.  Near words are one inserted, deleted or replaced code point
    apart.  No words give no rows.
    """
    words = saved(words.select("word", "n"), "words")
    near = near_words(words, shard_words)
    good = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    out = saved(out, "forms")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
