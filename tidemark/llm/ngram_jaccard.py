"""Exact n-gram Jaccard join with set-relation skipping, and its components.

The plan, in rows that move:

1.  Each text becomes the set of its hashed word shingles; equal sets share a signature
    and count as one set from there on.
2.  Shingles go to buckets as packed blocks ``fingerprint | local set number``; the
    bucket counts the sets of each shingle.  A shingle of one set can't meet anything
    and is left there; the others go back to their sets with the count.
3.  In a set, shingles are ordered by (count, hash), those of one set first.  Links need
    a common shingle among the first ``n - ceil(t n) + 1`` (prefix filter), so sets whose
    prefix has only shingles of their own leave the join.
4.  Index level: the list of a prefix shingle is kept in blocks of like size and position;
    a probing set skips whole blocks that the size or the position bound rules out.
5.  Answer level: each set first meets its likeliest *leader* only.  A set that is linked
    to its leader takes over the leader's answers: pairs within one component need no
    work, pairs of leaders are decided first, and a pair of members is only looked at
    where ``overlap(leaders) + what the members add`` can still reach the threshold.

No step emits the pairs within a group of copies, and no list, link table or component
is gathered on the driver.  Hashes have 64 bits (44 and more in the counting step).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fresh, partitions, saved, signed, tidy
from .components import components
from .shingles import shingle_sets, signature

#: Shingles that a bucket of the counting step gets on average, and that it counts at a time:
#: few large buckets keep the blocks' parts long however many blocks there are.
BUCKET_TOKENS, COUNT_TOKENS = 8_000_000, 1_000_000
#: Shingles that a task packs at a time.
BLOCK_TOKENS = 1_000_000
#: Shared shingles that an owner of sets gets on average.
OWNER_TOKENS = 2_000_000
LOCAL_BITS = 20
#: Pairs of candidates that a task remembers before it hands them on (some 100 bytes each).
FOUND = 200_000
#: Names of sets that a task remembers so as to send a repeated one once.
SEEN_SETS = 200_000
#: Distinct texts up to which their components (some 20 bytes each) are broadcast; beyond, they are joined.
BROADCAST_SETS = 250_000


def needed(n, percent: int):
    """Least overlap with any linked set for a set of size n: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(doc_id, sig, n)`` per row; sig is null for an empty set."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            sigs = np.array([signature(s) for s in sets], np.uint64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(sigs), mask=sizes == 0), pa.array(sizes)], names=["doc_id", "sig", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {kind}, sig long, n long")


def _planes(a: np.ndarray) -> bytes:
    """Sorted words, byte plane by byte plane, so that the shuffle's codec shrinks them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _token_blocks(docs: DataFrame, text_col: str, width: int, bits: int) -> DataFrame:
    """Blocks ``(bucket, packed, sigs, sizes)`` of 2**bits buckets."""

    def flush(sets, sigs):
        local = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        bucket = (tokens >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        packed = (tokens << U64(bits)) & ~U64((1 << LOCAL_BITS) - 1) | local
        sizes = np.array([len(s) for s in sets], np.int64)
        names = np.array(sigs, np.uint64)
        order = np.argsort(bucket, kind="stable")
        packed, bucket = packed[order], bucket[order]
        head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rows, low = [], U64((1 << LOCAL_BITS) - 1)
        fresh_number = np.zeros(len(names), np.uint64)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(bucket)], strict=True):
            part = np.sort(packed[a:b])
            used = np.unique(part & low).astype(np.int64)
            fresh_number[used] = np.arange(len(used), dtype=np.uint64)
            part = part & ~low | fresh_number[(part & low).astype(np.int64)]
            rows.append((int(bucket[a]), _planes(part), names[used].tobytes(), sizes[used].astype(np.int32).tobytes()))
            if len(rows) >= 16:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "packed", "sigs", "sizes"])

    def run(batches):
        seen: set[int] = set()
        sets, sigs, held = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if len(s) and (name := signature(s)) not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(name)
                    sets.append(s)
                    sigs.append(name)
                    held += len(s)
                    if held >= BLOCK_TOKENS or len(sets) >= 1 << LOCAL_BITS:
                        yield from flush(sets, sigs)
                        sets, sigs, held = [], [], 0
        if sets:
            yield from flush(sets, sigs)

    return docs.select(text_col).mapInArrow(tidy(run), "bucket long, packed binary, sigs binary, sizes binary")


def _by_key(batches, key: str):
    """Runs of equal ``key`` in sorted batches: (key, list of row dicts)."""
    name, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != name:
                yield name, rows
                rows = []
            name = row[key]
            rows.append(row)
    if rows:
        yield name, rows


def _shared_tokens(blocks: DataFrame, owners: int) -> DataFrame:
    """From token buckets back to set owners: shingles that two or more sets have."""

    def counted(bucket, rows):
        """``(names, sizes, member, order)`` of the bucket, range by range of its shingles."""
        low = U64((1 << LOCAL_BITS) - 1)
        parts = [_unplanes(r["packed"]) for r in rows]
        sigs = [np.frombuffer(r["sigs"], np.uint64) for r in rows]
        names, where, inverse = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows])[where]
        inverse = inverse.astype(np.uint64)
        base = np.cumsum([0, *map(len, sigs)])
        bits = max(LOCAL_BITS, int(len(names)).bit_length())
        del sigs, where
        cuts = max(0, math.ceil(math.log2(max(1, sum(map(len, parts)) / COUNT_TOKENS))))
        starts = np.arange(1, 1 << cuts, dtype=np.uint64) << U64(64 - cuts) if cuts else np.zeros(0, np.uint64)
        bounds = [np.concatenate([[0], np.searchsorted(p, starts), [len(p)]]) for p in parts]
        for k in range(1 << cuts):
            some = [(p[at[k] : at[k + 1]], b) for p, at, b in zip(parts, bounds, base.tolist(), strict=False)]
            keys = np.unique(np.concatenate([(p >> U64(bits) << U64(bits)) | inverse[(p & low).astype(np.int64) + b] for p, b in some]))
            if not len(keys):
                continue
            prints = keys >> U64(bits)
            head = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            counts = np.diff(np.append(head, len(keys)))
            often = np.repeat(counts, counts)
            keep = often >= 2
            prints, often, member = prints[keep], often[keep], (keys[keep] & U64((1 << bits) - 1)).astype(np.int64)
            ident = prints * U64(0x9E3779B97F4A7C15) + U64(bucket * 0xC2B2AE3D27D4EB4F % 2**64)
            ident ^= ident >> U64(31)
            order = np.minimum(often, 65535).astype(np.uint64) << U64(48) | (ident * U64(0xFF51AFD7ED558CCD)) >> U64(16)
            yield names, sizes, member, order

    def run(batches):
        for bucket, rows in _by_key(batches, "bucket"):
            for names, sizes, member, order in counted(bucket, rows):
                owner = (names[member] % U64(owners)).astype(np.int64)
                by = np.lexsort((member, owner))
                owner, member, order = owner[by], member[by], order[by]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
                out = []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=False):
                    m, o = member[a:b], order[a:b]
                    head = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    out.append((int(owner[a]), names[m[head]].tobytes(), sizes[m[head]].tobytes(), np.diff(np.append(head, len(m))).astype(np.int32).tobytes(), o.tobytes()))
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["owner", "sigs", "sizes", "runs", "tokens"])

    return blocks.repartition(partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "owner long, sigs binary, sizes binary, runs binary, tokens binary")


def _joining_sets(shared: DataFrame, percent: int) -> DataFrame:
    """``(sig, n, alone, tokens)`` of the sets whose prefix reaches a shared shingle."""

    def run(batches):
        for _, rows in _by_key(batches, "owner"):
            sigs = np.concatenate([np.frombuffer(r["sigs"], np.uint64) for r in rows])
            sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows]).astype(np.int64)
            runs = np.concatenate([np.frombuffer(r["runs"], np.int32) for r in rows])
            tokens = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in rows])
            names, where, inverse = np.unique(sigs, return_index=True, return_inverse=True)
            member = np.repeat(inverse, runs)
            by = np.lexsort((tokens, member))
            tokens = tokens[by]
            bounds = np.searchsorted(member[by], np.arange(len(names) + 1))
            n = sizes[where]
            alone = n - np.diff(bounds)
            take = np.flatnonzero(alone < n - needed(n, percent) + 1)
            for i in range(0, len(take), 500):
                t = take[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[t])), pa.array(n[t]), pa.array(alone[t]), pa.array([tokens[bounds[k] : bounds[k + 1]].tobytes() for k in t.tolist()], pa.binary())], names=["sig", "n", "alone", "tokens"])

    return shared.repartition(partitions(shared.sparkSession), "owner").sortWithinPartitions("owner").mapInArrow(tidy(run), "sig long, n long, alone long, tokens binary")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """``(token, sig, n, pos, alone)`` of the shared prefix shingles."""

    def run(batches):
        for batch in batches:
            sig, n, alone = (batch.column(i).to_numpy() for i in range(3))
            prefix = n - needed(n, percent) + 1 - alone
            for i in range(0, len(sig), 200):
                parts = [np.frombuffer(batch.column(3)[k].as_py(), np.int64)[: prefix[k]] for k in range(i, min(i + 200, len(sig)))]
                size = np.array([len(p) for p in parts])
                row = np.repeat(np.arange(i, i + len(parts)), size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(sig[row]), pa.array(n[row]), pa.array((alone[row] + place).astype(np.int32)), pa.array(alone[row].astype(np.int32))], names=["token", "sig", "n", "pos", "alone"])

    return sets.mapInArrow(tidy(run), "token long, sig long, n long, pos int, alone int")


def _lists(frames):
    """Whole posting lists from batches sorted by token, one batch in hand."""
    rest = None
    for pdf in frames:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        token = pdf["token"].to_numpy()
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _reach(n, i, m, j, percent: int):
    """Whether sets of sizes n, m that first meet at positions i, j can still be linked."""
    most = 1 + np.minimum(n - i - 1, m - j - 1)
    return (100 + percent) * most >= percent * (n + m)


def _leader_candidates(postings: DataFrame, percent: int) -> DataFrame:
    """``(sig, leader)``: each set and the leader that most of its lists name.

    A list's leader is its most central set, the one with the least share of shingles of
    its own: edits give copies such shingles and leave their original without.  Rows are
    as many as postings at most.
    """

    def run(frames):
        lead = None  # token, sig, n, pos of the list in hand
        for pdf in frames:
            token, sig, n, pos = (pdf[c].to_numpy() for c in ("token", "sig", "n", "pos"))
            if not len(token):
                continue
            head = np.concatenate([[lead is None or token[0] != lead[0]], token[1:] != token[:-1]])
            first = np.maximum.accumulate(np.where(head, np.arange(len(token)), -1))
            top, top_n, top_pos = (np.where(first >= 0, v[first], 0 if lead is None else lead[k]) for k, v in ((1, sig), (2, n), (3, pos)))
            lead = (token[-1], top[-1], top_n[-1], top_pos[-1])
            ok = (sig != top) & _reach(n, pos, top_n, top_pos, percent)
            if ok.any():
                out = pd.DataFrame({"sig": sig[ok], "leader": top[ok]})
                yield out.groupby(["sig", "leader"], sort=False).size().rename("votes").reset_index()

    votes = _by_token(postings, F.col("alone") / F.col("n"), "sig").mapInPandas(tidy(run), "sig long, leader long, votes long").groupBy("sig", "leader").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("sig").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))


def _by_token(postings: DataFrame, *then) -> DataFrame:
    return postings.repartition(partitions(postings.sparkSession), "token").sortWithinPartitions("token", *then)


def _overlaps(pairs: DataFrame, sets: DataFrame, *keep: str) -> DataFrame:
    """``(a, b, common, na, nb, *keep)`` for pairs of signatures."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(batch.schema.get_field_index("ta")), batch.column(batch.schema.get_field_index("tb"))
            common = np.zeros(batch.num_rows, np.int64)
            last, left = None, None
            for i in range(batch.num_rows):
                y = b[i].as_buffer()
                if last is None or y != last:
                    last, left = y, np.frombuffer(y, np.int64)
                x = np.frombuffer(a[i].as_buffer(), np.int64)
                both = np.sort(np.concatenate([x, left]))
                common[i] = np.count_nonzero(both[1:] == both[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "nb", *keep)), pa.array(common)], names=["a", "b", "na", "nb", *keep, "common"])

    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b")
    extra = "".join(f", {c} {dict(pairs.dtypes)[c]}" for c in keep)
    return joined.mapInArrow(tidy(run), f"a long, b long, na long, nb long{extra}, common long")


def _cross_candidates(postings: DataFrame, percent: int, leaders: bool, open_pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of sets in one list whose components differ, by blocks of size and position.

    ``postings`` carry (root, leader, gain): the component, the leader and how many
    shingles the set has that its leader lacks.  With ``leaders`` the pairs of leaders
    are returned, else the pairs of sets.  ``slack`` is the largest
    ``(100 + percent) (gains) - percent (sizes)`` of the sets met: the overlap of their
    leaders, ``100 + percent`` times, must make up for it.

    For pairs of leaders a list has one row for each leader, with the widest bounds of its
    members (``n`` the least size, ``hi`` the largest, ``n - pos`` the most that can follow),
    so the list of a passage that thousands of near copies share is as long as they have
    leaders, summed up before it moves.
    """

    def blocked(rows):
        """The list's rows by like size and position, and the block bounds."""
        step = np.floor(np.log(rows["n"]) / math.log(1.05)).astype(np.int64)
        band = np.floor(16 * rows["pos"] / rows["n"]).astype(np.int64)
        by = np.lexsort((rows["n"], band, step))
        step, band = step[by], band[by]
        cut = np.flatnonzero((step[1:] != step[:-1]) | (band[1:] != band[:-1])) + 1
        return {c: v[by] for c, v in rows.items()}, np.concatenate([[0], cut, [len(by)]])

    if leaders:
        worth = (100 + percent) * F.col("gain") - percent * F.col("n")
        postings = postings.groupBy("token", "leader").agg(F.min("root").alias("root"), F.min("n").alias("n"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("room"), F.max(worth).alias("worth"))
        postings = postings.select("token", "root", "leader", "n", "hi", (F.col("n") - F.col("room")).alias("pos"), "worth")
    else:
        postings = postings.select("token", "sig", "root", "n", F.col("n").alias("hi"), "pos")

    def meet(rows, at):
        """Index pairs within one list that pass the bounds and join two components."""
        n, pos, root = rows["n"], rows["pos"], rows["root"]
        if len(n) <= 64:
            i, j = np.tril_indices(len(n), -1)
            ok = (root[i] != root[j]) & _reach(n[i], pos[i], n[j], pos[j], percent)
            for k in np.flatnonzero(ok).tolist():
                yield i[k], j[k : k + 1]
            return
        lo_n, hi_n = np.minimum.reduceat(n, at[:-1]), np.maximum.reduceat(rows["hi"], at[:-1])
        room = np.maximum.reduceat(n - pos, at[:-1])
        lo_r, hi_r = np.minimum.reduceat(root, at[:-1]), np.maximum.reduceat(root, at[:-1])
        for x in range(len(at) - 1):
            skip = (100 * hi_n[x] < percent * lo_n) | (100 * hi_n < percent * lo_n[x])
            skip |= (100 + percent) * np.minimum(room[x], room) < percent * (lo_n[x] + lo_n)
            skip |= (lo_r[x] == hi_r[x]) & (lo_r == lo_r[x]) & (hi_r == lo_r[x])
            for y in np.flatnonzero(~skip[: x + 1]).tolist():
                one = np.arange(at[y], at[y + 1])
                for i in range(at[x], at[x + 1]):
                    other = one if y < x else one[one < i]
                    other = other[root[other] != root[i]]
                    other = other[_reach(n[i], pos[i], n[other], pos[other], percent)]
                    if len(other):
                        yield i, other

    def run(frames):
        for pdf in _lists(frames):
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            token = cols["token"]
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            found: dict[tuple[int, int], int] = {}
            for a, b in zip(head.tolist(), np.append(head[1:], len(token)).tolist(), strict=True):
                if b - a < 2 or (cols["root"][a:b] == cols["root"][a]).all():
                    continue
                rows, at = blocked({c: v[a:b] for c, v in cols.items()})
                for i, other in meet(rows, at):
                    if leaders:
                        p, q = rows["leader"][i], rows["leader"][other]
                        slack = rows["worth"][i] + rows["worth"][other]
                        for k, v in zip(q.tolist(), slack.tolist(), strict=True):
                            key = (min(p, k), max(p, k))
                            found[key] = max(found.get(key, v), v)
                    else:
                        for v in other.tolist():
                            s, t = rows["sig"][i], rows["sig"][v]
                            found[(min(s, t), max(s, t))] = 0
                    if len(found) > FOUND:  # within a list too: one of m rows may have m^2 / 2 pairs
                        yield frame(found)
                        found = {}
            if found:
                yield frame(found)

    def frame(found):
        keys = np.array(list(found), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": keys[:, 0], "b": keys[:, 1], "slack": np.array(list(found.values()), np.int64)})

    pairs = _by_token(postings).mapInPandas(tidy(run), "a long, b long, slack long")
    return pairs.groupBy("a", "b").agg(F.max("slack").alias("slack"))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("sig"), F.col("root"))
    return rows.join(known, "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, sig, n)`` of all rows and links ``(a, b, common, na, nb)`` of sets.

    Sets are linked when ``100 |A and B| >= percent |A or B|``.  The links join exactly the
    components of the full link graph: pairs within a known component aren't looked at.
    With ``full`` they are all links between distinct sets, as many as there are.
    """
    spark = docs.sparkSession
    members = saved(signatures(docs, id_col, text_col, width), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_TOKENS))), min(6, partitions(spark).bit_length()))
    owners = max(partitions(spark) * 2, total // OWNER_TOKENS)
    sets = saved(_joining_sets(_shared_tokens(_token_blocks(docs, text_col, width, bits), owners), percent), "sets")
    if not sets.take(1):
        return members, spark.createDataFrame([], "a long, b long, na long, nb long, common long")
    postings = saved(_postings(sets, percent), "postings")
    is_link = linked(F.col("common"), F.col("na"), F.col("nb"), percent)

    if full:
        rows = postings.select("token", "sig", "n", "pos", F.col("sig").alias("root"), F.col("sig").alias("leader"), F.lit(0).cast("long").alias("gain"))
        pairs = _cross_candidates(rows, percent, leaders=False).select("a", "b")
        return members, saved(_overlaps(pairs, sets).where(is_link).select("a", "b", "common", "na", "nb"), "links")

    star = _overlaps(_leader_candidates(postings, percent).select(F.col("sig").alias("a"), F.col("leader").alias("b")), sets)
    star = saved(star.where(is_link), "star")
    roots = components(star)

    led = star.select(F.col("a").alias("sig"), F.col("b").alias("leader"), (F.col("na") - F.col("common")).alias("gain"))

    def annotated(rows: DataFrame, roots: DataFrame) -> DataFrame:
        rows = _with_roots(rows, roots).join(led, "sig", "left")
        return rows.select("token", "sig", "n", "pos", "root", F.coalesce("leader", "sig").alias("leader"), F.coalesce("gain", F.lit(0)).alias("gain"))

    mixed = postings.join(_open_tokens(postings, roots), "token", "left_semi")
    pairs = saved(_cross_candidates(annotated(mixed, roots), percent, leaders=True).where("a <> b"), "leaders")
    met = saved(_overlaps(pairs, sets, "slack"), "met")
    lead_links = met.where(is_link).select("a", "b", "na", "nb", "common")
    links = star.select("a", "b", "na", "nb", "common").unionByName(lead_links)

    # What is left: leaders that aren't linked where the gains of members, or their smaller
    # sizes (a truncated copy has no gain), leave room for a link.
    unsettled = met.where(~is_link & (F.col("common") * (100 + percent) + F.col("slack") >= 0)).select("a", "b", F.col("common").alias("top"))
    if unsettled.take(1):
        roots = components(links)
        rows = annotated(mixed, roots)
        rows = rows.join(unsettled.select(F.col("a").alias("leader")).union(unsettled.select("b")).distinct(), "leader", "left_semi").select("token", "sig", "n", "pos", "root", "leader", "gain")
        last = _cross_candidates(rows, percent, leaders=False).select("a", "b")
        info = led.select("sig", "leader", "gain")
        for side in ("a", "b"):
            last = last.join(info.select(F.col("sig").alias(side), F.col("leader").alias(f"l{side}"), F.col("gain").alias(f"g{side}")), side, "left")
            last = last.withColumn(f"l{side}", F.coalesce(f"l{side}", side)).withColumn(f"g{side}", F.coalesce(f"g{side}", F.lit(0)))
        last = last.withColumn("p", F.least("la", "lb")).withColumn("q", F.greatest("la", "lb"))
        last = last.join(unsettled.select(F.col("a").alias("p"), F.col("b").alias("q"), "top"), ["p", "q"])
        sized = sets.select("sig", "n")
        for side in ("a", "b"):
            last = last.join(sized.select(F.col("sig").alias(side), F.col("n").alias(f"s{side}")), side)
        last = last.where((F.col("top") + F.col("ga") + F.col("gb")) * (100 + percent) >= percent * (F.col("sa") + F.col("sb")))
        more = saved(_overlaps(saved(last.select("a", "b"), "last"), sets).where(is_link), "more")
        links = links.unionByName(more)
    return members, links


def _open_tokens(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Tokens whose lists hold two components or more."""
    return _with_roots(postings.select("token", "sig"), roots).groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    component_id is the least id that links reach.  A null or blank text has the empty set
    and stays alone, as its own component; rows with equal texts share theirs; a null id
    takes the least id of its component, or null.  Columns other than the two named are
    ignored; an empty table gives no rows.
    """
    members, links = jaccard_links(docs, id_col, text_col, width, percent)
    texts = members.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    texts = _with_roots(texts, components(links))
    groups = texts.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1")
    shared = _shared(texts.select("sig", "root").join(groups, "root").select("sig", "component_id"))
    out = members.join(shared, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _shared(by_sig: DataFrame) -> DataFrame:
    """What texts of more than one row say, as a table of its own: broadcast where it is
    small, and else joined so that the rows of a hot text are split."""
    by_sig = saved(by_sig, "shared")
    return F.broadcast(by_sig) if by_sig.count() <= BROADCAST_SETS else by_sig


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_links)``, one row per row of ``docs``: how many other rows it is linked to.

    Rows with equal sets are linked to each other; empty sets have no links.
    """
    members, links = jaccard_links(docs, id_col, text_col, width, percent, full=True)
    rows = members.where("sig is not null").groupBy("sig").agg(F.count("*").alias("rows"))
    both = links.select("a", "b").union(links.select("b", "a"))
    others = both.join(rows.select(F.col("sig").alias("b"), "rows"), "b").groupBy(F.col("a").alias("sig")).agg(F.sum("rows").alias("others"))
    counts = rows.join(others, "sig", "left").select("sig", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "sig", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with the least id.

    Rows are told apart by id and text, so rows that share an id but not their text are
    decided on one by one.  Null ids come last, ties go to the least hash of the text, and of
    rows with equal ids and texts one stays, whichever it is.  Rows with an empty set all stay.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    members, links = jaccard_links(docs.select(key.alias("row"), F.col(text_col).alias("text")), "row", "text", width, percent)
    members = members.where("sig is not null").select("sig", F.struct(F.col("doc_id.id").isNull().alias("last"), "doc_id.id", "doc_id.h").alias("row"))
    texts = members.groupBy("sig").agg(F.min("row").alias("row"), F.count("*").alias("rows"))
    texts = _with_roots(texts, components(links))
    kept = texts.groupBy("root").agg(F.min("row").alias("kept"), F.sum("rows").alias("rows")).where("rows > 1")
    kept = _shared(texts.select("sig", "root").join(kept, "root").select("sig", "kept"))
    name, h, row = (fresh(c, docs.columns) for c in ("__id", "__h", "__row"))
    gone = members.join(kept, "sig").where("row <> kept").select(F.col("row.id").alias(name), F.col("row.h").alias(h)).distinct()
    same = F.col(name).eqNullSafe(docs[id_col]) & (F.col(h) == F.xxhash64(docs[text_col]))
    out = docs.join(gone, same, "left_anti")
    again = members.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row.id").alias(name), F.col("row.h").alias(h))
    if again.isEmpty():
        return out
    twice = out.join(again, same, "left_semi").groupBy(F.col(id_col).alias(name), F.xxhash64(text_col).alias(h)).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias(row))
    return out.join(again, same, "left_anti").unionByName(twice.select(f"{row}.*"))
