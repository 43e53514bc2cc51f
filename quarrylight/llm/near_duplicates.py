"""Near-duplicate texts by deletion-variant signatures.

A text's signature is a row of positions, each the smallest of its word-sequence hashes under one hash function. It is
cut into so few segments that two similar texts agree in one segment at all but at most one position. Each segment is
indexed once per position with that position left open; texts that share such a variant are candidates, and an exact
comparison of their sets decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import WordHash, grams, spread, word_hashes
from quarrylight.operators.skew import split_join
from quarrylight.scratch import write_out

#: Positions of a segment, and how many similar pairs right at the threshold may be missed.
WIDTH, MISS = 5, 0.001
#: A variant shared by more texts than this is no candidate yet: its texts are indexed again with longer segments.
RUN = 64
#: Positions of a segment at each turn. What still shares all but one of the last ones is compared pair by pair, in blocks.
WIDTHS = (WIDTH, 8, 12)
#: Variants are sorted in parts of about so many (some 100 MB), however many there are.
PART = 8_000_000
#: Copies of one text, letter by letter, are listed in all pairs up to this number; more of them by their first one.
LISTED = 32
_GRAM_BYTES = 5
#: A sketch has so many positions of four bits; pairs whose sketches are SIGMAS deviations below the threshold are not compared.
_SKETCH, SIGMAS = 64, 4.5


def segments(threshold: float, width: int = WIDTH, miss: float = MISS) -> int:
    """Segments needed so that of pairs at ``threshold`` at most ``miss`` share no variant."""
    hit = threshold**width + width * (1 - threshold) * threshold ** (width - 1)
    return 1 if hit >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - hit)))


class _MinHash:
    """The smallest hash of a set under each of ``n`` hash functions."""

    def __init__(self, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, n, dtype=np.uint64)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        sig = np.full(len(self.mul), 2**64 - 1, np.uint64)
        for lo in range(0, len(g), 512):
            h = g[lo : lo + 512, None] * self.mul + self.add
            h ^= h >> np.uint64(32)
            sig = np.minimum(sig, (h * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
        return sig


def _sets(words: int, least: int):
    def run(batches):
        known, minhash = WordHash(), _MinHash(_SKETCH, 1)
        shifts = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]
        for b in batches:
            keep, fps, texts, sets, sketches = [], [], [], [], []
            for i, (space, text) in enumerate(zip(b.column("space").to_pylist(), b.column("text").to_pylist(), strict=True)):
                hashes = word_hashes(text, known)
                if len(hashes) < max(least, words):
                    continue
                g = grams(hashes, words) >> np.uint64(64 - 8 * _GRAM_BYTES)
                g = np.unique(g)
                raw = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :_GRAM_BYTES]).tobytes()
                keep.append(i)
                fps.append(xxhash.xxh3_128_digest(raw, xxhash.xxh3_64_intdigest(space or "")))
                texts.append(xxhash.xxh3_64_intdigest(text) - 2**63)
                sets.append(raw)
                with np.errstate(over="ignore"):
                    nibble = (minhash(g) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).reshape(4, 16)
                sketches.append((nibble << shifts).sum(axis=1, dtype=np.uint64).view(np.int64))
            four = np.array(sketches, np.int64).reshape(-1, 4)
            t = b.select(["space", "id"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(fps, pa.binary()), pa.array(texts, pa.int64()), pa.array(sets, pa.binary()), *[pa.array(four[:, k]) for k in range(4)]], ["space", "id", "fp", "txt", "grams", "s0", "s1", "s2", "s3"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _GRAM_BYTES, 8), np.uint8)
    out[:, :_GRAM_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _GRAM_BYTES)
    return out.view(np.uint64).ravel()


def _variants(n_segments: int, width: int):
    def run(batches):
        rng = np.random.default_rng(20240229 + width)
        minhash = _MinHash(n_segments * width, 1 + width)
        tag = rng.integers(1, 2**63, (n_segments, width), dtype=np.uint64)
        spot = rng.integers(1, 2**63, (n_segments, width), dtype=np.uint64) | np.uint64(1)
        shift = np.uint64(32)
        with np.errstate(over="ignore"):
            for b in batches:
                out = np.empty((b.num_rows, n_segments * width), np.uint64)
                spaces = np.fromiter((xxhash.xxh3_64_intdigest(s or "") for s in b.column("space").to_pylist()), np.uint64, b.num_rows)
                for i, raw in enumerate(b.column("grams").to_pylist()):
                    part = minhash(_unpack(raw)).reshape(n_segments, width) * spot
                    part ^= part >> shift
                    part *= np.uint64(0xA0761D6478BD642F)
                    # a segment's sum without one position stands for the variant in which that position is open
                    v = part.sum(axis=1, dtype=np.uint64)[:, None] - part + tag
                    v ^= v >> shift
                    out[i] = (v * np.uint64(0xE7037ED1A0B428DB)).ravel() ^ spaces[i]
                offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (n_segments * width)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("ref"), keys], ["ref", "keys"])

    return run


def _pairs_of_runs(most: int):
    """Of rows sorted by key: all pairs of refs that share a key; runs of more than ``most`` come out as single rows (key, ref)."""

    def pairs(key: np.ndarray, ref: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[start, len(key)])
        many = length > most
        long_rows = np.repeat(many, length)
        hot_key, hot_ref = key[long_rows], ref[long_rows]
        key, ref = key[~long_rows], ref[~long_rows]
        a, b, d = [], [], 1
        while d < most and len(key) > d:
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            a.append(ref[same])
            b.append(ref[same + d])
            d += 1
        left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        differ = left != right
        left, right = left[differ], right[differ]
        u = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.empty((0, 2), np.int64)
        n, m = len(u), len(hot_key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(n, np.int64), hot_key], mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]),
                pa.array(np.r_[u[:, 0], hot_ref]),
                pa.array(np.r_[u[:, 1], np.zeros(m, np.int64)], mask=np.r_[np.zeros(n, bool), np.ones(m, bool)]),
            ],
            ["hot", "a", "b"],
        )

    def run(batches):
        held_key, held_ref = np.empty(0, np.int64), np.empty(0, np.int64)
        passing = None  # a run already known to be long is passed on, not held
        for batch in batches:
            key, ref = (np.asarray(batch.column(k)) for k in ("key", "ref"))
            if passing is not None:
                n = int(np.searchsorted(key, passing, "right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(key[:n]), pa.array(ref[:n]), pa.nulls(n, pa.int64())], ["hot", "a", "b"])
                key, ref = key[n:], ref[n:]
                if not len(key):
                    continue
                passing = None
            key, ref = np.r_[held_key, key], np.r_[held_ref, ref]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - last > most:
                passing = key[-1]
                yield pairs(key, ref)
                held_key, held_ref = key[:0], ref[:0]
            else:
                if last:
                    yield pairs(key[:last], ref[:last])
                held_key, held_ref = key[last:], ref[last:]
        if len(held_key):
            yield pairs(held_key, held_ref)

    return run


def _similar(threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                m, n = len(x) // _GRAM_BYTES, len(y) // _GRAM_BYTES
                if min(m, n) < threshold * max(m, n):
                    continue
                both = np.concatenate([_unpack(x), _unpack(y)])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common >= threshold * (m + n - common) - 1e-9:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _blocked(hot: DataFrame, size: int) -> DataFrame:
    """All pairs of the members (``a``) of each run (``hot``), in blocks: block i meets block j in a task of its own."""
    counts = hot.groupBy("hot").agg(F.count(F.lit(1)).alias("n"))
    rows = split_join(hot, counts, "hot", "inner").withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = rows.select("hot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("a").alias("x"))
    right = left.withColumnRenamed("x", "y")
    return left.join(right, ["hot", "i", "j"]).where(F.col("x") < F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _met(sets: DataFrame, threshold: float, width: int, miss: float) -> DataFrame:
    """Pairs (a, b) of refs that share a variant of segments of ``width``; of long runs single rows (hot, a)."""
    n = segments(threshold, width, miss)
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() * n * width // PART))
    keys = sets.mapInArrow(_variants(n, width), "ref bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "ref")
    return write_out(keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_pairs_of_runs(RUN), "hot bigint, a bigint, b bigint"))


def text_sets(df: DataFrame, space: Column, id_col: Column, text: Column, words: int = 5, least: int = 5) -> DataFrame:
    """Distinct word sequences of each text of ``least`` words or more, written: ref (own number), space, id, fp (of the set), txt (of the text), grams, sketch.

    Null texts and ids are left out; further columns of ``df`` are ignored.
    """
    rows = df.select(space.cast("string").alias("space"), id_col.cast("string").alias("id"), text.alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    sets = spread(rows).mapInArrow(_sets(words, least), "space string, id string, fp binary, txt bigint, grams binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    return write_out(sets.withColumn("ref", F.monotonically_increasing_id()))


def classes(sets: DataFrame) -> DataFrame:
    """Texts with equal sets in one space (``fp`` stands for both) form a class, stood for by the one with the smallest ref: fp, ref, n."""
    return sets.groupBy("fp").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("n"))


def _plausible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sketches agree in about as many positions as sets at ``threshold`` do, or more."""
    agree = threshold + (1 - threshold) / 16
    least = math.floor(_SKETCH * (agree - SIGMAS * math.sqrt(agree * (1 - agree) / _SKETCH)))
    names = ["s0", "s1", "s2", "s3"]
    left = sets.select(F.col("ref").alias("a"), *[F.col(c).alias(f"x{c}") for c in names])
    right = sets.select(F.col("ref").alias("b"), *[F.col(c).alias(f"y{c}") for c in names])
    differ = F.lit(0)
    for c in names:
        x = F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    return split_join(split_join(pairs, left, "a", "inner"), right, "b", "inner").where(differ <= _SKETCH - least).select("a", "b")


def similar_classes(sets: DataFrame, reps: DataFrame, threshold: float = 0.8, widths: tuple[int, ...] = WIDTHS, miss: float = MISS) -> DataFrame:
    """Pairs (a < b, refs of class representatives) whose sets have at least ``threshold`` of their union in common.

    Texts of a variant that more than RUN texts share (a template, say) are indexed again with segments of the next width,
    which unlike texts seldom share; so a run of n texts costs some rows a text, not n * n pairs. Only texts that share all
    but one of the last width's positions, nearly all of which are similar, are then compared within their run, in blocks.
    """
    copies = write_out(split_join(sets.select("fp", "ref"), reps.where(F.col("n") > 1).select("fp", F.col("ref").alias("lead")), "fp", "inner").where(F.col("ref") != F.col("lead")).select("ref"))
    first = sets.select("ref", "space", "grams").join(copies, "ref", "left_anti")
    pairs = None
    for turn, width in enumerate(widths):
        met = _met(first, threshold, width, miss)
        found = met.where(F.col("hot").isNull()).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        hot = met.where(F.col("hot").isNotNull()).select("hot", "a").distinct()
        if not hot.limit(1).count():
            break
        if turn == len(widths) - 1:
            pairs = pairs.unionByName(_blocked(write_out(hot), RUN))
        else:
            again = write_out(hot.select(F.col("a").alias("ref")).distinct())  # written, so that the planner knows how small it is
            first = write_out(first.join(again, "ref", "left_semi"))
    near = write_out(_plausible(write_out(pairs.distinct()), sets, threshold))
    ends = near.select("a", "b", F.explode(F.array("a", "b")).alias("ref"))
    wanted = sets.select("ref", "grams").join(write_out(ends.select("ref").distinct()), "ref", "left_semi")
    with_sets = split_join(ends, wanted, "ref", "inner")
    both = with_sets.groupBy("a", "b").agg(F.max(F.when(F.col("ref") == F.col("a"), F.col("grams"))).alias("x"), F.max(F.when(F.col("ref") == F.col("b"), F.col("grams"))).alias("y"))
    return both.mapInArrow(_similar(threshold), "a bigint, b bigint")


def near_duplicate_pairs(df: DataFrame, space: Column, id_col: Column, text: Column, words: int = 5, threshold: float = 0.8, least: int = 5, listed: int = LISTED) -> DataFrame:
    """Pairs of ids (id_a < id_b) of one space whose texts are at least ``threshold`` alike: space, id_a, id_b.

    Texts with equal sets are compared once, through their class, and expanded into all pairs of its members. Of more than
    ``listed`` copies of one text, letter by letter, each is paired with the first and the first alone with other texts, so
    no link between different texts is lost and a text of a third of all rows stays linear. Texts of
    fewer than ``least`` words and nulls give no pair; repeated ids give none with themselves.
    """
    sets = text_sets(df, space, id_col, text, words, least)
    reps = write_out(classes(sets))
    links = write_out(similar_classes(sets, reps, threshold))
    lead = reps.where(F.col("n") > 1).select("fp", "ref")
    several = write_out(split_join(sets.select("space", "fp", "id", "txt", F.col("ref").alias("own")), lead, "fp", "inner").select("space", "id", "txt", "own", "ref"))
    many = several.groupBy("ref", "txt").agg(F.count(F.lit(1)).alias("copies"), F.min("own").alias("head")).where(F.col("copies") > listed)
    several = write_out(split_join(several.withColumn("copy", F.struct("ref", "txt")), many.select(F.struct("ref", "txt").alias("copy"), "head"), "copy").drop("copy"))
    short = several.where("head IS NULL OR own = head")
    name = short.select("own", "space", "id")
    inner = _blocked(short.select(F.col("ref").alias("hot"), F.col("own").alias("a")), RUN)
    inner = inner.join(name.select(F.col("own").alias("a"), "space", F.col("id").alias("p")), "a").join(name.select(F.col("own").alias("b"), F.col("id").alias("q")), "b").select("space", "p", "q")
    heads = several.where("own = head").select("head", F.col("id").alias("lead"))
    star = split_join(several.where("own <> head").select("space", "id", "head"), heads, "head", "inner").select("space", F.col("id").alias("p"), F.col("lead").alias("q"))
    linked = write_out(links.select(F.explode(F.array("a", "b")).alias("ref")).distinct())
    named = sets.select("ref", "space", "id").join(linked, "ref", "left_semi")
    more = short.where(F.col("own") != F.col("ref")).select("ref", "space", "id")
    names = write_out(named.unionByName(more.join(linked, "ref", "left_semi")))
    across = (
        links.join(names.select(F.col("ref").alias("a"), "space", F.col("id").alias("p")), "a")
        .join(names.select(F.col("ref").alias("b"), F.col("id").alias("q")), "b").select("space", "p", "q")
    )
    pairs = inner.unionByName(star).unionByName(across).where(F.col("p") != F.col("q"))
    return pairs.select("space", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, space: Column, id_col: Column, text: Column, words: int = 5, threshold: float = 0.8, least: int = 5) -> DataFrame:
    """One row per text of ``least`` words or more: space, id, class_id (of all texts that links connect), n_links.

    ``n_links`` counts the other texts that are similar, copies included. Groups grow along links, so two of a group need not
    be similar themselves. Of an id that repeats each row comes out.
    """
    sets = text_sets(df, space, id_col, text, words, least)
    reps = write_out(classes(sets))
    links = write_out(similar_classes(sets, reps, threshold))
    label = connected(reps.select("ref"), links)
    sizes = reps.select("ref", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes.select(F.col("ref").alias("b"), "n"), "b").groupBy(F.col("a").alias("ref")).agg(F.sum("n").alias("others"))
    of_class = reps.join(label, "ref").join(linked, "ref", "left").select("fp", "label", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return split_join(sets.select("space", "fp", "id"), write_out(of_class), "fp", "inner").select("space", "id", F.col("label").alias("class_id"), "n_links")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """ref and label, the smallest ref that links (a, b) connect it with, by large-star and small-star steps until nothing moves.

    Each step rewires links towards smaller refs; a hub's links are combined before the shuffle, and no component is gathered.
    """
    edges = write_out(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = write_out(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        met = down.join(low, "a")
        small = met.where(F.col("b") != F.col("low")).select(F.col("low").alias("a"), "b").unionByName(low.select(F.col("low").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))
        new = write_out(small.distinct())
        if new.exceptAll(edges).limit(1).count() == 0 and new.count() == edges.count():
            break
        edges = new
    found = edges.groupBy(F.col("b").alias("ref")).agg(F.min("a").alias("label"))
    return nodes.join(found, "ref", "left").select("ref", F.coalesce("label", "ref").alias("label"))
