"""Evaluation texts inside training documents, by latent semantic retrieval.

Words are weighted by TF-IDF over the whole corpus and projected on a basis that a distributed randomised SVD of all
passages finds. Every window of RUN words, of documents and of evaluation items, has a latent vector; the signs of its
coordinates are its code, in which two vectors differ the more the wider their angle. Windows with the same code are
candidates, and their words decide on verbatim leaks. For paraphrases longer passages are candidates by their cosine with
passages of items; common subsequences and answers decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import WordHash, spread, word_hashes
from quarrylight.scratch import Growing, write_out

#: Hash buckets of words, rank of the basis, words of a passage in the SVD. These and no data set the size of what the driver sees.
TERMS, RANK, PASSAGE = 8192, 64, 64
#: A run of so many words leaks an item.
RUN = 13
#: Passages for paraphrases have so many blocks of RUN words and start at every block; COSINE makes a candidate, which needs COMMON of the item's words in order.
BLOCKS, COSINE, COMMON = 3, 0.45, 0.7
#: Items are searched in blocks of about so many, one block at a time; so much and no more is ever on the driver.
ITEMS = 4000
_CHUNKS = 64


def _tokens(batches):
    known = WordHash()
    for b in batches:
        ids, words = [], []
        for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(key)
            words.append((word_hashes(text, known) >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(words, pa.binary())], ["id", "words"])


def tokenized(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """id and the hashed words of each text that is not null, written once for the passes that follow."""
    src = df.select(id_col.alias("id"), text.alias("text")).where(F.col("text").isNotNull())
    return write_out(spread(src).mapInArrow(_tokens, f"id {src.schema['id'].dataType.simpleString()}, words binary"))


def _joined(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Documents of a batch in groups of some 200,000 words: number of the first one, all words, length of each."""
    raw, at = b.column("words").to_pylist(), 0
    while at < len(raw):
        size, end = 0, at
        while end < len(raw) and (size == 0 or size + len(raw[end]) <= 800_000):
            size += len(raw[end])
            end += 1
        yield at, np.frombuffer(b"".join(raw[at:end]), np.uint32), np.array([len(r) // 4 for r in raw[at:end]], np.int64)
        at = end


def _starts(lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every block of ``step`` words, no block crossing a document; and the document of each block."""
    n = -(-lengths // step)
    doc = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[doc] + within * step, doc


def segment_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Sum of table[index] over each segment of ``index``; the table's last row is zero.

    Segments are cut into parts of ``width`` that are added up a column of parts at a time, a piece that fits the cache.
    """
    ends = np.r_[starts[1:], len(index)]
    n = -(-(ends - starts) // width)
    first = np.cumsum(n) - n
    low = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(first, n)) * width
    high = np.minimum(low + width, np.repeat(ends, n))
    out = np.empty((len(low), table.shape[1]), np.float32)
    padded = np.r_[index, np.full(width, len(table) - 1, index.dtype)]
    for lo in range(0, len(low), 4096):
        at, end = low[lo : lo + 4096], high[lo : lo + 4096]
        total = table[padded[at]]
        for k in range(1, width):
            total += table[np.where(at + k < end, padded[at + k], len(table) - 1)]
        out[lo : lo + 4096] = total
    return out if len(out) == len(starts) else np.add.reduceat(out, first, axis=0)


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.r_[table, np.zeros((1, table.shape[1]), np.float32)].astype(np.float32)


def inverse_frequency(tokens: DataFrame, terms: int = TERMS) -> np.ndarray:
    """Inverse document frequency of each bucket, counted over all documents."""

    def run(batches):
        total = np.zeros(terms + 1, np.int64)
        for b in batches:
            for _, words, lengths in _joined(b):
                doc = np.repeat(np.arange(len(lengths)), lengths)
                seen = np.unique(doc * terms + words % terms) % terms
                total[:terms] += np.bincount(seen, minlength=terms)
            total[terms] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms + 1)), pa.array(total)], ["term", "n"])

    rows = tokens.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(terms + 1)
    for r in rows:
        out[r["term"]] = r["n"]
    return np.log((out[terms] + 1) / (out[:terms] + 1)).astype(np.float32)


def latent_basis(tokens: DataFrame, idf: np.ndarray, rank: int = RANK, passage: int = PASSAGE, seed: int = 7) -> np.ndarray:
    """Orthonormal basis (terms x rank) of the passages' TF-IDF space, by one pass of a randomised range finder.

    Every task adds up its share of A'(A x random matrix); shares are summed by Spark in slices of the terms, in two steps.
    """
    terms = len(idf)

    def run(batches):
        omega = _with_zero(np.random.default_rng(seed).standard_normal((terms, rank)).astype(np.float32) * idf[:, None])
        total = np.zeros((terms, rank), np.float32)
        for b in batches:
            for _, words, lengths in _joined(b):
                if not len(words):
                    continue
                term = (words % terms).astype(np.uint16)
                starts, _ = _starts(lengths[lengths > 0], passage)
                y = _with_zero(segment_sums(omega, term.astype(np.int32), starts, 16))
                of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(term)]))
                order = np.argsort(term, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(term[order].astype(np.int32)) != 0])
                total[term[order][first]] += segment_sums(y, of[order], first, 8)
        total *= idf[:, None]
        for k, part in enumerate(np.array_split(total, _CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([TaskContext.get().partitionId() % 32], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "half", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"])
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    parts = tokens.mapInArrow(run, "slice bigint, half bigint, part binary")
    parts = parts.groupBy("slice", "half").applyInPandas(add, "slice bigint, part binary").groupBy("slice").applyInPandas(add, "slice bigint, part binary")
    rows = sorted(parts.collect(), key=lambda r: r["slice"])
    if not rows:
        return np.zeros((terms, rank), np.float32)
    found = np.concatenate([np.frombuffer(bytes(r["part"]), np.float32) for r in rows]).reshape(terms, rank)
    return np.linalg.qr(found.astype(np.float64))[0].astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _codes(table: np.ndarray, words: np.ndarray, run: int) -> np.ndarray:
    """The code of the latent vector of every window of ``run`` words: the signs of its (up to 64) coordinates.

    ``table`` is of whole numbers, so equal windows have equal sums wherever they stand.
    """
    n = max(0, len(words) - run + 1)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, 8192):
        part = table[words[lo : lo + 8192 + run - 1] % len(table)]
        part = np.cumsum(part, axis=0, dtype=np.int32, out=part)
        sums = part[run - 1 :].copy()
        sums[1:] -= part[: len(sums) - 1]
        bits = np.packbits(sums > 0, axis=1)
        eight = np.zeros((len(bits), 8), np.uint8)
        eight[:, : bits.shape[1]] = bits
        out[lo : lo + len(bits)] = eight.view(np.uint64).ravel()
    return out


def whole_numbers(projection: np.ndarray, run: int) -> np.ndarray:
    """A projection in whole numbers of 32 bits, so small that sums of ``run`` of them fit."""
    top = float(np.abs(projection).max()) or 1.0
    return np.rint(projection[:, :64] / top * (2**30 / run)).astype(np.int32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        up = np.where(b == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(up, row[1:]))
    return int(row[-1])


def _bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(words, return_counts=True)


def _in_both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Words that two bags have in common; no common subsequence is longer."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())


def _search(items: list[tuple], projection: np.ndarray, run_length: int, cosine: float, paraphrases: bool):
    """Documents that leak one of ``items`` (item_id, text, answer)."""
    known = WordHash()
    words = [(word_hashes(t or "", known) >> np.uint64(32)).astype(np.uint32) for _, t, _ in items]
    table = whole_numbers(projection, run_length)
    terms = len(projection)
    # every window of every item, by the code of its latent vector
    runs = [np.lib.stride_tricks.sliding_window_view(w, run_length) for w in words if len(w) >= run_length]
    run_item = np.repeat([i for i, w in enumerate(words) if len(w) >= run_length], [len(r) for r in runs]).astype(np.int64)
    run_words = np.concatenate(runs) if runs else np.empty((0, run_length), np.uint32)
    run_code = np.concatenate([_codes(table, w, run_length) for w in words if len(w) >= run_length]) if runs else np.empty(0, np.uint64)
    order = np.argsort(run_code, kind="stable")
    run_code, run_item, run_words = run_code[order], run_item[order], run_words[order]
    codes, code_first, code_n = np.unique(run_code, return_index=True, return_counts=True)
    bags, answers = [], []
    if paraphrases:
        padded = _with_zero(projection)
        bags = [_bag(w) for w in words]
        answers = [(word_hashes(a or "", known) >> np.uint64(32)).astype(np.uint32).tobytes() for *_, a in items]
        width = BLOCKS * run_length
        passages = [(i, w[k : k + width]) for i, w in enumerate(words) if len(w) >= run_length for k in sorted({*range(0, max(1, len(w) - width), run_length), max(0, len(w) - width)})]
        owner = np.array([i for i, _ in passages], np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        every = np.concatenate([*words, np.zeros(1, np.uint32)])  # one more, so that an empty item at the end has a place
        item_first = np.cumsum(sizes) - sizes
        query = _unit(np.array([projection[(w % terms).astype(np.int64)].sum(0) for _, w in passages], np.float32).reshape(len(passages), projection.shape[1])).T.copy()

    def common_runs(w, doc_end):
        """Pairs of document and item with a window in common: those of equal codes whose words are equal."""
        if not len(codes):
            return set()
        code = _codes(table, w, run_length)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        doc = np.searchsorted(doc_end, np.arange(len(code)), side="right")
        here = np.flatnonzero((codes[at] == code) & (np.arange(len(code)) + run_length <= doc_end[doc]))
        at, pairs = at[here], set()
        k = 0
        while len(here):  # windows of items that share a code are taken one after the other
            mine = code_first[at] + k
            same = (w[here[:, None] + np.arange(run_length)] == run_words[mine]).all(axis=1)
            pairs.update(zip(doc[here[same]].tolist(), run_item[mine[same]].tolist(), strict=True))
            k += 1
            more = code_n[at] > k
            here, at = here[more], at[more]
        return pairs

    def alike(w, lengths):
        """Document, item and first word of each passage of a document that is near a passage of an item."""
        starts, block_doc = _starts(lengths, run_length)
        doc_first = np.cumsum(lengths) - lengths
        first = doc_first[block_doc]
        # how many of an item's words a document has at all: no common subsequence is longer
        may = np.zeros((len(lengths), len(sizes)), bool)
        for d, (lo, n) in enumerate(zip(doc_first, lengths, strict=True)):
            own = np.unique(w[lo : lo + n])
            here = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            total = np.r_[0, np.cumsum(here)]
            may[d] = total[item_first + sizes] - total[item_first] >= COMMON * sizes
        blocks = segment_sums(padded, (w % terms).astype(np.int32), starts, run_length)
        sums = blocks.copy()
        for k in range(1, BLOCKS):
            same = block_doc[k:] == block_doc[:-k]
            sums[:-k][same] += blocks[k:][same]
        sums = _unit(sums)
        step = max(16, 4_000_000 // len(owner))
        for lo in range(0, len(sums), step):
            near = sums[lo : lo + step] @ query
            row, col = np.nonzero(near >= cosine)
            row += lo
            fits = may[block_doc[row], owner[col]]
            row, col = row[fits], col[fits]
            yield from zip(block_doc[row].tolist(), owner[col].tolist(), (starts[row] - first[row]).tolist(), strict=True)

    def common_share(i, doc, spots):
        """The greatest share of an item's words that stand in order around one of the passages."""
        best, n, done = 0, len(words[i]), -1
        for at in sorted(spots):
            low, high = max(0, at - n), at + BLOCKS * run_length + n
            if low < done:
                low = max(0, done - n)  # what the passage before has covered
            part = doc[low:high]
            done = high
            if _in_both(bags[i], _bag(part)) >= max(COMMON * n, best + 1):
                best = max(best, common_subsequence(words[i], part))
        return best / max(1, n)

    def run(batches):
        for b in batches:
            exact: set[tuple[int, int]] = set()
            near: dict[tuple[int, int], list[int]] = {}
            for first, w, lengths in _joined(b):
                if not len(w):
                    continue
                filled = np.flatnonzero(lengths)
                exact.update((first + int(filled[x]), y) for x, y in common_runs(w, np.cumsum(lengths[filled])))
                if paraphrases and len(owner):
                    for x, y, at in alike(w, lengths[filled]):
                        near.setdefault((first + int(filled[x]), y), []).append(at)
            ids, raw = b.column("id"), b.column("words")
            rows = [(d, items[i][0], True, None, None) for d, i in sorted(exact)] if not paraphrases else []
            for d, i in sorted(exact | near.keys()) if paraphrases else ():
                doc = np.frombuffer(raw[d].as_py(), np.uint32)
                share = common_share(i, doc, near.get((d, i)) or range(0, len(doc), BLOCKS * run_length))
                if (d, i) in exact or share >= COMMON:
                    answer = np.frombuffer(answers[i], np.uint32)
                    answered = len(answer) > 0 and any((doc[k : k + len(answer)] == answer).all() for k in np.flatnonzero(doc == answer[0]) if k + len(answer) <= len(doc))
                    rows.append((d, items[i][0], (d, i) in exact, share, answered))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.bool_())],
                ["id", "item_id", "verbatim", "common", "answered"],
            )

    return run


def leaks(df: DataFrame, id_col: Column, text: Column, items: DataFrame, run: int = RUN, rank: int = RANK, cosine: float = COSINE, paraphrases: bool = False) -> DataFrame:
    """Documents that hold evaluation items: id, item_id, verbatim (``run`` consecutive words), common, answered.

    ``items`` (item_id bigint, item_text, answer_text) is the query set, searched in blocks of about ITEMS items, each block
    against all documents. Verbatim leaks have a window of ``run`` words whose latent vector has the code of one of the
    item's; windows start at every word on both sides, so no run is missed. With ``paraphrases`` also documents with a
    passage of ``cosine`` or more to a passage of the item around which COMMON of its words stand in order; ``common`` is
    that share and ``answered`` whether the answer stands in the document word for word. Items shorter than ``run`` words and
    null texts give no rows; each pair comes once per row of the document.
    """
    tokens = tokenized(df, id_col, text)
    idf = inverse_frequency(tokens)
    projection = latent_basis(tokens, idf, rank) * idf[:, None]
    asked = write_out(items.select("item_id", "item_text", "answer_text").distinct())
    blocks = max(1, -(-asked.count() // ITEMS))
    kind = tokens.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id bigint, verbatim boolean, common double, answered boolean"
    found = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = sorted(((r["item_id"], r["item_text"], r["answer_text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0))
        part = tokens.mapInArrow(_search(rows, projection, run, cosine, paraphrases), schema)
        if blocks == 1:
            return part
        if found is None:
            found = Growing(part)
        else:
            found.add(part)
    return found.df
