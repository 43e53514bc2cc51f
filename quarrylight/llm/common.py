"""Small helpers that several operators share."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

#: A word is a run of letters or digits of any script.
WORD = re.compile(r"[^\W_]+")


class WordHash(dict):
    """64-bit hashes of words, kept for as long as a task's worker lives (up to a million words)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, known: WordHash) -> np.ndarray:
    if "İ" in text:  # its lower form has a mark that would part the word
        words = [w.lower() for w in WORD.findall(text)]
    else:
        words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all sequences of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        at = len(hashes) - n + 1
        out = np.zeros(at, np.uint64)
        for k in range(n):
            out = (out ^ hashes[k : k + at]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def spread(df: DataFrame) -> DataFrame:
    """More partitions where a small file came in fewer than there are cores; large inputs stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
