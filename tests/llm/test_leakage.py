import random

import numpy as np
from pyspark.sql import functions as F

from quarrylight.llm import leakage as L
from quarrylight.llm.common import WORD


def rows_and_truth():
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(13, 60))), " ".join(rng.choice(vocab) for _ in range(6))) for i in range(12)] + [(50, "too short", "x"), (51, None, None)]
    docs = []
    for d in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            _, text, answer = items[rng.randrange(12)]
            w = text.split()
            n = rng.randrange(10, len(w) + 1) if len(w) > 10 else len(w)
            at = rng.randrange(len(w) - n + 1)
            p = rng.randrange(len(words) + 1)
            words[p:p] = w[at : at + n] + (answer.split() if d % 2 else [])
        docs.append((d, ", ".join(words).title()))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1])]
    truth = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        runs = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, text, _ in items:
            v = (text or "").split()
            if runs & {tuple(v[k : k + 13]) for k in range(len(v) - 12)}:
                truth.add((d, i))
    return docs, items, truth


def test_verbatim_leaks_against_brute_force(spark):
    docs, items, truth = rows_and_truth()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, id string")
    ev = spark.createDataFrame(items, "item_id long, item_text string, answer_text string")
    for paraphrases in (False, True):
        got = L.leaks(df, F.col("doc_id"), F.col("text"), ev, paraphrases=paraphrases)
        assert {(r["id"], r["item_id"]) for r in got.where("verbatim").collect()} == truth
    assert L.leaks(df.limit(0), F.col("doc_id"), F.col("text"), ev).count() == 0
    assert L.leaks(df, F.col("doc_id"), F.col("text"), ev.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 5)
    docs, items, truth = rows_and_truth()
    got = L.leaks(spark.createDataFrame(docs, "id long, text string"), F.col("id"), F.col("text"), spark.createDataFrame(items, "item_id long, item_text string, answer_text string"))
    assert {(r["id"], r["item_id"]) for r in got.collect()} == truth


def test_segment_sums_and_subsequence():
    rng = np.random.default_rng(0)
    table = np.r_[rng.normal(size=(20, 3)), np.zeros((1, 3))].astype(np.float32)
    index = rng.integers(0, 20, 100).astype(np.int32)
    starts = np.array([0, 1, 30, 31, 99])
    want = np.array([table[p].sum(0) for p in np.split(index, starts[1:])])
    for width in (3, 8, 200):
        assert np.allclose(L.segment_sums(table, index, starts, width), want, atol=1e-4)
    a, b = np.array([1, 2, 3, 4, 5]), np.array([2, 9, 4, 5, 1])
    assert L.common_subsequence(a, b) == 3 and L.common_subsequence(a, b[:0]) == 0


def test_windows_of_equal_words_have_equal_codes():
    rng = np.random.default_rng(1)
    table = L.whole_numbers(rng.normal(size=(512, 64)).astype(np.float32), 13)
    words = rng.integers(0, 2**32, 20_000, dtype=np.uint32)
    words[15_000:15_040] = words[3:43]
    codes = L._codes(table, words, 13)
    assert (codes[15_000:15_028] == codes[3:31]).all() and len(codes) == 20_000 - 12
    want = [np.sign(table[words[k : k + 13] % 512].astype(np.int64).sum(0)) for k in (0, 777, 19_987)]
    got = [np.unpackbits(codes[k : k + 1].view(np.uint8)) for k in (0, 777, 19_987)]
    assert all(((w > 0) == g).all() for w, g in zip(want, got, strict=True))
    assert len(L._codes(table, words[:5], 13)) == 0


def test_codes_follow_the_angle():
    """Bits that differ grow with the angle, so windows of the same code lie close together."""
    rng = np.random.default_rng(2)
    table = L.whole_numbers(rng.normal(size=(4096, 64)).astype(np.float32), 13)
    base = rng.integers(0, 2**32, 13, dtype=np.uint32)
    apart = []
    for n in (0, 2, 6, 13):
        other = base.copy()
        other[:n] = rng.integers(0, 2**32, n)
        apart.append(int(np.bitwise_count(L._codes(table, base, 13) ^ L._codes(table, other, 13))[0]))
    assert apart[0] == 0 and apart[1] < apart[2] < apart[3]


def test_a_long_document_is_no_paraphrase_by_chance(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(rng.choice(vocab) for _ in range(20)), "")]
    docs = [(1, " ".join(rng.choice(vocab) for _ in range(4000)))]
    got = L.leaks(spark.createDataFrame(docs, "id long, text string"), F.col("id"), F.col("text"), spark.createDataFrame(items, "item_id long, item_text string, answer_text string"), paraphrases=True)
    whole = L.common_subsequence(*[np.array([int(w[1:]) for w in t.split()]) for t in (items[0][1], docs[0][1])]) / 20
    assert whole >= L.COMMON and got.count() == 0


def test_paraphrases_with_a_quarter_of_the_words_replaced(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40)), "") for i in range(20)]
    docs = [(100 + d, " ".join(rng.choice(vocab) for _ in range(150))) for d in range(100)]
    for i, text, _ in items:
        w = text.split()
        for k in range(1, 40, 4):
            w[k] = rng.choice(vocab)
        rest = [rng.choice(vocab) for _ in range(120)]
        docs.append((i, " ".join(rest[:50] + w + rest[50:])))
    df = spark.createDataFrame(docs, "id long, text string")
    got = L.leaks(df, F.col("id"), F.col("text"), spark.createDataFrame(items, "item_id long, item_text string, answer_text string"), paraphrases=True)
    assert {(r["id"], r["item_id"], r["verbatim"]) for r in got.collect()} == {(i, i, False) for i in range(20)}
