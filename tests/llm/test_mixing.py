import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import mixing as M


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_the_best_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(3, 40, 6))
    counts = rng.integers(1, 4, len(lengths))
    sums = {sum(int(a * b) for a, b in zip(lengths, t, strict=True)) for t in itertools.product(*[range(c + 1) for c in counts])}
    for budget in (0, 2, 17, 60, 111, 10_000):
        take = M._knapsack(lengths, counts, budget, rng.permutation(len(lengths)))
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)
        whole = M.fit(lengths, counts, budget, seed)
        assert (whole <= counts).all() and int((whole * lengths).sum()) <= budget or budget >= int((lengths * counts).sum())


def test_large_budgets_fit_closely():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 3000)
    counts = rng.integers(1, 200, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.1, 0.37, 0.9):
        budget = int(total * share)
        assert int((M.fit(lengths, counts, budget, 3) * lengths).sum()) == budget


def counted(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id long, source string, n_tokens long, row long")


def mixture(spark, rows, targets, **options):
    counts = counted(spark, rows)
    plan = M.budgets(counts, spark.createDataFrame(targets, "source string, target_share double, max_repeats long"), **options)
    return plan, M.mix(counts, plan)


def test_shares_and_repeats(spark):
    rows = [(i, "big", 5 + i % 7) for i in range(2000)] + [(9000 + i, "small", 4) for i in range(30)] + [(1, None, 3), (2, "other", 3), (3, "big", 0)]
    targets = [("Big ", 0.5, 1), ("SMALL", 0.3, 3), ("none", 0.2, 4)]
    plan, mixed = mixture(spark, rows, targets)
    got = {r["source"]: r for r in M.report(plan, mixed).collect()}
    assert got["small"]["most_copies"] == 3 and got["small"]["mixed_tokens"] == 360 and got["none"]["mixed_tokens"] == 0
    assert abs(got["big"]["actual_share"] - 0.625) < 1e-3 and got["big"]["most_copies"] == 1
    copies = mixed.groupBy("id").count().where("count > 1").count()
    assert copies == 0 and {r["id"] for r in mixed.collect()} == {r["id"] for r in M.mix(counted(spark, rows), plan).collect()}


def test_part_of_a_repeat(spark):
    _, mixed = mixture(spark, [(i, "s", 10) for i in range(10)], [("s", 1.0, 3)], total=250)
    assert sorted(r["copies"] for r in mixed.collect()) == [2] * 5 + [3] * 5
    for rows, targets in (([], [("s", 1.0, 1)]), ([(1, "s", 4)], [])):
        plan, mixed = mixture(spark, rows, targets)
        assert mixed.count() == 0 and M.report(plan, mixed).count() == len(targets)


def test_tokens(spark):
    if not __import__("pathlib").Path(M.TOKENIZER).exists():
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, " A-b ", "hello world", 5), (2, None, None, 6)], "id long, source string, text string, n_tokens long")
    got = {r["id"]: (r["source"], r["n_tokens"]) for r in M.token_counts(df, F.col("id"), F.col("source"), F.col("text")).collect()}
    assert got == {1: ("a_b", 2), 2: (None, 0)}


@pytest.mark.parametrize("seed", range(2))
def test_copies_meet_a_budget_that_can_be_met(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(50, 900, 6)
    sums = {int((sizes * t).sum()) for t in itertools.product(range(4), repeat=6)}
    for total in sorted(sums)[len(sums) // 3 :: len(sums) // 3]:
        plan, mixed = mixture(spark, [(i, "s", int(n)) for i, n in enumerate(sizes)], [("s", 1.0, 3)], total=total)
        rows = mixed.collect()
        assert sum(r["copies"] * r["n_tokens"] for r in rows) == total and max(r["copies"] for r in rows) <= 3


def test_copies_of_a_length_differ_by_one(spark):
    _, mixed = mixture(spark, [(i % 40, "s", 7) for i in range(50)], [("s", 1.0, 4)], total=7 * 123)
    copies = sorted(r["copies"] for r in mixed.collect())
    assert copies == [2] * 27 + [3] * 23
