import random
from datetime import datetime as D

from pyspark.sql import functions as F

from quarrylight.operators import hierarchy as H
from quarrylight.operators import orphans as O
from quarrylight.operators.skew import heavy_keys, split_join, valid_version

NODES = "node string, parent string, label string, rank long, kind string"


def walk(parents: dict):
    """Brute force: node -> (kind, root, depth, path)."""
    out = {}
    for n in parents:
        path, at = [n], parents[n]
        while at in parents and at not in path:
            path.append(at)
            at = parents[at]
        if at not in parents:
            out[n] = ("tree", path[-1], len(path) - 1, list(reversed(path)))
        else:
            loop = path[path.index(at) :]
            out[n] = ("loop" if n in loop else "below_loop", min(loop, key=int), -1, None)
    return out


def check(spark, parents: dict):
    df = spark.createDataFrame([(n, p, n, int(n), "x") for n, p in parents.items()], NODES)
    got = {r["node"]: (r["kind"], r["root"], r["depth"], r["path"]) for r in H.hierarchy(df).collect()}
    assert got == walk(parents)


def test_chains_stars_and_loops(spark):
    parents = {str(i): str(i - 1) if i else None for i in range(60)}  # a long chain
    parents |= {str(100 + i): "59" for i in range(40)}  # a star below it
    parents |= {"200": "202", "201": "200", "202": "201", "203": "201", "204": "203", "210": "210", "211": "210", "220": "221", "221": "220"}
    parents |= {"300": "999", "301": "300"}  # a parent that is not there
    check(spark, parents)


def test_random_forests(spark):
    rng = random.Random(3)
    parents = {str(i): rng.choice([None, str(rng.randrange(300)), str(rng.randrange(300)), str(rng.randrange(300))]) for i in range(300)}
    check(spark, parents)


def test_hierarchy_edges(spark):
    assert H.hierarchy(spark.createDataFrame([], NODES)).count() == 0
    df = spark.createDataFrame([(None, "1", "x", 1, "a"), ("1", None, None, None, "path"), ("1", None, None, None, "path")], NODES)
    assert [(r["node"], r["path"]) for r in H.hierarchy(df).collect()] == [("1", ["1"])]


def test_descendants(spark):
    df = spark.createDataFrame([("1", None, "a", 1, ""), ("2", "1", "b", 2, ""), ("3", "2", "c", 3, "")], NODES)
    assert {tuple(r) for r in H.descendants(H.hierarchy(df)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    rows = [("1", "2", "a", 1, ""), ("2", "1", "b", 2, ""), ("3", "2", "c", 3, ""), ("4", "3", "d", 4, ""), ("5", "4", "e", 5, "")]
    below = {tuple(r) for r in H.descendants(H.hierarchy(spark.createDataFrame(rows, NODES))).collect()}
    assert below == {("b", "c", 1), ("b", "d", 2), ("c", "d", 1), ("b", "e", 3), ("c", "e", 2), ("d", "e", 1)}


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(90)] + [("k%d" % (i % 7), i) for i in range(20)] + [(None, 5)], "k string, v long")
    right = spark.createDataFrame([("hot", "h"), ("k1", "a"), ("k2", "b")], "k string, w string")
    hot = heavy_keys(left, "k", most=5, least=10)
    assert [r["k"] for r in hot.collect()] == ["hot"]
    for how in ("left", "inner"):
        a = split_join(left, right, "k", how, most=5, least=10).select("k", "v", "w")
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=str)
    assert heavy_keys(left.limit(0), "k") is None


def test_valid_version(spark):
    rows = [(1, "old", D(2024, 1, 1), "x"), (1, "new", D(2024, 2, 1), "y"), (1, "new", D(2024, 2, 1), "y"), (2, None, None, "z"), (None, "n", D(2024, 1, 1), "w")]
    df = spark.createDataFrame(rows, "id long, name string, loaded_at timestamp, first_loaded string")
    got = {(r["id"], r["name"], r["first_loaded"]) for r in valid_version(df, "id").collect()}
    assert got == {(1, "new", D(2024, 1, 1)), (2, None, None)}


def test_orphans_by_hand(spark):
    at = [D(2024, 1, 5), D(2024, 2, 5)]
    refs = spark.createDataFrame([("c", i, "col", "hot", at[0]) for i in range(30)] + [("c", 95, "col", "late", D(2024, 1, 25)), ("c", 96, "col", None, at[0])] + [("c", 90, "col", "gone", at[1]), ("c", 91, "col", "late", at[0]), ("c", 92, "col", "late", at[1]), ("c", 93, "col", "fine", at[1]), ("c", 94, "col", "fine", None)], "child_table string, child_key long, ref_column string, key string, at timestamp")
    targets = spark.createDataFrame([("gone", True, at[0]), ("late", False, D(2024, 1, 20)), ("fine", False, at[0])], "key string, deleted boolean, first_loaded timestamp")
    for least in (5, 10_000):
        rows = {tuple(r) for r in O.orphan_rows(refs, targets, least=least).collect()}
        assert rows == {("c", i, "col", "missing", "2024-01") for i in range(30)} | {("c", 90, "col", "deleted", "2024-02"), ("c", 91, "col", "late", "2024-01")}
        counts = {tuple(r) for r in O.orphan_counts(refs, targets, least=least).collect()}
        assert counts == {("c", "col", "missing", "2024-01", 30, 1), ("c", "col", "deleted", "2024-02", 1, 1), ("c", "col", "late", "2024-01", 1, 1)}
    assert O.orphan_rows(refs.limit(0), targets).count() == 0


def test_keys_of_sheets(spark):
    df = spark.createDataFrame([(" 007.0 ", "C:\\x\\A%20B.PDF "), ("12.5", "a/b/\tc.png"), ("n/a", "  "), (None, None), ("99999999999999999999", "x/")], "n string, f string")
    got = [(r[0], r[1]) for r in df.select(O.whole_number(F.col("n")), O.file_key(F.col("f"))).collect()]
    assert got == [(7, "a b.pdf"), (None, "c.png"), (None, None), (None, None), (None, None)]
