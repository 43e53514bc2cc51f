import random

from pyspark.sql import functions as F

from quarrylight.llm import near_duplicates as N
from quarrylight.llm.common import WORD

SCHEMA = "space string, id string, text string, grams string"


def brute(rows, words, threshold, least):
    sets = {}
    for space, key, text, _ in rows:
        w = WORD.findall((text or "").lower())
        if key is not None and len(w) >= max(least, words):
            sets[space, key] = frozenset(zip(*[w[k:] for k in range(words)], strict=False))
    keys = sorted(sets)
    return {(s, a, b) for i, (s, a) in enumerate(keys) for t, b in keys[i + 1 :] if s == t and a != b and len(sets[s, a] & sets[t, b]) >= threshold * len(sets[s, a] | sets[t, b]) - 1e-9}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 120))]
        rows.append(("a" if i % 3 else "b", f"d{i:03d}", " ".join(base), "x"))
        for k in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(1, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            t = t[len(t) // 2 :] + t[: len(t) // 2] if k == 2 else t
            rows.append(("a" if i % 3 else "b", f"d{i:03d}v{k}", " ".join(t), "x"))
        if i % 10 == 0:
            rows.append(("a", f"copy{i}", " ".join(base).upper() + "!", "x"))
    return rows + [("a", "null", None, None), ("a", "empty", "", None), ("a", "short", "a b", None), ("a", None, "x " * 99, None)]


def found(df, **options):
    return {tuple(r) for r in N.near_duplicate_pairs(df, F.col("space"), F.col("id"), F.col("text"), **options).select("space", "id_a", "id_b").collect()}


def test_all_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, words=3, threshold=0.6, least=50) == brute(rows, 3, 0.6, 50)
    assert found(df) == brute(rows, 5, 0.8, 5)


def test_long_runs_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "RUN", 3)
    rows = corpus()
    assert found(spark.createDataFrame(rows, SCHEMA), words=3, threshold=0.6, least=50) == brute(rows, 3, 0.6, 50)


def test_large_classes_are_listed_once(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [("a", f"c{i:03d}", text, "") for i in range(50)] + [("a", "near", text + " more", "")]
    got = found(spark.createDataFrame(rows, SCHEMA), listed=10)
    members = {x for _, *p in got for x in p}
    assert members == {r[1] for r in rows} and len(got) == 50


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_groups(spark):
    rows = corpus()
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in N.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), F.col("space"), F.col("id"), F.col("text"), words=3, threshold=0.6, least=50).collect()}
    links = brute(rows, 3, 0.6, 50)
    ids = [(s, k) for s, k, t, _ in rows if k and len(WORD.findall(t or "")) >= 50]
    root = {x: x for x in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, a, b in links:
        x, y = sorted((top((s, a)), top((s, b))))
        root[y] = x
    assert set(got) == {k for _, k in ids}
    same = {}
    for s, k in ids:
        same.setdefault(top((s, k)), set()).add(got[k][0])
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_pairs_at_the_threshold_are_seldom_missed():
    for threshold in (0.6, 0.8):
        hit = threshold**N.WIDTH + N.WIDTH * (1 - threshold) * threshold ** (N.WIDTH - 1)
        assert (1 - hit) ** N.segments(threshold) <= 0.001


def test_recall_by_similarity(spark):
    """Of pairs of every similarity from 0.6 up nearly all are found; there is one pair a row of words, unlike all others."""
    rng, rows, want = random.Random(8), [], set()
    for k in range(600):
        n, share = 120, 0.6 + 0.4 * (k % 10) / 10
        same = round(2 * share * n / (1 + share))
        word = iter(rng.sample(range(10**9), 3 * n))
        base = [f"w{next(word)}" for _ in range(n)]
        rows += [("a", f"{k:03d}x", " ".join(base), ""), ("a", f"{k:03d}y", " ".join(base[:same] + [f"w{next(word)}" for _ in range(n - same)]), "")]
        a, b = (set(zip(*[r[2].split()[j:] for j in range(3)], strict=False)) for r in rows[-2:])
        if len(a & b) >= 0.6 * len(a | b):
            want.add(("a", f"{k:03d}x", f"{k:03d}y"))
    got = found(spark.createDataFrame(rows, SCHEMA), words=3, threshold=0.6, least=50)
    assert got <= want and len(got) >= 0.995 * len(want) > 500


def test_pairs_and_groups_agree(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    same = dict(words=3, threshold=0.6, least=50)
    label = {r["id"]: r["class_id"] for r in N.near_duplicate_groups(df, F.col("space"), F.col("id"), F.col("text"), **same).collect()}
    assert all(label[a] == label[b] for _, a, b in found(df, **same))


def test_a_template_of_many_texts_makes_few_candidates(spark, monkeypatch):
    """Texts that share a third of their words but are not similar: pairs compared stay far below all pairs."""
    monkeypatch.setattr(N, "RUN", 8)
    rng = random.Random(3)
    frame = [f"t{i}" for i in range(50)]
    rows = [("a", f"d{k:03d}", " ".join(frame + [f"w{rng.randrange(10**6)}" for _ in range(50)]), "") for k in range(300)]
    sets = N.text_sets(spark.createDataFrame(rows, SCHEMA), F.col("space"), F.col("id"), F.col("text"), 3, 50)
    seen = []
    keep = N._plausible
    monkeypatch.setattr(N, "_plausible", lambda pairs, *rest: seen.append(pairs.count()) or keep(pairs, *rest))
    assert N.similar_classes(sets, N.classes(sets), 0.6).count() == 0 and seen[0] < 300 * 299 / 2 * 0.35


def test_different_texts_with_equal_sets_keep_all_links(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [("a", f"c{i:03d}", " ".join(w.upper() if k == i else w for k, w in enumerate(words)), "") for i in range(40)]
    rows += [("a", f"copy{i:03d}", " ".join(words), "") for i in range(40)] + [("a", "near", " ".join(words) + " more", "")]
    got = found(spark.createDataFrame(rows, SCHEMA))
    different = {r[1] for r in rows if r[1][0] == "c" and not r[1].startswith("copy")} | {"near"}
    assert {("a", x, y) for x in different for y in different if x < y} <= got
    assert {x for _, *p in got for x in p} == {r[1] for r in rows} and len(got) == 41 * 40 // 2 + 41 + 39
