import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import classify as C
from quarrylight.operators import conversation as V
from quarrylight.operators import prompts as P
from quarrylight.operators import vectors as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keyphrases(spark):
    df = spark.createDataFrame([(1, "Event rules and event rules for the supplier"), (2, "short"), (3, None)], "id long, text string")
    got = [(r["phrase"], r["score"]) for r in C.keyphrases(df, "id", F.col("text"), stop=["and", "for", "the"]).orderBy("rank").collect()]
    assert got == [("event rules", 2.8), ("event", 2.4), ("rules", 2.4), ("supplier", 1.2)]


def test_prompt_types(spark):
    best = value(spark, C.prompt_types(F.lit("Explain why the error information appears")))
    assert [(b["category"], round(b["score"], 6)) for b in best] == [("Question", 1.7), ("Troubleshooting", 1.0), ("General", 1.0)]
    assert [tuple(b) for b in value(spark, C.prompt_types(F.lit("what are fact sheets")))] == [("General", 0.0)]
    assert value(spark, C.query_type(F.lit("How do I x"))) == "How to"


def test_density_purpose_tags(spark):
    d = value(spark, C.keyword_density(F.lit("PO for the supplier bid; supplier")))
    assert (d["sourcing"], d["procurement"], d["domain"], d["confidence"]) == (3, 1, "Sourcing", 1.0)
    assert value(spark, C.purpose(F.lit("step 3"), F.lit(None), {"reference": ["overview"]})) == "how_to"
    assert value(spark, C.purpose(F.lit(None), F.lit(None), {"reference": ["overview"]})) == "unknown"
    assert value(spark, C.redundant(F.lit("a b c"), F.lit("a b d"))) is False and value(spark, C.redundant(F.lit("a"), F.lit("a b"))) is True
    none = F.array().cast("array<struct<tag:string,score:double>>")
    tags = value(spark, C.fuse_tags(none, F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("score")) for t, s in (("bid", 1.0), ("bid board", 3.0), ("clause", 2.0))])))
    assert [tuple(t) for t in tags] == [("clause", 2.0), ("bid", 1.0)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5)).astype(np.float32)
    m[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 3")
    for metric in ("cosine", "ip", "l2"):
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in X.top_k(df, q, k=4, metric=metric).collect()}
        for i in range(3):
            a, b = m[i].astype(float), m.astype(float)
            s = {"ip": b @ a, "l2": -((b - a) ** 2).sum(1)}.get(metric)
            if s is None:
                n = np.linalg.norm(b, axis=1)
                s = np.where(n > 0, (b @ a) / np.where(n > 0, n, 1) / np.linalg.norm(a), -9)
            for rank, j in enumerate(np.lexsort((np.arange(60), -np.round(s, 9)))[:4], 1):
                assert got[i, rank][0] == j and abs(got[i, rank][1] - (-s[j] if metric == "l2" else s[j])) < 1e-5
    assert X.top_k(df.where("vec_id < 2"), q, k=5).count() == 6
    assert X.top_k(df.limit(0), q).count() == 0 and X.top_k(df, q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.top_k(df, q, metric="x")
    assert [value(spark, X.compatible_score(F.lit(s))) for s in (1.0, 0.0, -1.0, 3.0)] == [0.5, 1.0, 1.5, 0.0]


def test_best_per_source(spark):
    hits = spark.createDataFrame([(1, r, k) for r, k in ((1, "A"), (2, None), (3, "A"), (4, None))], "q long, rank long, k string")
    assert sorted(r["rank"] for r in X.best_per_source(hits, "q", "rank", F.col("k")).collect()) == [1, 2]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "id long, t string")
    e = {r["vec_id"]: r["embedding"] for r in X.embed(df, "id", "t").collect()}
    assert e[1] == e[2] and abs(sum(x * x for x in e[1]) - 1) < 1e-6 and not any(e[3])


@pytest.mark.parametrize(("budget", "kept"), [(50, 2), (100, 4), (200, 8), (500, 22), (1000, 40)])
def test_history(spark, budget, kept):
    rows = [(1, 2 * i + k, role, "w " * n) for i in range(20) for k, (role, n) in enumerate((("user", 14), ("assistant", 31)))]
    assert V.trim_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget).count() == kept


def test_history_of_system_messages(spark):
    rows = [(1, 0, "system", "a b c"), (1, 1, "system", "d e f"), (1, 2, "user", "g"), (2, 0, None, None)]
    got = V.trim_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=5)
    assert {(r["conv_id"], r["turn"]) for r in got.collect()} == {(1, 1), (2, 0)}


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "Guide 2", "<p>b</p>"), (1, 1, "Guide 1", "a"), (1, 3, "Guide 1", None), (2, 1, None, None)], "q long, rank long, name string, text string")
    got = {r["q"]: r["citations"] for r in P.citations(hits, "q", "rank", F.col("name")).collect()}
    assert got == {1: "\n**Cited guides:**\n- Guide 1\n- Guide 2", 2: ""}
    text = {r["q"]: r["prompt"] for r in P.context_prompt(hits, "q", "rank", P.context_entry(F.col("text"), F.lit(None)), F.lit("D"), F.lit("Q")).collect()}
    assert text[1] == "Domain: D\n\nQuestion: Q\n\n\n\nContext:\n\n[Source](#)\na\n\n[Source](#)\nb"
    assert value(spark, P.fill("a {x} {y}", x=F.lit(None))) == "a  {y}"


BY = C.Dictionaries({"x": ["apple"], "y": [("pear", 2.0)]}, {"x_red": ["red"], "y_soft": ["soft"], "z_odd": ["odd"]}, {"reference": ["overview"]}, {"fruit": ["apple", "pear"]}, {"golden apple": 0.8, "core": 0.7})


def test_enriched_rows(spark):
    df = spark.createDataFrame([(1, "Red apple", "An odd  apple core\nof red", "old"), (2, None, "odd and soft", None), (3, None, None, None)], "id long, title string, text string, tags string")
    got = {r["id"]: r for r in C.clean_and_enrich(df, "text", "title", BY).collect()}
    assert got[1]["text"] == "An odd apple core of red" and got[1]["domains"] == ["x"] and got[1]["categories"] == ["fruit"] and got[1]["subdomains"] == ["x_red"]
    tags = got[1]["tags"]
    assert tags[0] == "apple" and {"x", "core"} <= set(tags) and not {"x_red", "red apple"} & set(tags)  # redundant with x and apple
    assert set(got[2]["subdomains"]) == {"y_soft", "z_odd"} and got[2]["domains"] == [] and got[2]["content_purpose"] == "unknown"
    assert got[3]["text"] is None and got[3]["tags"] == []
    plain = C.clean_and_enrich(df, "text", "title")
    assert plain.columns == df.columns


def brute_tags(first, candidates):
    """All of the first list, then each candidate unless redundant with one kept; by score, ties in their order."""
    def redundant(a, b):
        x, y = set(a.split()), set(b.split())
        return a == b or a in b or b in a or (len(x) > 1 and len(y) > 1 and len(x & y) / min(len(x), len(y)) > 0.7)

    kept = list(first)
    for tag, score in candidates:
        if not any(redundant(tag, k) for k, _ in kept):
            kept.append((tag, score))
    return sorted(kept, key=lambda t: -t[1])


def test_tags_against_brute_force(spark):
    import random

    rng = random.Random(1)
    words = ["a", "b", "c", "d e", "f", "b c", "a b c", "e f g", "g f e h"]
    rows = [([(rng.choice(words), 1.0) for _ in range(rng.randrange(3))], [(rng.choice(words), rng.randrange(5) / 2) for _ in range(rng.randrange(8))]) for _ in range(60)]
    kind = "array<struct<tag:string,score:double>>"
    df = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(rows)], f"i long, f {kind}, c {kind}")
    got = {r["i"]: [tuple(t) for t in r["t"]] for r in df.select("i", C.fuse_tags(F.col("f"), F.col("c")).alias("t")).collect()}
    assert got == {i: brute_tags(f, c) for i, (f, c) in enumerate(rows)}


def test_questions(spark):
    d = {"A": ["order", ("bid", 2.0)], "B": ["order"]}
    assert [tuple(x) for x in value(spark, C.question_domains(F.lit("An Order, a bid"), d))] == [("A", 1.0), ("B", 0.5 / 1.5)]
    assert [tuple(x) for x in value(spark, C.question_domains(F.lit(None).cast("string"), d))] == [("General", 0.0)]
    one = value(spark, C.classify_question(F.lit("How do I order"), d))
    assert [x["category"] for x in one["domains"]] == ["A", "B"] and one["prompt_type"] == "How to" and one["alternatives"] == []
    weak, strong = (F.array(F.struct(F.lit("G").alias("category"), F.lit(s).alias("score"))) for s in (0.0, 1.0))
    assert value(spark, C.with_fallback(weak, F.lit("near"), F.lit(0.4)))[0]["category"] == "near"
    assert value(spark, C.with_fallback(strong, F.lit("near"), F.lit(0.4)))[0]["category"] == "G"
    assert value(spark, C.with_fallback(weak, F.lit(None).cast("string"), F.lit(None).cast("double")))[0]["category"] == "G"
    assert value(spark, C.title_domains(F.lit("The Bid"), d)) == ["A"] and value(spark, C.title_domains(F.lit(None), d)) == []


def test_nearest_label(spark):
    labels = spark.createDataFrame([("up", [0.0, 1.0]), ("right", [1.0, 0.0])], "label string, vector array<float>")
    df = spark.createDataFrame([(1, [0.1, 2.0]), (2, [3.0, 0.2]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<float>")
    assert {r["id"]: r["label"] for r in X.nearest_label(df, "id", "v", labels).collect()} == {1: "up", 2: "right", 3: "right"}


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "", "a", "A"), (1, 2, "One. Two! Three.", "b", "B"), (2, 1, None, None, None)], "q long, rank int, text string, source string, title string")
    got = {r["q"]: r for r in P.answer_queries(hits, "q", "rank", F.lit("why"), F.lit("General"), F.col("text"), F.col("source"), F.col("title")).collect()}
    assert got[1]["answer"] == "One. Two!" and got[1]["response"] == "One. Two!\n\n\n**Cited guides:**\n- A\n- B"
    assert got[1]["prompt"].endswith("Context:\n\n[Source](b)\nOne. Two! Three.") and got[2]["answer"] == "" and got[2]["response"] == ""


def test_conversations_are_stored(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("c", 1, "user", "hello"), ("c", 2, "assistant", "hi"), ("d", 1, "user", "x")]
    schema = "conv_id string, turn long, role string, text string, created_at timestamp"
    m = spark.createDataFrame([(*r, None) for r in rows], schema)
    V.save(m, store)
    more = spark.createDataFrame([("c", "user", "and", None), ("new", "user", "first", None), (None, "user", "lost", None)], "conv_id string, role string, text string, created_at timestamp")
    longer = V.append(V.load(spark, store).where("conv_id = 'c'"), more)
    assert {(r["conv_id"], r["turn"], r["text"]) for r in longer.collect()} == {("c", 1, "hello"), ("c", 2, "hi"), ("c", 3, "and"), ("new", 1, "first")}
    V.save(longer, store)
    assert V.load(spark, store).count() == 5
    V.delete(spark, spark.createDataFrame([("d",)], "conv_id string"), store)
    assert {r["conv_id"] for r in V.load(spark, store).collect()} == {"c", "new"}


def test_values_and_rows(spark):
    from quarrylight.operators import relational as R

    df = spark.createDataFrame([(1, None, "x" * 9, [1, 2])], "a long, b string, c string, d array<long>")
    back = df.select(R.from_json_row(R.as_json(df, ["a", "b", "c"]), df, ["a", "b", "c"]).alias("r")).first()["r"]
    assert tuple(back) == (1, None, "x" * 9)
    assert tuple(df.select(R.field_value(F.col("b")), R.field_value(F.col("c"), 4), R.field_value(F.col("a"))).first()) == ("", "xxxx...", "1")
