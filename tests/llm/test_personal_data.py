import random
import time

from pyspark.sql import functions as F

from quarrylight.llm import personal_data as P

GIVEN, SURNAME = ["Anna", "Boris", "Clara", "Dénes", "Eva"], ["Korvath", "Lindö", "Marwen", "Nolte-Bay", "Oskar"]


def corpus():
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(120):
        g, s = rng.choice(GIVEN), rng.choice(SURNAME)
        mail, phone = f"{P.fold(g)}.{P.fold(s)}@mail.example", f"+44 1632 960 {rng.randrange(100, 999)}"
        local = f"01632 960{rng.randrange(100, 999)}"
        name = rng.choice([f"{g} {s}", f"{s}, {g}", f"{g[0]}. {s}", f"{g} Q. {s}", f"{g} {s}".upper()])
        rows.append((i, f"Contact: {name}, {mail}\nRing {phone} for news.\nRing {local} for news.\nThe Guide Board shows 3 lines."))
        want |= {(i, "person", name), (i, "email", mail), (i, "phone", phone), (i, "phone", local)}
    rows.append((500, "Ms Anna Marwen moved to 12 bis avenue Prisor and asked. Part 4006381 333931 of 12 May Road. Select Guide Board. Set max@round = 1 and see a@2x.png."))
    want |= {(500, "person", "Anna Marwen"), (500, "address", "12 bis avenue Prisor")}
    rows.append((501, "Write to eva (at) mail [dot] example."))
    want |= {(501, "email", "eva (at) mail [dot] example")}
    return rows + [(600, None), (601, ""), (602, "nothing here")], want


def test_findings(spark):
    rows, want = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    got = {(r["id"], r["kind"], r["pii"]) for r in P.find_personal(df, F.col("doc_id"), F.col("text")).collect()}
    assert got == want
    for r in P.find_personal(df, F.col("doc_id"), F.col("text")).collect():
        text = dict(rows)[r["id"]]
        assert text[r["start"] : r["start"] + len(r["pii"])] == r["pii"]
    assert P.find_personal(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_sanitized(spark):
    rows, _ = corpus()
    got = {r["id"]: (r["n_found"], r["text"]) for r in P.sanitize(spark.createDataFrame(rows, "id long, text string"), F.col("id"), F.col("text")).collect()}
    assert got[0] == (4, "Contact: [PERSON], [EMAIL]\nRing [PHONE] for news.\nRing [PHONE] for news.\nThe Guide Board shows 3 lines.")
    assert got[600] == (0, None) and got[601] == (0, "") and got[602] == (0, "nothing here")


def test_shapes():
    def of(text):
        return {(k, p) for k, _, p, *_ in P.candidates(text) if k != "person"}

    assert ("national_id", "QQ 15 00 96 A") in of("ID: QQ 15 00 96 A;") and ("address", "Calle Torvela, 145") in of("go to Calle Torvela, 145, gate")
    assert ("address", "40 Oskwood St.") in of("address is 40 Oskwood St..") and ("address", "9 Old Mill Fen St") in of("It is 9 Old Mill Fen St. Next one")
    assert ("phone", "+49 (0) 30 / 23125-657") in of('"+49 (0) 30 / 23125-657"') and ("phone", "+1-829-555-0199 ext. 712") in of("Ring +1-829-555-0199 ext. 712 for")
    assert not of("10.0.0.7 and 2024-01-15 at max@round") and {k for k, _ in of("x y(at)z.example")} == {"email"}


def test_very_long_texts():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "A " * 100_000, "a.b-" * 50_000, "Anna Marwen, a.marwen@mail.example " * 2000):
        P.candidates(text)
    assert time.time() - began < 60


def test_certain_names_that_occur_once(spark):
    rows, want = corpus()
    rows += [(700, "Notes by Ximena Vurlquist, ximena.vurlquist@mail.example, are here."), (701, "Then Dear Ottilie Brandwen (obrandwen@mail.example) left."), (702, "Seen Ulla Zarnow, zarnow@mail.example, twice.")]
    names = {(700, "person", "Ximena Vurlquist"), (701, "person", "Ottilie Brandwen"), (702, "person", "Ulla Zarnow")}
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id"], r["kind"], r["pii"]) for r in P.find_personal(df, F.col("id"), F.col("text")).collect()}
    assert {x for x in got if x[1] == "person" and x[0] >= 700} == names and {x for x in got if x[0] < 700} == want


def test_written_forms_behind_the_gates():
    def of(text):
        return {(k, p) for k, _, p, *_ in P.candidates(text) if k != "person"}

    assert of("Ring (01632) / (22) 9601 now") == {("phone", "(01632) / (22) 9601")}
    for mail in ("eva At mail dot example", "eva at mail.site dot example", "eva at mail (dot) example", "eva at mail [dot] example", "eva(At)mail.example"):
        assert of(f"Write to {mail}, please") == {("email", mail)}
    assert not of("We met at noon. Look at this.example")


def test_disclosure_is_measured_in_bits(spark):
    """Of terms seen equally often with candidates, the one that stands beside seeds discloses; smoothing keeps single sightings out."""
    rows = [("phone", "ring", k < 30) for k in range(40)] + [("phone", "part", k < 1) for k in range(40)] + [("phone", "once", True)]
    seen = spark.createDataFrame(rows, "kind string, term string, seed boolean")
    base = spark.createDataFrame([("phone", 0.001)], "kind string, base double")
    got = {r["term"]: r for r in P.disclosing(seen, ["kind", "term"], base, P.BESIDE_IT).collect()}
    assert set(got) == {"ring"}
    chance = (30 + P.DOUBT * 0.001) / (40 + P.DOUBT)
    import math

    assert abs(got["ring"]["bits"] - math.log2(chance / 0.001)) < 1e-9 and abs(got["ring"]["share"] - got["ring"]["bits"] / -math.log2(0.001)) < 1e-9
    assert {r["term"] for r in P.disclosing(seen, ["kind", "term"], base, P.BESIDE_IT, known=P.SEED).collect()} == {"ring", "part", "once"}


def test_words_above_the_threshold_are_removed_and_others_stay(spark):
    rows, _ = corpus()
    names = [(900, "Anna Korvath, anna.korvath@mail.example, wrote. A note of Korvath asked for May and Board, and Marwen too.")]
    got = {r["id"]: r["text"] for r in P.sanitize(spark.createDataFrame(rows + names, "id long, text string"), F.col("id"), F.col("text")).collect()}
    assert got[900] == "[PERSON], [EMAIL], wrote. A note of [NAME] asked for May and Board, and Marwen too."


def test_words_far_from_a_candidate_are_whole():
    long = "x" * 200
    assert P._around(f"see {long} 1234567 end", 205, 212) == [f"B {long} end", f"L see {long}"]
    assert [m[2] for m in P._mails("a" * 500 + "@mail.example")] == ["a" * 500]
