"""Personal information in free text, by information-theoretic sanitisation.

Shapes give candidates, each with its terms: the written form it has, the words of a name, the words around it. How much a
term tells about a protected entity is estimated from co-occurrence over the whole corpus: an entity of a kind has an
information content of -log2(base) bits, base being its rate among all words, and a term discloses log2(P(entity | term) /
base) of them. Some written forms (a phone number with its country code, a name built into a mail address beside it) are
known beforehand; they seed the counts. A candidate with a term that discloses more than the threshold share of its kind's
information content is found and generalised to its kind; single words that disclose a found person are removed as well.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import spread
from quarrylight.operators.skew import split_join
from quarrylight.scratch import write_out

KINDS = ("person", "email", "phone", "national_id", "address")
#: Thresholds, as shares of the information content: a term beside a candidate, a word of a name, a term beside a name none of whose words is known.
BESIDE_IT, WORD_OF_NAME, ALONE = 0.64, 0.69, 0.93
#: A term's counts are smoothed by so many occurrences at the base rate; forms known beforehand count as seen so often.
DOUBT, SEED = 12.0, 64.0
#: A name is beside a mail address within so many characters.
NEAR = 160

# fixed values: parts of the written forms
_TLD_NOT = {"png", "jpg", "jpeg", "gif", "svg", "pdf", "txt", "csv", "xlsx", "docx", "pptx", "html"}
_TITLES = {"mr", "ms", "mrs", "miss", "dr", "prof", "sir", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sr", "sra", "don", "doña"}
_PARTICLES = r"(?:van der|van den|van de|van|von der|von|de la|de los|del|de|da|dos|di|le|la|ter|ten|bin|al)"
_EN_STREET = r"(?:(?:St|Ln|Rd|Ave|Blvd|Dr|Ct|Pl|Sq)\b\.?|(?:Street|Lane|Road|Avenue|Boulevard|Drive|Court|Place|Square|Terrace|Crescent|Close|Yard|Way|Row|Walk|Hill|Gardens|Mews)\b)"
_FR_STREET = r"(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours)"
_ES_STREET = r"(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Carrera)"
_DE_STREET = r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|hof)"
_UNIT = r"(?:,? (?:Apt|Apartment|Flat|Unit|Suite|Floor|App|Etage|Whg)\.? ?\w+)?"

_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
_SIGN = re.compile(r"@|[(\[]at[)\]]| at (?=[\w-]+(?:\.[\w-]+)*(?: ?\(dot\)| ?\[dot\]| dot ))", re.I)
_LOCAL = re.compile(r"[\w+-]+(?:\.[\w+-]+)*")
_LOCAL_PART = re.compile(r"[\w.+-]")
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)*{_DOT}([^\W\d_]{{2,}})(?![\w-])", re.I)
PHONE = re.compile(r"(?<![\w.+/=\-])(?:\+\d{1,3}|\(\d{2,5}\)|\d{1,7})(?:(?:[ .\-]| ?/ ?)?\(\d{1,5}\))?(?:(?:[ .\-]| ?/ ?)?\d{2,8}|[ .\-]\d){0,7}(?:,? ?(?:ext\.?|x|poste|Durchw(?:ahl|\.)) ?\d{1,5})?(?![\w@])")
NATIONAL_ID = re.compile(r"(?<![\w\-.])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{7,8}|\d{8}-?[A-Z]|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}-\d{4})(?![\w\-]|\.\d)")
_SURE_ID = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]")
ADDRESS = re.compile(
    rf"(?<![\w])(?:\d{{1,4}} ?(?:bis|ter|quater)?,? {_FR_STREET} (?:(?:de la|de l['’]|des|du|de|d['’]|la|le) ?)*[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*"
    rf"|{_ES_STREET} ?(?:(?:de la|de los|del|de) )?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)*,? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª](?: ?[A-Z]\b)?)?"
    rf"|(?:Am|Im|Zum|Zur|An der|Auf dem|In der) [A-ZÀ-Þ][\w-]+ \d{{1,4}} ?[a-d]?(?!\w)|[A-ZÀ-Þ][\w-]*{_DE_STREET} \d{{1,4}}[a-d]?(?!\w)"
    rf"|\d{{1,4}}[a-d]? (?:[A-ZÀ-Þ][\w'’-]+ ){{1,3}}{_EN_STREET}{_UNIT})"
)
_UNSURE_ADDRESS = re.compile(rf"\d{{1,4}}[a-d]? (?:[A-ZÀ-Þ][\w'’-]+ ){{1,3}}{_EN_STREET}$")
_CAP = r"(?:[dDO]['’])?[A-ZÀ-ÞŁŚŻŠČŽİĞŞ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_INITIAL = r"[A-ZÀ-ÞŁŚŻŠČŽİĞŞ]\."
_SURNAME = rf"(?:{_PARTICLES} )?{_CAP}"
_FORWARD = re.compile(rf"(?P<given>{_CAP}|{_INITIAL})(?: (?P<middle>{_INITIAL}))?[  ](?P<surname>{_SURNAME})(?!\w)")
_BACKWARD = re.compile(rf"(?P<surname>{_SURNAME}), (?P<given>{_CAP}|{_INITIAL})(?: (?P<middle>{_INITIAL}))?(?!\w)")
_START = re.compile(rf"(?<![\w.'’-])(?=(?:{_CAP}|{_INITIAL}),?[  ](?:[A-ZÀ-ÞŁŚŻŠČŽİĞŞ]|d['’]|{_PARTICLES} )|{_PARTICLES} {_CAP}, )")
_WORD = re.compile(r"\w+|[^\w\s]")
_DIGIT, _SIX_DIGITS, _NINE_DIGITS = re.compile(r"\d"), re.compile(r"\d(?:[ -]?\d){5}"), re.compile(r"\d(?:[ ()./\-]{0,5}\d){8}")
_LINE_END = re.compile(r"[\r\n]")


def fold(text: str) -> str:
    """Lower case, without marks, with the two-letter forms of umlauts as mail addresses write them."""
    out = text.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("ı", "i")
    return "".join(c for c in unicodedata.normalize("NFKD", out) if c.isalnum())


def _around(text: str, start: int, end: int) -> list[str]:
    """Terms beside a candidate within its line: the word before with the word after; and two words before it."""
    size = 40
    while True:  # as far back as two whole words or the start of the line
        low = max(0, start - size)
        cut = max(text.rfind("\n", low, start), text.rfind("\r", low, start)) + 1
        words = _WORD.findall(text[max(low, cut) : start])
        if cut or not low or len(words) > 2:
            break
        size *= 2
    size = 30
    while True:
        rest = _LINE_END.split(text[end : end + size], maxsplit=1)
        after = _WORD.findall(rest[0])
        if len(rest) > 1 or end + size >= len(text) or len(after) > 1:
            break
        size *= 2
    left = [re.sub(r"\d+", "9", w.lower()) for w in words[-2:]]
    right = [re.sub(r"\d+", "9", w.lower()) for w in after[:1]]
    before = ["^"] * (2 - len(left)) + left
    return [f"B {before[1]} {right[0] if right else '$'}", *([f"L {before[0]} {before[1]}"] if left else [])]


def _mails(text: str):
    """Mail addresses: start, end, and the local part."""
    for at in _SIGN.finditer(text):
        a, b = at.start() - (text[at.start() - 1 : at.start()] == " "), at.end() + (text[at.end() : at.end() + 1] == " ")
        low = a
        while low and _LOCAL_PART.match(text[low - 1]):
            low -= 1
        domain = _DOMAIN.match(text, b) if low < a and _LOCAL.fullmatch(text, low, a) else None
        if domain and domain[1].lower() not in _TLD_NOT:
            yield low, domain.end(), text[low:a]


def _names(text: str, mails: list[tuple[int, str]]):
    """Name-shaped candidates, overlapping ones included, each with its words and how a mail near it is built from it: 2 from both words, 1 from one, 0 not."""
    for s in _START.finditer(text):
        for shape in (_FORWARD, _BACKWARD):
            m = shape.match(text, s.start())
            if not m:
                continue
            given, surname = fold(m["given"]), fold(m["surname"])
            if given in _TITLES or surname in _TITLES:
                continue
            near = mails[bisect_left(mails, (m.start() - NEAR, "")) : bisect_left(mails, (m.start() + NEAR, ""))]
            sure = len(surname) > 2 and any(surname in local or len(given) > 2 and local.startswith(given + "|") for _, local in near)
            both = sure and any(surname in local and (rest := local.replace(surname, "", 1).rstrip("|0123456789")) and (given in rest or given.startswith(rest)) for _, local in near)
            yield m.start(), m.end(), given, surname, sure + both


def _undisputed(names: list[tuple]) -> set[tuple[int, int]]:
    """Spans of names built into a mail that overlap no other name that is built into one as well or better."""
    built = [(a, b, grade) for a, b, _, _, grade in names if grade]
    out, end, group = set(), -1, []
    for x in [*built, None]:
        if x is None or x[0] >= end:
            out.update((a, b) for a, b, grade in group if not any(c < b and a < d and (c, d) != (a, b) and other >= grade for c, d, other in group))
            group = []
        if x:
            group.append(x)
            end = max(end, x[1])
    return out


def _written_form(kind: str, pii: str) -> str | None:
    """Which of the few forms known beforehand an item has, if any."""
    if kind == "phone":
        return "country code" if pii.startswith("+") else None
    if kind == "national_id":
        return "letters and digits" if _SURE_ID.fullmatch(pii) else None
    return None if _UNSURE_ADDRESS.search(pii) else "street and number"


def candidates(text: str) -> list[tuple]:
    """(kind, start, as written, given, surname, seed, terms, form) of all shapes in a text; ``seed`` counts for the terms beside it, ``form`` is a form known beforehand."""
    out: list[tuple] = []
    taken = bytearray(len(text))
    mails = []
    for a, b, local in _mails(text):
        mails.append((a, fold(re.sub(r"[+_].*$", "", local)) + ("|" if "+" in local else "")))
        taken[a:b] = b"\x01" * (b - a)
        out.append(("email", a, text[a:b], None, None, True, [], "local part and domain"))
    for kind, needs, shape in (("national_id", _SIX_DIGITS, NATIONAL_ID), ("address", _DIGIT, ADDRESS), ("phone", _NINE_DIGITS, PHONE)):
        for m in shape.finditer(text) if needs.search(text) else ():
            a, b = m.span()
            if kind == "phone" and (b - a < 9 or not 9 <= sum(c.isdigit() for c in re.split(r"ext|x|poste|Durchw", m[0])[0]) <= 15):
                continue
            if taken.find(1, a, b) >= 0:
                continue
            if kind == "address" and text[b - 1] == "." and _ends_sentence(text, a, b):
                b -= 1
            form = _written_form(kind, m[0])
            out.append((kind, a, text[a:b], None, None, form is not None, _around(text, a, b), form))
            if form or kind == "national_id":
                taken[a:b] = b"\x01" * (b - a)
    names = [x for x in _names(text, mails) if taken.find(1, x[0], x[1]) < 0]
    kept = _undisputed(names)
    for a, b, given, surname, grade in names:
        out.append(("person", a, text[a:b], given, surname, grade > 0, _around(text, a, b), "built into a mail" if (a, b) in kept else None))
    return out


def _ends_sentence(text: str, start: int, end: int) -> bool:
    """Whether the point before ``end`` closes a sentence rather than an abbreviation: a new one or nothing follows, and no colon led in."""
    return bool(re.match(r"[^\S\r\n]*(?:[\r\n]|$)|[^\S\r\n]+[A-ZÀ-Þ]", text[end : end + 80])) and not re.search(r":[^\S\r\n]*$", text[max(0, start - 40) : start])


_SCHEMA = "kind string, start bigint, pii string, given string, surname string, seed boolean, terms array<string>, form string"
#: Rows of this kind hold in ``start`` how many words a batch of texts has.
_WORDS = "words"


def _scan(batches):
    for b in batches:
        keys, cols, words = [], [[] for _ in range(8)], 0
        for i, text in enumerate(b.column("text").to_pylist()):
            words += text.count(" ") + 1
            for row in candidates(text):
                keys.append(i)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        keys.append(None)
        for c, v in zip(cols, (_WORDS, words, None, None, None, False, [], None), strict=True):
            c.append(v)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keys, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "kind", "start", "pii", "given", "surname", "seed", "terms", "form"])


def base_rates(seen: DataFrame) -> DataFrame:
    """Per kind the rate of protected entities among all words, from the seeds: ``kind`` and ``base``; one row per kind."""
    total = F.greatest(F.sum(F.when(F.col("kind") == _WORDS, F.col("start"))), F.lit(1)).alias("n")
    counts = [F.count_if((F.col("kind") == k) & F.col("seed")).alias(k) for k in KINDS]
    rates = F.array(*[F.struct(F.lit(k).alias("kind"), F.least((F.col(k) + 1) / (F.col("n") + 2), F.lit(0.5)).alias("base")) for k in KINDS])
    return seen.agg(total, *counts).select(F.explode(rates).alias("x")).select("x.kind", "x.base")


def disclosing(seen: DataFrame, keys: list[str], base: DataFrame, least: float, known: float = 0.0) -> DataFrame:
    """Terms (``keys``, of which ``kind``) above the threshold: keys, ``bits`` they disclose, and their ``share`` of the information content.

    P(entity | term) is the share of seeds among the term's occurrences, smoothed by DOUBT occurrences at the base rate (and
    ``known`` seeds beforehand). Counts are combined before the shuffle, so a term of a third of all rows is no burden to one task.
    """
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("n_seed"))
    rated = counts.join(F.broadcast(base), "kind")  # one row per kind
    chance = (F.col("n_seed") + F.lit(known) + DOUBT * F.col("base")) / (F.col("n") + F.lit(known) + DOUBT)
    rated = rated.withColumn("bits", F.log2(chance / F.col("base"))).withColumn("share", F.col("bits") / -F.log2("base"))
    return rated.where(F.col("share") >= least).select(*keys, "bits", "share")


def find_personal(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """Personal information in each text: id, kind, start (from 0), pii as written.

    Kinds are person, email, phone, national_id and address. Every finding has a term whose disclosure exceeds the threshold
    of its kind: its written form, if that is known beforehand (of names built into one mail that overlap, the one with both
    words in it, if there is one alone); words that disclose names, in their places; or a term beside it. A name with one
    such word (or an initial) also needs a disclosing term beside it; with none, one that hardly ever stands beside
    anything else. Null and empty texts give no rows.
    """
    return _judged(df, id_col, text).select("id", "kind", "start", "pii")


def _judged(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """The findings, and of persons the ``words`` that alone disclose them."""
    src = df.select(id_col.alias("id"), text.alias("text")).where(F.col("text").isNotNull())
    every = write_out(spread(src).mapInArrow(_scan, f"id {src.schema['id'].dataType.simpleString()}, {_SCHEMA}"))
    base = write_out(base_rates(every))
    seen = every.where(F.col("kind") != _WORDS)

    # written forms known beforehand: some few a kind
    forms = disclosing(seen.where("form IS NOT NULL").select("kind", "form", F.lit(True).alias("seed")), ["kind", "form"], base, BESIDE_IT, known=SEED).select("kind", "form", F.lit(True).alias("formed"))

    # words of names by place, from names beside a mail address; a form that occurs often is judged once
    people = seen.where("kind = 'person'")
    words = people.select("kind", "seed", F.explode(F.array(F.struct(F.lit("given").alias("place"), F.col("given").alias("word")), F.struct(F.lit("surname").alias("place"), F.col("surname").alias("word")))).alias("w")).select("kind", "w.place", "w.word", "seed")
    named = disclosing(words.where(F.length("word") > 1), ["kind", "place", "word"], base, WORD_OF_NAME)
    given = named.where("place = 'given'").select(F.col("word").alias("given"), F.col("bits").alias("given_bits"))
    surname = named.where("place = 'surname'").select(F.col("word").alias("surname"), F.col("bits").alias("surname_bits"))
    called = people.select("given", "surname").distinct().join(given, "given", "left").join(surname, "surname", "left")
    initial = F.length("given") == 1
    both = F.col("surname_bits").isNotNull() & (F.col("given_bits").isNotNull() | initial)
    one = F.col("surname_bits").isNotNull() | F.col("given_bits").isNotNull() | initial
    told = F.array_compact(F.array(F.when(F.col("given_bits").isNotNull(), F.col("given")), F.when(F.col("surname_bits").isNotNull(), F.col("surname"))))
    called = called.where(one).select(F.concat_ws("|", "given", "surname").alias("key"), both.alias("both"), told.alias("words"))

    rows = seen.join(F.broadcast(forms), ["kind", "form"], "left").select("id", "kind", "start", "pii", "seed", "terms", "formed", F.when(F.col("kind") == "person", F.concat_ws("|", "given", "surname")).alias("key"))
    persons = write_out(split_join(rows.where("kind = 'person'"), called, "key", "left").drop("key"))
    numbers = rows.where("kind <> 'person'").drop("key").withColumn("words", F.lit(None).cast("array<string>"))

    # what stands beside candidates, counted with the names whose both words disclose: which kind, and the term
    beside = persons.select("kind", "terms", (F.col("seed") | F.coalesce("both", F.lit(False))).alias("seed")).unionByName(numbers.select("kind", "terms", "seed"))
    beside = beside.select("kind", "seed", F.explode("terms").alias("term"))
    contexts = disclosing(beside, ["kind", "term"], base, BESIDE_IT).select(F.concat_ws("|", "kind", "term").alias("key"), "share")
    columns = ["id", "kind", "start", "pii", "words"]
    unsure = persons.where("formed IS NULL AND (both IS NULL OR NOT both)").select(*columns, "terms", F.col("both").isNotNull().alias("known"))
    unsure = unsure.unionByName(numbers.where("formed IS NULL").select(*columns, "terms", F.lit(True).alias("known")))
    beside = unsure.select(*columns, "known", F.explode("terms").alias("term")).withColumn("key", F.concat_ws("|", "kind", "term"))
    led = split_join(beside, contexts, "key", "inner").where(F.col("known") | (F.col("share") >= ALONE))
    sure = numbers.where("formed").select(*columns).unionByName(persons.where("both OR formed").select(*columns))
    return _without_overlap(sure.unionByName(led.select(*columns).distinct()))


def _without_overlap(found: DataFrame) -> DataFrame:
    """Of candidates of one text that overlap, the one that starts first, the longer one first; texts bound each group."""
    item = F.struct("start", (-F.length("pii")).alias("neg"), "kind", "pii", "words")
    group = found.groupBy("id").agg(F.sort_array(F.collect_set(item)).alias("all"))
    empty = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start:bigint,kind:string,pii:string,words:array<string>>>").alias("kept"))
    kept = F.aggregate(
        "all", empty,
        lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((x["start"] - x["neg"]).cast("bigint").alias("end"), F.concat(acc["kept"], F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["pii"].alias("pii"), x["words"].alias("words")))).alias("kept"))).otherwise(acc),
    )["kept"]
    return group.select("id", F.explode(kept).alias("x")).select("id", "x.kind", "x.start", "x.pii", "x.words")


_NAME_WORD = re.compile(_CAP)


def _replaced(batches):
    """Texts with their findings generalised, and without single words that disclose a person found in them."""
    for b in batches:
        texts, counts = [], []
        for text, spans, words in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "words")), strict=True):
            counts.append(len(spans or ()))
            if not spans:
                texts.append(text)
                continue
            alone = set(words or ())
            out, at = [], 0
            for x in [*spans, {"start": len(text), "n": 0, "kind": None}]:
                between = text[at : x["start"]]
                out.append(_NAME_WORD.sub(lambda m: "[NAME]" if fold(m[0]) in alone else m[0], between) if alone else between)
                out.append(f"[{x['kind'].upper()}]" if x["kind"] else "")
                at = x["start"] + x["n"]
            texts.append("".join(out))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["id", "n_found", "text"])


def sanitize(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """id, n_found and the text without what discloses; null texts stay null.

    Each finding is generalised to its kind in brackets. Where a person is found, words of the name whose disclosure exceeds
    the threshold are removed wherever else they stand alone in that text, ``[NAME]`` marking the place; other words stay. Ids
    must be unique, as findings are put back by them; the rest of the text is kept to the letter.
    """
    src = df.select(id_col.alias("id"), text.alias("text"))
    found = _judged(src, F.col("id"), F.col("text")).groupBy("id")
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", F.length("pii").alias("n")))).alias("spans")
    joined = src.join(found.agg(spans, F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")), "id", "left")
    return joined.mapInArrow(_replaced, f"id {src.schema['id'].dataType.simpleString()}, n_found bigint, text string")
