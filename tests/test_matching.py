"""Terms in texts, similar names and the packing of sentences, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from loomtext.operators import aspects as A
from loomtext.operators import chunking as C
from loomtext.operators import matching as M


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequences():
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(0, most)))
    a, b = [word(9) for _ in range(200)] + [word(200) for _ in range(60)] + ["a" * 64, "a" * 65, ""], [word(9) for _ in range(200)] + [word(200) for _ in range(60)] + ["a" * 128, "a" * 64, ""]
    assert M.common_subsequences(a, b).tolist() == [plain_subsequence(x, y) for x, y in zip(a, b)]


def test_similar_names_are_all_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abAb ") for _ in range(rng.randint(1, 14)))
    names = sorted({word() for _ in range(120)} | {"x" * 90 + word() for _ in range(5)})
    forms = sorted({word().lower() for _ in range(120)} | {"x" * 90 + word().lower() for _ in range(5)} | {""})
    left, right = spark.createDataFrame([(f,) for f in forms], "_form string"), spark.createDataFrame([(n,) for n in names], "_name string")
    for least in (60.0, 85.0, 97.0):
        want = {(f, n) for f in forms for n in names if f and 200 * plain_subsequence(f, n.lower()) / (len(f) + len(n)) >= least}
        got = M.similar_names(left, right, least).collect()
        assert {(r._form, r._name) for r in got} == want and len(got) == len(want) > 10
        assert all(abs(r._r - 200 * plain_subsequence(r._form, r._name.lower()) / (len(r._form) + len(r._name))) < 1e-9 for r in got)


def test_terms_in_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "a", "B", "c++", " ", ", ", "é", "\n", "node.js", "\U0001f600"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "İab ab"]
    terms = ["a", "ab", "ab a", "bc", "é", "c++", "node.js", "zz", "", " ", "İ", "ab é"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k long, t string, term string").repartition(3)
    vocab = spark.createDataFrame([("s", t) for t in terms] + [("s", "AB"), ("u", "ab")], "aspect string, term string")
    low = {r.k: r.l for r in docs.select("k", F.lower("t").alias("l")).collect()}
    lowered = {r.term: r.l for r in vocab.select("term", F.lower("term").alias("l")).collect()}
    names = {("s", lowered[t]) for t in terms} | {("u", "ab")}
    want = {(k, a, t, (low[k] or "").index(t) + 1) for k in low for a, t in names if t and t in (low[k] or "")}
    for most in (M.AUTOMATON, 7):
        got = M.term_hits(docs, "k", "t", vocab.select(F.lower("term").alias("term")), most=most)
        assert {(r.k, r.term, r.pos) for r in got.collect()} == {(k, t, p) for k, _, t, p in want}
    hits = A.vocabulary_hits(docs, "k", "t", vocab, "substring").collect()
    assert {(r.k, r.aspect, r.term, r.pos) for r in hits} == want and len(hits) == len(want)
    assert {r.value for r in hits if (r.aspect, r.term) == ("s", "ab")} == {"AB"}

    word = re.compile(r"\.?\w(?:[\w+#]|[.\-/&](?=\w))*")
    own = {k: [(m[0], m.start()) for m in word.finditer(t or "")] for k, t in enumerate(texts)}
    want = set()
    for k, found in own.items():
        for a, t in {("s", lowered[t]) for t in terms if word.search(lowered[t])} | {("u", "ab")}:
            form = word.findall(t)
            for i in range(len(found) - len(form) + 1):
                some = found[i : i + len(form)]
                if " ".join(x for x, _ in some).lower() == " ".join(form):
                    end = some[-1][1] + len(some[-1][0])
                    want.add((k, a, t, " ".join(x for x, _ in some), i, texts[k][max(0, some[0][1] - 30) : end + 30].strip()))
                    break
    hits = A.vocabulary_hits(docs, "k", "t", vocab).collect()
    assert {(r.k, r.aspect, r.term, r.value, r.pos, r.evidence) for r in hits if "İ" not in (texts[r.k] or "")} == {x for x in want if "İ" not in (texts[x[0]] or "")}
    assert len(hits) == len({(r.k, r.aspect, r.term) for r in hits})
    none = spark.createDataFrame([], "aspect string, term string")
    assert A.vocabulary_hits(docs, "k", "t", none).count() == A.vocabulary_hits(docs, "k", "t", none, "substring").count() == 0


def test_evidence_of_rules(spark):
    text = "x" * 100 + " remote-first " + "y" * 100 + " hybrid work " + "z" * 50
    r = spark.createDataFrame([(text,), ("hybrid cloud",), ("",)], "t string").select(A.around(F.col("t"), r"\bremote[- ]first\b", 5).alias("e"), A.remote_policy(F.col("t")).alias("p")).collect()
    assert r[0].e == "xxxx remote-first yyyy" and r[1].e is r[2].e is None
    assert [p.value for p in r[0].p] == ["remote"] and r[1].p == [] and r[2].p == []


def plain_windows(sents, limit):
    out, buf = [], ""
    for x in sents:
        if buf and len(buf) + 1 + len(x) > limit:
            out.append(buf)
            buf = ""
        buf = f"{buf} {x}" if buf else x
    return out + [buf] if buf else out


def test_windows_and_bullets_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(4)
    lists = [["x" * rng.choice([1, 5, 30, 200]) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(lists)], "k long, s array<string>")
    for fold in (1000, 3):
        monkeypatch.setattr(C, "FOLD", fold)
        for limit in (1, 90):
            got = {r.k: r.w for r in df.select("k", C.windows(F.col("s"), limit).alias("w")).collect()}
            assert got == {k: plain_windows(s, limit) for k, s in enumerate(lists)}
    lines = [["- a", "b", "c", "* dd e", "1. long one", "more"], ["x", "- y"], ["none"], []]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(lines)], "k long, s array<string>")
    got = [r.b for r in df.orderBy("k").select(C._bullets(F.col("s")).alias("b")).collect()]
    assert got == [["a b c", "dd e", "long one more"], [], [], []]


def test_a_long_document_is_packed_in_linear_time(spark):
    text = " ".join(f"Sentence number {k} has words." for k in range(100_000))
    got = [r.text for r in C.chunks(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("order").collect()]
    parts = plain_windows(re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text), C.WINDOW)
    assert got == [parts[0]] + [f"{a[-C.OVERLAP :]} {b}".strip() for a, b in zip(parts, parts[1:])]
