"""Golden values and properties of the analytics operators."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import predicates as P
from loomtext.functions import text as T
from loomtext.operators import cluster as K
from loomtext.operators import context as X
from loomtext.operators import labels as L
from loomtext.operators import ngrams as N
from loomtext.operators import search as S
from loomtext.operators import tfidf as W
from loomtext.operators.profiles import function_word_language
from loomtext.streaming.rows import tagged


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_boolean_queries(spark):
    rows = [("Data Engineer with Python",), ("spark",), ("python only",), ("a b",), (None,), ("rock and b roll",)]
    df = spark.createDataFrame(rows, "t string")
    hits = lambda q: [r.t for r in df.filter(P.boolean_match(F.col("t"), q)).collect()]
    assert hits('("data engineer" AND python) OR spark') == ["Data Engineer with Python", "spark"]
    assert hits("a AND NOT b") == ["Data Engineer with Python", "spark"]
    assert hits("python data") == ["Data Engineer with Python"]  # side by side means AND, unlike the reference
    assert hits('"and"') == ["rock and b roll"]  # a quoted operator is a term, unlike the reference
    assert hits("") == [] and hits("NOT NOT spark") == ["spark"]
    for bad in ("(python", "python)", "AND x", "x OR", "()"):
        with pytest.raises(P.QueryError):
            P.boolean_match(F.col("t"), bad)
    assert P.search_terms('python OR "data engineer" OR Python') == ["data engineer", "python"]


def test_text_goldens(spark):
    r = one(spark, T.token_estimate(F.lit("")).alias("a"), T.token_estimate(F.lit("abcd")).alias("b"), T.citations(F.lit("x [2] [10][2]")).alias("c"), T.cited(F.array(*map(F.lit, "abc")), F.array(F.lit(9))).alias("d"), T.cited(F.array(*map(F.lit, "abc")), F.array(F.lit(2), F.lit(7))).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (1, 2, [2, 10], ["a", "b", "c"], ["b"])
    fence = "Sure:\n```json\n{\"a\": 1}\n```\n"
    r = one(spark, T.fenced_json(F.lit(fence), "a int").alias("x"), T.fenced_json(F.lit('{"a": 2}'), "a int").alias("y"), T.fenced_json(F.lit("no"), "a int").alias("z"))
    assert r.x.a == 1 and r.y.a == 2 and (r.z is None or r.z.a is None)
    r = one(spark, T.html_to_line(F.lit("<p>a&nbsp;&lt;b</p><script>x</script> c  d")).alias("x"), T.keyword_tokens(F.lit("The C++ node.js thing. is")).alias("y"), T.ngrams(F.array(F.lit("a")), 2).alias("z"))
    assert (r.x, r.z) == ("a <b c d", []) and r.y == ["node.js", "thing"]


def test_intents_and_tiers(spark):
    want = {"Find Python jobs": ("search", 0.7), "Compare these": ("compare", 0.7), "What kinds of AI roles exist": ("explore", 0.7), "Tell me about this": ("detail", 0.7), "hello": ("search", 0.5)}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", P.intent(F.col("t")).alias("i"))
    assert {r.t: (r.i.intent, r.i.confidence) for r in df.collect()} == want
    cases = [("search", 11, 0), ("search", 10, 1), ("explore", 5, 0), ("compare", 3, 2), ("compare", 4, 1), ("detail", 1, 3), ("general", 1, 1)]
    df = spark.createDataFrame(cases, "i string, n int, want int").withColumn("got", P.context_tier(F.col("i"), F.col("n")))
    assert df.filter("got <> want").count() == 0


def test_ngram_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "k long, t string")
    got = {r.ngram: (r.frequency, r.document_frequency) for r in N.corpus_ngrams(df, "k", "t", 1, 2).collect()}
    assert got == {"a": (2, 1), "b": (2, 2), "c": (1, 1), "a b": (1, 1), "b a": (1, 1), "b c": (1, 1)}


def test_statistics_goldens(spark):
    log_words = math.log2(4 / 12) + math.log2(5 / 12)
    f, n = F.lit(3.0), F.lit(10.0)
    mi = N.pmi(f, n, F.lit(log_words), F.lit(False))
    r = one(spark, F.round(mi, 6).alias("mi"), F.round(N.npmi(f, n, mi), 6).alias("npmi"), F.round(N.effect_size(*map(F.lit, (8, 100, 2, 200))), 6).alias("e"), F.round(N.g_statistic(*map(F.lit, (8, 100, 2, 200))), 6).alias("g"), N.g_statistic(*map(F.lit, (8, 100, 0, 200))).alias("g0"), F.round(N.p_value(F.lit(9.532360)), 6).alias("p"))
    assert (r.mi, r.npmi, r.e, r.g, r.g0, r.p) == (1.111031, 0.639639, 2.758375, 9.53236, 0.0, 0.002019)


def test_zscores(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0), ("d", 1.0), ("d", None), ("d", 3.0)]
    got = N.window_zscore(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(None if r.v_z is None else round(r.v_z, 6))
    order = lambda x: sorted(x, key=lambda v: (v is None, v))
    assert {k: order(v) for k, v in by.items()} == {"a": [-1.224745, 0, 1.224745], "b": [5.0], "c": [0.0, 0.0], "d": [-1.0, 1.0, None]}


def test_phrase_filters(spark):
    rows = [("a b", 2, 5, 3, None, 0.1, True), ("c d", 2, 5, 3, -1.0, 0.1, True), ("e", 1, 9, 9, 1.0, 1.0, True), ("f g", 2, 5, 3, 1.0, None, None), ("h i", 2, 5, 1, 1.0, 1.0, True), ("j k", 2, 5, 3, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "ngram string, ngram_length int, frequency long, document_frequency long, mi_z double, effect_size double, significant boolean")
    assert sorted(r.ngram for r in N.meaningful(df).collect()) == ["a b", "f g"]
    assert [r.ngram for r in N.filter_by_words(df, allowed=["a", "b", "x"]).collect()] == ["a b"]
    scores = spark.createDataFrame([("a b", 0.5, None), ("c d", None, 2.0)], "ngram string, npmi double, effect_size double")
    pick = lambda lo: sorted(r.ngram for r in N.whitelist(df.select("ngram"), scores, (lo, 1.0), (0.0, 5.0)).collect())
    assert pick(0.1) == ["a b"] and len(pick(0.9)) == 6


def test_class_tfidf_prefers_whitelisted_terms(spark):
    docs = spark.createDataFrame([(0, "apple pear pear plum kiwi kiwi kiwi"), (1, "stone rock rock sand"), (-1, "noise")], "c int, t string")
    phrases = spark.createDataFrame([("ripe plum",), ("apple pear",)], "ngram string")
    got = {}
    for r in W.class_tfidf(docs, "c", "t", 4, phrases=phrases).orderBy("c", "rank").collect():
        got.setdefault(r.c, []).append(r.term)
    assert set(got) == {0, 1} and len(got[1]) == 2
    assert {"plum", "apple", "pear"} & set(got[0]) and len(set(got[0]) - {"plum", "apple", "pear", "apple pear"}) <= 2


def test_hybrid_goldens(spark):
    v = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.5)], "query_id int, k string, score double")
    b = spark.createDataFrame([(1, "B", 4.0), (1, "C", 2.0)], "query_id int, k string, bm25 double")
    got = [(r.k, round(r.score, 6)) for r in S.hybrid(v, b, "query_id", "k").orderBy("rank").collect()]
    assert got == [("B", 0.725), ("A", 0.495), ("C", 0.225)]


def test_budgets_and_rerank(spark):
    rows = spark.createDataFrame([(1, k, 10 * k) for k in range(1, 5)], "q int, rank int, cost int")
    assert [r["rank"] for r in S.within_budget(rows, "q", "rank", F.col("cost"), 30).orderBy("rank").collect()] == [1, 2]
    assert [r["rank"] for r in S.within_budget(rows, "q", "rank", F.col("cost"), 5, True).collect()] == [1]
    scores = spark.createDataFrame([(1, 3, 0.9)], "q int, cost int, relevance double").withColumn("cost", F.col("cost") * 10)
    assert [r.cost for r in S.reranked(rows, scores, "q", "cost", 2).orderBy("rank").collect()] == [30, 10]
    assert S.reranked(rows, None, "q", "cost", 2).count() == 2


def test_row_predicates(spark):
    rows = spark.createDataFrame([(1, k, float(k), "ab"[k % 2]) for k in range(6)], "q int, k int, s double, lang string")
    for where in (F.col("lang") == "a", lambda r: r["lang"] == "a"):
        keep = S.condition(where, ["lang"])
        assert [r.k for r in S.filtered(rows, keep, "q", "k", "s", 2).orderBy("rank").collect()] == [4, 2]
        assert [r.k for r in S.filtered(rows, keep, "q", "k", "s", 2, "post", 2).collect()] == [4]


def test_folded_turns(spark):
    df = spark.createDataFrame([(10, 0), (11, 6), (16, 6), (17, 12)], "t int, want int")
    assert df.filter(X.folded(F.col("t")) != F.col("want")).count() == 0
    turns = [(1, k, ("user", "assistant", "system")[k % 3], f"see https://x/{k % 4}") for k in range(11)]
    r = X.memory(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert r.folded == 6 and len(r.recent) == 5 and r.summary.split("\n")[0] == "User asked: see https://x/0" and len(r.summary.split("\n")) == 4
    assert r.urls == [f"https://x/{k}" for k in range(4)]


def test_label_store(spark):
    log = spark.createDataFrame([(1, "a", "x", "add"), (2, "a", "x", "remove"), (3, "a", "y", "add"), (4, "b", "x", "add")], "seq long, job_id string, label string, action string")
    labels = L.fold_actions(log)
    assert sorted(map(tuple, labels.collect())) == [("a", "y"), ("b", "x")]
    assert L.add(labels, labels).count() == 2
    assert L.remove(labels, labels.filter("job_id = 'a'")).count() == 1
    lists = spark.createDataFrame([("a", ["x", "x"]), ("b", [])], "job_id string, labels array<string>")
    assert L.replaced(lists).count() == 1


def test_clusters(spark):
    rows = [(k, float(k % 2 * 10 + (k * 7 % 5) / 10), float((k * 3 % 7) / 10)) for k in range(80)] + [(99, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    found = K.grid_density(df, min_cluster_size=5, min_samples=3)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster_id, set()).add(r.k)
    assert groups[-1] == {99} and len(groups) == 3
    hull = {r.cluster_id: r.path for r in K.hulls(found).collect()}
    assert set(hull) == {0, 1}
    for c, path in hull.items():
        for k in groups[c]:
            x, y = rows[k][1:]
            turn = [(path[i][0] - path[i - 1][0]) * (y - path[i - 1][1]) - (path[i][1] - path[i - 1][1]) * (x - path[i - 1][0]) for i in range(len(path))]
            assert min(turn) > -1e-9
    assert K.auto_kmeans(df.filter("k < 1"), ["x", "y"]).first().cluster_id == 0
    best = K.auto_kmeans(df.filter("k < 99"), ["x", "y"], 20)
    assert best.select("cluster_id").distinct().count() == 2
    assert K.grid_density(df.filter("false")).count() == 0


def test_projection_is_the_leading_plane(spark):
    rows = [(k, [float(k), 2.0 * k, 0.0]) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    base = K.basis(df, "v")
    assert abs(base[1, 0] - 2 / 5**0.5) < 1e-9 and abs(base[:, 1]).max() == 0
    got = K.projected(df, "v", base).filter("k = 5").first()
    assert abs(got.x - 5 * 5**0.5) < 1e-9 and got.y == 0
    assert K.aspect_features(spark.createDataFrame([(1, "a"), (2, "a")], "k long, value string"), "k", 2) is None
    many = spark.createDataFrame([(k, f"v{j:02d}") for k in range(6) for j in range(k, k + 9)] + [(0, None), (1, "v01")], "k long, value string")
    wide = {r.k: list(r.embedding) for r in K.aspect_features(many, "k", 6).collect()}
    assert wide == {k: [float(k <= j < k + 9) for j in range(14)] for k in range(6)}
    hashed = {r.k: list(r.embedding) for r in K.aspect_features(many, "k", 6, most=4).collect()}
    assert all(len(v) == 4 and sum(v) == 9 for v in hashed.values())


def test_languages_by_function_words(spark):
    df = spark.createDataFrame([(1, "the cat is on the mat and that is all"), (2, "le chat est dans la maison avec une souris"), (3, "short"), (4, None)], "k long, t string")
    assert {r.k: r.lang for r in function_word_language(df, "k", "t").collect()} == {1: "en", 2: "fr", 3: "unknown", 4: "unknown"}


def test_streams_take_the_same_columns(spark, tmp_path):
    rows = spark.createDataFrame([("Fluent in Dutch, fully remote",), (None,)], "text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = tagged(spark.readStream.schema("text string").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("tagged_rows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("tagged_rows").collect())) == sorted(map(str, tagged(rows).collect()))

def test_grid_cells_follow_the_data(spark):
    """The same two groups with thin rows between them come apart at ten times the rows, too, and far rows change nothing."""
    import random

    rng = random.Random(3)

    def rows(n):
        near = [(rng.gauss(c, 0.1), rng.gauss(0, 0.1)) for c in (0, 5) for _ in range(n)]
        return near + [(rng.uniform(1, 4), rng.uniform(-2, 2)) for _ in range(n // 20)] + [(1e6, 1e6), (float("nan"), 0.0), (None, 1.0)]

    for n in (200, 2000):
        df = spark.createDataFrame(rows(n), "x double, y double").repartition(3)
        found = K.grid_density(df)
        sizes = {r["cluster_id"]: r["count"] for r in found.groupBy("cluster_id").count().collect()}
        assert set(sizes) >= {-1, 0, 1} and sizes[0] + sizes[1] > 1.8 * n and sum(sizes.values()) == df.count()
        assert found.filter("cluster_id in (0, 1)").filter("abs(x) > 1.5 and abs(x - 5) > 1.5").count() == 0
        assert found.filter("x is null or isnan(x) or x > 100").filter("cluster_id <> -1").count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 55), (7, 7)]
    got = dict(map(tuple, K.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(2, 41)} | {55: 50, 60: 50}
