import random

import corpus_pipeline
from loomtext.llm import common

from .test_operators import edited, prose, windows_brute


def test_stages_decide_and_keep_the_columns(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, prose(rng, 60), "en", f"s{k % 4}", 1) for k in range(40)]
    item = prose(rng, 30)
    rows += [(50, edited(rng, rows[0][1], 1), "en", "s1", 1), (51, rows[1][1], "de", "s2", 1), (52, item + " " + prose(rng, 20), "en", "s1", 1)]
    rows += [(53, "123 456", "en", "s1", 1), (54, None, "en", "s1", 1), (55, "token=abcdef12345 " + prose(rng, 50), "en", "s3", 1), (None, prose(rng, 40), None, None, None), rows[2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert name == "packing" or docs.columns == columns
        seen.append(sorted((-1 if r.doc_id is None else r.doc_id for r in docs.select("doc_id").collect())))
    clean = [-1, *range(40), 55]
    assert seen[0] == sorted([*clean, 2, 50, 51, 52])
    assert seen[1] == sorted([*clean, 52])
    assert seen[2] == clean and seen[3] == clean
    assert sorted(set(seen[4])) == clean
    assert windows_brute([(52, rows[42][1])], [(1, item)])[52, rows[42][1]][4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_five_words_and_four_fifths(spark):
    def words(a, b):
        return [f"w{k}" for k in range(a, b)]

    def similarity(x, y, size):
        a, b = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (x, y))
        return len(a & b) / len(a | b)

    base, long = words(0, 100), words(1000, 1200)
    scattered = [f"e{k}" if k % 40 == 20 else w for k, w in enumerate(long)]
    copies = [[*base, *words(200, 222)], base[:82], [*base[:47], *words(300, 306), *base[53:]]]
    assert all(0.8 <= similarity(base, c, 5) and similarity(base, c, 3) < 0.85 for c in copies)
    assert similarity(long, scattered, 5) < 0.8 and similarity(long, scattered, 3) >= 0.85
    for copy in copies:
        rows = [(k, " ".join(w)) for k, w in enumerate([base, copy, long, scattered])]
        kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_a_value_that_its_only_owner_repeats_is_redacted(spark):
    own, copied = "q7RtW2mXz9LpK4sVb1", "EXAMPLEkey0123456789x"
    rows = [(k, f"see {own} in {k} and {copied}", "s1") for k in range(30)] + [(30, f"{copied} again", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert got == {k: t.replace(own, "[SECRET]") for k, t, _ in rows}


def test_an_id_with_two_texts_is_two_documents(spark):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (8, edited(rng, c, 1)), (9, d), (9, None), (9, None), (9, ""), (None, d), (None, d), (2, "x " * 40_000), (3, "x " * 40_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as copies", "3 as __rows", "'' as component_id")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    one_of_8 = [x for x in kept if x[0] == 8]
    assert len(one_of_8) == 1 and one_of_8[0] in rows
    want = [(1, a), (5, b), (9, d), (9, None), (9, ""), (None, d), (None, d), (2, "x " * 40_000)]
    assert sorted(kept, key=str) == sorted([*want, *one_of_8], key=str)
    assert corpus_pipeline.near_copies(spark, docs.filter("false"), "").count() == 0


def test_batches_of_texts_are_small(spark):
    reader, arrow = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    held = {k: spark.conf.get(k) for k in (reader, arrow)}
    try:
        spark.conf.set(reader, "4096")
        spark.conf.set(arrow, str(8 << 20))
        common.bounded_batches(spark)
        assert int(spark.conf.get(reader)) <= 512 and int(spark.conf.get(arrow)) <= 2 << 20
        spark.conf.set(reader, "100")
        common.bounded_batches(spark)
        assert spark.conf.get(reader) == "100"
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
