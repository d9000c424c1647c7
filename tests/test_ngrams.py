"""Frequent n-grams against plain counts."""

import numpy as np
import pyarrow as pa

from loomtext.operators import ngrams as N


def test_frequent_ngrams_equal_plain_counts(spark, monkeypatch):
    """Counts by hashed parts equal those of a plain loop, however texts fall into steps; rare n-grams are spared before the shuffle."""
    import random
    from collections import Counter

    rng = random.Random(5)
    words = ["a", "b", "é", "naïve", "x-y", "z_1", "日本", "rare"]
    texts = [" ".join(rng.choices(words, [8, 6, 5, 4, 3, 2, 2, 0.1], k=rng.randint(0, 40))) + rng.choice(["", "!", " \n"]) for _ in range(60)] + [None, "", "  ", "a", f"long {'w' * 300} tail"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    own = [(t or "").replace("!", " ").split() for t in texts]
    grams = [Counter(" ".join(t[i : i + n]) for i in range(len(t) - n + 1)) for t in own for n in (1, 2, 3)]
    f, d = sum(grams, Counter()), Counter(g for c in grams for g in c)
    for step in (1, 200, 4 << 20):
        monkeypatch.setattr(N, "STEP_BYTES", step)
        for least in (1, 5):
            got = {(r.ngram, r.ngram_length): (r.frequency, r.document_frequency) for r in N.frequent_ngrams(docs, "text", 3, least).collect()}
            assert {n: got.pop((None, n))[0] for n in (1, 2, 3)} == {n: sum(max(0, len(t) - n + 1) for t in own) for n in (1, 2, 3)}
            assert got == {(g, g.count(" ") + 1): (f[g], d[g]) for g in f if f[g] >= least}
    words = N._Words(pa.array(["a b a b c", "a b"]))
    (_, one), (two, live), _ = words.hashes(3, [np.full(16, np.iinfo(np.uint64).max, np.uint64)])
    assert one.all() and live.tolist() == [True, True, True, True, False, True] and two[0] == two[2] == two[5]
    bits = np.zeros(16, np.uint64)
    bits[(two[0] & np.uint64(1023)) >> np.uint64(6)] |= np.uint64(1) << (two[0] & np.uint64(63))
    three = words.hashes(3, [np.full(16, np.iinfo(np.uint64).max, np.uint64), bits])[2][1]
    assert three.sum() <= 1  # a b a needs b a too, which is not in the map


def test_frequent_ngrams_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.mutual_information(docs, "doc_id", "text").count() == 0
    assert N.mutual_information(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "doc_id", "text").count() == 0
