"""Alignment, fingerprints and manifests against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from loomtext.llm import alignment, fingerprints, manifest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["  two  blanks   here ", " x  y z　 w", "a▁b", "don't 'tis  's x'll", "tab\t x \n\n y\r\n z", "<s> </s> <unk> <0x41> x", "é caf\xe9 \xd7\xf7 a \xe9t\xe9", "\U0001f600 \U0001f469‍\U0001f469 ok", "(a) [b] {c}... !? --", "x" * 3000 + " y", " lead", "trail ", " ", "12 3456 7.8e9", "\x00 \x01 a"]
CLASH = "doc_id long, text string, batch long, n long, tree string, id string, key string, lang string, source string, n_chars long"


def table(spark, texts, lang="en"):
    rows = [(None if k == 2 else k, t, 1, 2, "t", "i", "k", None if k % 5 == 0 else f"l{k % 3}", f"s{k % 2}", None if k == 4 else len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], CLASH).repartition(3)


def plain_ids(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = alignment.byte_names()
    for t in texts:
        if not t:
            yield [], []
            continue
        x = a.encode(" " + t, add_special_tokens=False).ids
        y = b.encode(t)
        bx = [bytes(names[c] for c in a.id_to_token(k)) if k != 50256 else b"" for k in x]
        by = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        same = b"".join(bx) == b"".join(by) == (" " + t).encode()
        yield (list(zip(x, map(len, bx))), list(zip(y, map(len, by)))) if same else ([], [])


def plain_alignment(texts):
    """Groups, links of each text."""
    for x, y in plain_ids(texts):
        groups, links, i, j, ea, eb, ga, gb = [], [], 0, 0, 0, 0, [], []
        spans_a, spans_b = [], []
        for spans, ids in ((spans_a, x), (spans_b, y)):
            at = 0
            for k, n in ids:
                spans.append((at, at + n, k))
                at += n
        for s, e, k in spans_a:
            while j < len(spans_b) and spans_b[j][1] <= s:
                j += 1
            m = j
            while m < len(spans_b) and spans_b[m][0] < e:
                links.append((k, spans_b[m][2]))
                m += 1
        cuts = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
        before = 0
        for c in cuts:
            groups.append(",".join(str(k) for s, e, k in spans_a if before <= s and e <= c) + "|" + ",".join(str(k) for s, e, k in spans_b if before <= s and e <= c))
            before = c
        yield len(x), len(y), groups, links


@pytest.fixture(scope="module")
def hard(texts):
    rng = random.Random(5)
    alphabet = ["the", "Thing", " ", "  ", "\n", ".", ",", "'s", "\xe9", "9", "zz", " of", " and", " ", "▁", "\U0001f600", "\t"]
    return [t[:4000] if t else t for t in texts] + ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(120)] + [" ".join(rng.choice(["tion", "ering", "whale", "st."]) for _ in range(3000))]


def test_alignment(spark, hard):
    df = table(spark, hard)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    told = {t: x for t, x in zip({t for _, t in rows}, plain_alignment({t for _, t in rows}))}
    counts = Counter(link for _, t in rows for link in told[t][3])
    most = {}
    for (a, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    want = Counter()
    for k, t in rows:
        n_a, n_b, groups, links = told[t]
        text = ";".join(groups)
        want[k, n_a, n_b, len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if groups else "", sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)] += 1
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in alignment.alignment(df, A, B).collect())
    assert got == want
    assert sum(k[1] > 0 for k in want) > 100 and sum(k[1] == 0 for k in want) > 5
    whole = alignment.aligned(df, A, B).collect()
    assert Counter((r.doc_id, r.groups, len(r.a), len(r.b)) for r in whole) == Counter((k, ";".join(told[t][2]), told[t][0], told[t][1]) for k, t in rows)


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.alignment(df, A, B).collect()) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
    assert alignment.alignment(df.limit(0), A, B).count() == 0


def test_forgetting_keeps_results(spark, hard, monkeypatch):
    import pyarrow as pa

    both = alignment.Both(A, B)
    want = both.encode(pa.array(hard, pa.string()))
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    few = alignment.Both(A, B)
    for at in range(0, len(hard), 20):
        few.encode(pa.array(hard[at : at + 20], pa.string()))
    got = [few.encode(pa.array([t], pa.string())) for t in hard]
    assert [k for g in got for k in g[0].tolist()] == want[0].tolist() and [k for g in got for k in g[1].tolist()] == want[1].tolist()


def plain_fingerprint(text):
    pieces = [p for p in re.split(r"\n+|[.,;:!?] +", text) if p]
    lanes = [0] * 256
    for p in pieces:
        h = bytes.fromhex(hashlib.sha256(p.encode()).hexdigest())
        for q in range(4):
            x = int.from_bytes(h[8 * q : 8 * q + 8], "big")
            for b in range(64):
                lanes[(16 * q + b % 16) * 4 + b // 16] += x >> b & 1
    words = [sum((lanes[4 * k + i] % 65536) << 16 * i for i in range(4)) for k in range(64)]
    return f"{len(pieces)}:" + "".join(f"{w:016x}" for w in words), [2 * c - len(pieces) for c in lanes]


def plain_likeness(p, q):
    x, y = sum(a * a for a in p), sum(a * a for a in q)
    return float(x == y) if not x or not y else max(0.0, min(1.0, round(sum(a * b for a, b in zip(p, q)) / (x * y) ** 0.5, 6)))


def test_fingerprints(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["erst", "anly", "tion", "\xe9t\xe9", "\U0001f600", "wh"]) for _ in range(rng.randint(1, 9))) + rng.choice([". ", ", ", "\n", "\n\n"])
    texts = [None, "", " ", "a", "ab. ", "\n\n"] + ["".join(sentence() for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["twice"] * 2
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], "doc_id long, text string, id long, key string, n_chars string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.edits(df).withColumns({"f": fingerprints.as_text(F.col("own")), "g": fingerprints.as_text(F.col("altered"))}).collect()}
    assert len(got) == len(texts)
    for k, t in rows:
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        (f, p), (g, q), (_, r) = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        assert (got[k].n_chars, got[k].edited, got[k].f, got[k].g) == (n, edited, f, g)
        assert abs(got[k].near_edited - plain_likeness(p, q)) < 2e-6 and abs(got[k].near_next - plain_likeness(p, r)) < 2e-6
    assert got[36].near_next == 1.0


def test_fingerprints_add_up(spark):
    x, y = "one. two. two. three\nfour", "two. five"
    df = spark.createDataFrame([(x, y, "two. five. one. three. two\ntwo. four" + "", "p. " * 70000)], "x string, y string, xy string, many string")
    made = {c: fingerprints.fingerprint(F.col(c)) for c in ("x", "y", "xy", "many")}
    df = df.select(*[v.alias(c) for c, v in made.items()])
    plus, minus = fingerprints.plus(F.col("x"), F.col("y")), fingerprints.minus(F.col("xy"), F.col("y"))
    more = fingerprints.minus(fingerprints.plus(F.col("many"), F.col("xy")), F.col("many"))
    r = df.select(*[fingerprints.as_text(c).alias(n) for n, c in (("sum", plus), ("whole", F.col("xy")), ("left", minus), ("x", F.col("x")), ("again", more), ("many", F.col("many")))]).first()
    assert r["sum"] == r["whole"] == r["again"] and r["left"] == r["x"]
    assert r["many"] == plain_fingerprint("p. " * 70000)[0]


def test_fingerprint_edge_tables(spark):
    one = spark.createDataFrame([(None, "a. b")], "doc_id long, text string")
    assert [(r.edited, r.near_next) for r in fingerprints.edits(one).collect()] == [("a.a.", 1.0)]
    assert fingerprints.edits(one.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a. b"), (1, "a. b"), (1, "c"), (None, "q")], "doc_id long, text string")
    assert fingerprints.edits(again).count() == 4


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings_of(levels, at):
    out = []
    for level in levels[:-1]:
        out += [level[at ^ 1]] if at ^ 1 < len(level) else []
        at //= 2
    return out


@pytest.mark.parametrize("levels", [2, 12])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    texts = [None, "", "\xe9", "same", "same"] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = table(spark, texts)
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, manifest.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text")).otherwise(manifest.leaf("doc_id", "source", "lang", "n_chars", "text"))
    got = manifest.manifest(df, shown=shown, levels=levels).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: manifest.digest(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), leaf(r, 1)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree_of([trees[g][-1][0] for g in order])
    want = Counter()
    for g in order:
        for at, (known, k, own, other) in enumerate(sorted(groups[g])):
            proof = siblings_of(trees[g], at) + siblings_of(top, order.index(g))
            bad = known and zlib.crc32(str(k).encode()) % 7 == 0 and other != own
            want[k if known else None, own, trees[g][-1][0], top[-1][0], "".join(proof), not bad] += 1
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, "".join(r.siblings), r.verified) for r in got) == want
    assert all((r.folded_root == r.root) == r.verified for r in got) and any(not r.verified for r in got)


def test_multiproofs_of_some_leaves(spark):
    leaves = [(None, "t", k, hashlib.sha256(b"%d" % k).hexdigest()) for k in range(45)]
    df = manifest.placed(spark.createDataFrame([(t, k, d, d) for _, t, k, d in leaves], "tree string, order long, leaf string, shown string"))
    nodes = manifest.tree_nodes(df.select("tree", "place", "total", F.col("leaf").alias("digest")), 45, every=True, levels=3)
    levels = tree_of([d for *_, d in leaves])
    assert nodes.count() == sum(map(len, levels)) and manifest.subroots(nodes).first()["subroot"] == levels[-1][0]
    asked = [0, 1, 5, 8, 9, 10, 11, 44]
    got = manifest.prove(df.filter(F.col("place").isin(asked)), nodes, 3).collect()
    assert sorted(r.order for r in got) == asked and {r.folded for r in got} == {levels[-1][0]}
    for r in got:
        assert [s.digest for s in r.path if s.digest] == siblings_of(levels, r.order)
    # fewest: no missing node can be derived from the leaves and other missing ones
    need = manifest.missing(asked, manifest.levels_of(45))
    assert len(need) == len(set(need)) and (0, 0) not in need and (1, 4) not in need and (1, 5) not in need


def test_manifest_edge_tables(spark):
    one = spark.createDataFrame([(5, "s", None, 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    r = manifest.manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.siblings == [] and r.verified
    assert manifest.manifest(one.limit(0)).count() == 0
