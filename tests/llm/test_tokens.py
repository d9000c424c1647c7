import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomtext.llm import tokens
from loomtext.llm.packing import pack, patterns
from loomtext.llm.token_counts import line_sections, section_tokens, shares
from loomtext.llm.token_files import read_token_files, write_token_files
from loomtext.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, start int, part string, cls int"


def frame(spark, texts):
    return spark.createDataFrame([(k if k != 7 else None, t, 0, "x", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def whole(vocabulary, texts):
    t = Tokenizer.from_file(vocabulary)
    return [t.encode(x or "", add_special_tokens=False) for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("remembered", [200_000, 50])
def test_encoder_equals_whole_encoding(vocabulary, texts, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    plain, enc = Encoder(vocabulary), Encoder(vocabulary, spans=True)
    for own in (texts, texts[:3], texts[3:5], [], *[texts[k : k + 7] for k in range(0, len(texts), 7)]):
        ids, off = plain.encode(pa.array(own, pa.string()))
        ids2, span, off2 = enc.encode_spans(pa.array(own, pa.string()))
        for k, e in enumerate(whole(vocabulary, own)):
            assert ids[off[k] : off[k + 1]].tolist() == e.ids, own[k]
            assert ids2[off2[k] : off2[k + 1]].tolist() == e.ids
            assert [tuple(x) for x in span[off2[k] : off2[k + 1]].tolist()] == e.offsets, own[k]


def test_encoder_of_words_of_every_latin_letter(vocabulary):
    rng = random.Random(11)
    letters = [chr(c) for c in range(33, 0x180) if chr(c).isalpha()]
    own = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(300)) for _ in range(5)]
    ids, off = Encoder(vocabulary).encode(pa.array(own))
    _, span, _ = Encoder(vocabulary, spans=True).encode_spans(pa.array(own))
    for k, e in enumerate(whole(vocabulary, own)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids
        assert [tuple(x) for x in span[off[k] : off[k + 1]].tolist()] == e.offsets


def test_a_vocabulary_of_other_rules_is_encoded_whole(texts):
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    ids, off = Encoder(other).encode(pa.array(texts, pa.string()))
    _, span, _ = Encoder(other, spans=True).encode_spans(pa.array(texts, pa.string()))
    for k, e in enumerate(whole(other, texts)):
        assert ids[off[k] : off[k + 1]].tolist() == e.ids, texts[k]
        assert [tuple(x) for x in span[off[k] : off[k + 1]].tolist()] == e.offsets


def test_files_round_trip(spark, vocabulary, texts):
    got = read_token_files(write_token_files(frame(spark, texts), vocabulary)).collect()
    ids = [e.ids + [2] for e in whole(vocabulary, texts)]
    want, at = [], 0
    for k in [7] + [k for k in range(len(texts)) if k != 7]:
        want.append((None if k == 7 else k, at, len(ids[k]), crc(ids[k])))
        at += len(ids[k])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = frame(spark, texts).filter("false")
    assert read_token_files(write_token_files(empty, vocabulary)).count() == 0


def test_packing_covers_every_id_once(spark, vocabulary, texts):
    rows = pack(frame(spark, texts), vocabulary, limit=512).collect()
    ids = [e.ids + [2] for e in whole(vocabulary, texts)]
    seen = {k: [] for k in range(len(texts))}
    room = {}
    for r in rows:
        k = 7 if r.doc_id is None else r.doc_id
        seen[k].append((r.start, r.length))
        assert r.ids_crc32 == crc(ids[k][r.start : r.start + r.length]) and r.doc_tokens == len(ids[k])
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in seen.items():
        at = 0
        for s, n in sorted(pieces):
            assert s == at and n > 0
            at += n
        assert at == len(ids[k])
    for pieces in room.values():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at <= 512
    total = sum(map(len, ids))
    assert len(room) <= 1.05 * total / 512 + 2
    assert pack(frame(spark, texts).filter("false"), vocabulary).count() == 0


def test_patterns_hold_the_demand_near_the_bound():
    rng = np.random.default_rng(1)
    demand = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True), strict=True)}
    plan = patterns(demand, 64)
    held = {}
    for n, p in plan:
        assert n > 0 and sum(k * c for k, c in p.items()) <= 64
        for k, c in p.items():
            held[k] = held.get(k, 0) + n * c
    assert held == demand
    least = sum(k * n for k, n in demand.items()) / 64
    assert sum(n for n, _ in plan) <= 1.02 * least + 2
    assert patterns({}, 64) == [] and patterns({3: 0}, 64) == []


def test_rules_for_crossing_tokens():
    span = np.array([[0, 2], [2, 5], [5, 9], [20, 22]])
    sections = np.array([[0, 3], [3, 6], [6, 10]])
    assert shares(span, sections, "majority")[1].tolist() == [0, 1, 2, -1]
    assert shares(span, sections, "first")[1].tolist() == [0, 0, 1, -1]
    token, of, share = shares(span, sections, "split")
    assert np.allclose(np.bincount(of + 1, share, 4), [1, 1 + 1 / 3, 2 / 3 + 1 / 4, 3 / 4])
    assert np.allclose(np.bincount(token, share), 1)
    got, text = line_sections(pa.array(["ab\n\ncdefg", None, "", "é\n"]), 3)
    assert got.tolist() == [[0, 3], [3, 4], [4, 7], [7, 9], [9, 11]] and text.tolist() == [0, 0, 0, 0, 3]
    assert len(line_sections(pa.array(["", None], pa.string()), 3)[0]) == 0


def counts_brute(encoded, text, sections, rule):
    """A plain loop over tokens, sections and characters."""
    sums = {}
    for a, z in encoded.offsets:
        places = [next((k for k, (s, e) in enumerate(sections) if s <= c < e), -1) for c in range(a, max(z, a + 1))]
        if rule == "split":
            for p in places:
                sums[p] = sums.get(p, 0) + 1 / len(places)
        else:
            held = [p for p in places if p >= 0]
            best = (places[0] if rule == "first" else max(sorted(set(held)), key=held.count)) if held else -1
            sums[best] = sums.get(best, 0) + 1
    return sums


def lines_brute(text, longest):
    out, at = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        body = len(line.rstrip("\n"))
        cuts = [at, *range(at + longest, at + body, longest), at + len(line)]
        out += list(zip(cuts, cuts[1:]))
        at += len(line)
    return out


@pytest.mark.parametrize("rule", ["majority", "first", "split"])
def test_section_counts_equal_a_plain_loop(spark, vocabulary, texts, rule):
    for longest in (500, 7):
        want = {}
        for k, (text, e) in enumerate(zip(texts[:-2], whole(vocabulary, texts[:-2]), strict=True)):
            lines = lines_brute(text or "", longest)
            sums = counts_brute(e, text or "", lines, rule)
            want |= {(k, j): (a, z, sums.get(j, 0)) for j, (a, z) in enumerate(lines)}
            if -1 in sums:
                want[k, -1] = (0, 0, sums[-1])
        rows = section_tokens(frame(spark, texts[:-2]), vocabulary, rule=rule, longest_line=longest).collect()
        got = {(7 if r.doc_id is None else r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-6 for k in want)


def test_own_sections_equal_a_plain_loop(spark, vocabulary):
    rng, rows, want = random.Random(12), [], {}
    for k in range(60):
        text = "".join(rng.choice(["Éab", "cde", ",", " ", "x", "12"]) for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        sections = list(zip(cuts[::2], cuts[1::2]))
        order = rng.sample(range(len(sections)), len(sections))
        rows.append((k, text, [sections[j] for j in order]))
        sums = counts_brute(whole(vocabulary, [text])[0], text, sections, "majority")
        want |= {(k, j): sums.get(at, 0) for j, at in enumerate(order)} | ({(k, -1): sums[-1]} if -1 in sums else {})
    rows += [(70, None, [(0, 3)]), (71, "a b", None), (72, "a b", [(2, 1), (None, 1)])]
    want |= {(70, 0): 0, (71, -1): 2, (72, -1): 2}
    own = spark.createDataFrame(rows, "doc_id long, text string, f array<struct<start:long,end:long>>")
    assert {(r.doc_id, r.section): r.n_tokens for r in section_tokens(own, vocabulary, sections_col="f").collect()} == want
    assert section_tokens(own.filter("false"), vocabulary, sections_col="f").count() == 0


def test_section_counts_add_up(spark, vocabulary, texts):
    want = {k: len(e.ids) for k, e in enumerate(whole(vocabulary, texts))}
    for rule in ("majority", "first", "split"):
        got = {}
        for r in section_tokens(frame(spark, texts), vocabulary, rule=rule).collect():
            k = 7 if r.doc_id is None else r.doc_id
            got[k] = got.get(k, 0) + r.n_tokens
        assert all(abs(got.get(k, 0) - n) < 1e-6 for k, n in want.items())
    own = spark.sql("select 1L doc_id, 'ab cd ef' text, array(struct(6L start, 8L end), struct(0L start, 2L end), null) f union all select 2L, null, null")
    assert sorted(map(tuple, section_tokens(own, vocabulary, sections_col="f").collect())) == [(1, -1, 0, 0, 1.0), (1, 0, 6, 8, 1.0), (1, 1, 0, 2, 1.0)]
