"""The inline job corpus, from the store to chunks, aspects and caches."""

import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import aspects as A
from loomtext.operators import chunking as C
from loomtext.operators import matching as M
from loomtext.sources import jobs as J

FIRST = """Requirements:
- Strong Python and SQL experience
- At least 3 years of experience
- Fluent in Dutch
Benefits
- Pension and 25 days of paid leave
- Hybrid work model"""
STORE = {
    "version": 1, "updatedAt": "x", "companies": {},
    "jobs": {
        "1": {"scraped": True, "title": "Data Engineer", "companyName": "Acme", "location": "Amsterdam", "jobUrl": "https://jobs.example/1", "description": FIRST},
        "2": {"scraped": True, "job_data": {"title": "Analyst", "companyName": "Beta", "jobUrl": "https://jobs.example/2", "description": "<p>We offer &amp; ask:</p><ul><li>Fully&nbsp;remote work</li><li>A Master&#39;s degree in statistics is required</li></ul><br>Bye"}, "meta": {"days_old": 3, "applied_times": "12"}},
        "3": {"scraped": True, "title": "Clerk", "description": "A job at a desk in a large office somewhere. It is on-site."},
        "4": {"scraped": True, "title": "Writer", "companyName": "Gamma", "description": " ".join(f"This is sentence number {k} of a long text without any bullets at all." for k in range(40))},
        "5": {"scraped": False, "title": "Gone", "description": ""},
        "6": {"scraped": False, "title": "Économiste", "companyName": "Île", "description": "Économiste confirmé, à Genève. Français et allemand exigés."},
    },
}


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("store") / "store.json"
    path.write_text(json.dumps(STORE))
    return J.read_store(spark, str(path)).cache()


def test_store_is_normalised(jobs):
    rows = {r.store_id: r for r in jobs.collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "6"]
    assert (rows["2"].company, rows["2"].days_old, rows["2"].applied_times) == ("Beta", 3, "12")
    assert rows["3"].job_key == "unknown|Clerk" and rows["1"].job_key == "https://jobs.example/1"


def test_store_without_jobs_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"version": 2}')
    with pytest.raises(J.StoreError):
        J.read_store(spark, str(tmp_path / "bad.json"))


def test_lines_equal_the_store(spark, jobs, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"store_id": k} | v) for k, v in STORE["jobs"].items()))
    cols = ["store_id", "job_key", "company", "description"]
    assert sorted(map(tuple, J.read_lines(spark, str(tmp_path / "l.json")).select(cols).collect())) == sorted(map(tuple, jobs.select(cols).collect()))


def test_sections_and_chunks(jobs):
    one = jobs.filter("store_id = '1'")
    got = C.sections(one, "job_key", "description").orderBy("start_line").collect()
    assert [(r.name, len(r.text.split("\n"))) for r in got] == [("requirements:", 3), ("benefits", 2)]
    chunks = C.chunks(one, "job_key", "description").orderBy("order").collect()
    assert [(r.order, r.text) for r in chunks] == [(0, "Strong Python and SQL experience"), (1, "At least 3 years of experience"), (2, "Pension and 25 days of paid leave")]
    assert (chunks[0].chunk_id, chunks[0].chunk_id_v2) == ("83dd8a73fe6dd3a81e6cf6d58baa7ca7", "8461b85ff4e25e4eb6040127cb245151")


def test_windows_overlap_and_come_back(jobs):
    prose = jobs.filter("store_id = '4'")
    text = prose.first().description
    sents = text.replace(". ", ".\n").split("\n")
    want, buf = [], ""
    for s in sents:
        if buf and len(buf) + 1 + len(s) > 900:
            want.append(buf)
            buf = s
        else:
            buf = f"{buf} {s}".strip()
    want.append(buf)
    chunks = [r.text for r in C.chunks(prose, "job_key", "description").orderBy("order").collect()]
    assert chunks == [w if k == 0 else f"{want[k - 1][-150:]} {w}".strip() for k, w in enumerate(want)]
    whole = C.without_overlap(C.chunks(prose, "job_key", "description"), "job_key", "order", "text").first().full_text
    assert whole == "\n\n".join(want)


def test_details(jobs):
    r = C.details(jobs.filter("store_id = '1'"), "job_key", "description").first()
    assert r.n_chunks == 3 and [c["order"] for c in r.chunks] == [0, 1, 2] and r.full_text.count("\n\n") == 2 and [s.name for s in r.sections] == ["intro"]


def test_structural_headers(spark):
    docs = spark.createDataFrame([(1, "What You Will Do:\n- dig\n- hoe\nOUR STACK\n- spade\nPython\nSome plain text here\nPerks\nlunch")], "k long, t string")
    rows = C.header_lines(C.lines(docs, "k", "t"), "k").orderBy("pos").collect()
    assert [r.is_header for r in rows] == [True, False, False, True, False, False, False, True, False]
    names = [r.name for r in C.sections(docs, "k", "t", "structural").orderBy("start_line").collect()]
    assert names[0] == "responsibilities" and names[2] == "benefits"


def test_aspects_of_the_first_job(spark, jobs):
    vocab = spark.createDataFrame([("skills", t) for t in ("python", "SQL", "R", "c++")] + [("tools", "Spark")], "aspect string, term string")
    rows = A.extract(jobs.filter("store_id = '1'"), "job_key", "description", vocab)
    got = {r.job_key: r.aspects for r in A.as_map(rows, "job_key").collect()}["https://jobs.example/1"]
    assert got == {"language": ["Dutch required"], "remote_policy": ["hybrid"], "experience": ["3 years of experience", "At least 3 years"], "benefits": ["paid leave", "pension"], "skills": ["Python", "SQL"]}
    evidence = {r.value: r.evidence for r in rows.collect()}
    assert "Fluent in Dutch" in evidence["Dutch required"]


def test_aspects_of_html(spark, jobs):
    from loomtext.functions import text as T

    clean = jobs.filter("store_id = '2'").withColumn("t", T.html_to_lines(T.decoded_fully(F.col("description"))))
    got = A.as_map(A.extract(clean, "job_key", "t"), "job_key").first().aspects
    assert got["remote_policy"] == ["remote"] and got["education"] == ["Master in statistics required"]


def test_substring_vocabulary_hits_inside_words(spark, jobs):
    vocab = spark.createDataFrame([("skills", "R"), ("skills", "Go")], "aspect string, term string")
    own = jobs.filter("store_id = '3'")
    assert [r.value for r in A.vocabulary_hits(own, "job_key", "description", vocab, "substring").collect()] == ["R"]
    assert A.vocabulary_hits(own, "job_key", "description", vocab).count() == 0


def test_names(spark):
    names = spark.createDataFrame([("k8s",), ("  Python ",), ("postgresq",), ("Nothing alike",), (None,), ("tf",)], "entity string")
    known = A.aliases(spark)
    got = {r.entity: r.canonical for r in A.normalised(names, known).collect()}
    assert got == {"k8s": "Kubernetes", "  Python ": "Python", "postgresq": "PostgreSQL", "Nothing alike": "Nothing alike", None: None, "tf": "TensorFlow"}
    more = A.aliases(spark, spark.createDataFrame([("K8S ", "Kube")], "alias string, canonical string"))
    assert A.normalised(names.filter("entity = 'k8s'"), more).first().canonical == "Kube"
    lists = spark.createDataFrame([(1, ["js", "JavaScript", "py"])], "k long, v array<string>")
    assert A.normalised_lists(lists, known, "k", "v").first().v == ["JavaScript", "Python"]
    assert M.indel_ratios(["ab", "ab", ""], ["ab", "cd", ""]).tolist() == [100, 0, 100]


def test_filters_and_exports(spark, jobs):
    vocab = spark.createDataFrame([("skills", "python")], "aspect string, term string")
    rows = A.extract(jobs, "job_key", "description", vocab).cache()
    assert [r.store_id for r in A.filter_jobs(jobs, rows, "job_key", ["PYTHON"], "hybrid").collect()] == ["1"]
    assert A.filter_jobs(jobs, rows, "job_key", ["PYTHON"], "remote").count() == 0
    out = {r.job_id: r.aspects for r in J.aspect_records(rows, jobs).collect()}
    assert len(out) == 5 and out["Gamma|Writer"] == {}
    asked = spark.createDataFrame([("https://jobs.example/1",), ("unknown",)], "job_key string")
    got = {r.job_key: r["values"] for r in A.side_by_side(rows, asked, "job_key", "skills").collect()}
    assert got == {"https://jobs.example/1": ["Python"], "unknown": []}


def test_section_chunks_without_a_section(spark):
    rows = spark.createDataFrame([("a", 0, None, "x"), ("a", 1, "Skills", "y")], "k string, order int, section string, text string")
    assert [r.text for r in C.section_chunks(rows, "k", "skills").collect()] == ["y"]
    assert C.section_chunks(rows, "k", None).count() == 2


def test_tables_and_cache(spark, jobs, tmp_path):
    J.write_table(jobs.select("job_key", "title"), f"{tmp_path}/chunks", "job_key")
    assert J.read_chunks(spark, f"{tmp_path}/chunks", "unknown|Clerk").count() == 1
    (tmp_path / "v.txt").write_text("# skills\n\n Python \nSQL\n")
    assert [r.term for r in J.read_vocabulary(spark, f"{tmp_path}/v.txt", "skills").collect()] == ["Python", "SQL"]
    cache = J.ClusterCache(spark, f"{tmp_path}/cache")
    a, b = cache.key("Work / Place", npmi=0.1), cache.key("Work / Place", npmi=0.2)
    assert a != b and a.startswith("work___place-") and cache.load(a) is None and cache.keys() == []
    points = spark.range(3).withColumn("cluster_id", F.lit(0))
    cache.save(a, points)
    cache.save(b, points.limit(1))
    cache.save(a, points.limit(2), "polygons")
    assert cache.has(a) and cache.load(a).count() == 3 and cache.load(b).count() == 1 and cache.load(a, "polygons").count() == 2
    made = []
    for _ in range(2):
        assert J.ClusterCache(spark, f"{tmp_path}/other").through(a, lambda: made.append(1) or points).count() == 3
    assert made == [1]
    cache.invalidate(a)
    assert cache.keys() == [b]


def test_phrase_and_label_files(spark, tmp_path):
    phrases = tmp_path / "phrases.json"
    phrases.write_text('{\n "phrases": ["data engineer", "", null,\n "data engineer", "sql"]\n}')
    assert sorted(r.ngram for r in J.read_phrases(spark, str(phrases)).collect()) == ["data engineer", "sql"]
    labels = tmp_path / "labels.json"
    labels.write_text(json.dumps({"j1": ["b", "a", "b", None], "j2": [], "é": ["x"]}, indent=2))
    want = [("j1", "a", 1), ("j1", "b", 0), ("é", "x", 0)]
    read = J.read_labels(spark, str(labels))
    assert sorted(tuple(r) for r in read.collect()) == want
    J.write_labels(read, str(tmp_path / "lines"))
    again = J.read_labels(spark, str(tmp_path / "lines"))
    assert sorted((r.job_id, r.label) for r in again.collect()) == [(j, x) for j, x, _ in want]
    assert {(r.job_id, r.label): r.pos for r in again.collect()}["j1", "b"] == 0
    bad = tmp_path / "bad.json"
    bad.write_text("not a map")
    assert J.read_labels(spark, str(bad)).count() == 0


def test_metadata_aspects_and_details_of_chunks(spark):
    docs = spark.createDataFrame([(1, "Requirements:\n- Strong Python and SQL experience\n- At least 3 years of experience", "t1"), (2, "short", "t2"), (3, None, None)], "doc_id long, text string, title string")
    rows = C.chunks(docs, "doc_id", "text")
    meta = C.with_metadata(rows, docs, "doc_id").select("order", "meta.*").orderBy("order").collect()
    assert len(C.META) == 14 and set(meta[0].asDict()) == {"order", *C.META} and [r.title for r in meta] == ["t1", "t1"] and meta[0].salary is None
    vocab = spark.createDataFrame([("skills", "Python"), ("skills", "SQL"), ("tools", "none")], "aspect string, term string")
    hits = A.extract(rows, "chunk_id", "text", vocab)
    got = {r.order: r.aspects for r in C.with_aspects(rows, "chunk_id", hits).collect()}
    assert got == {0: {"skills": ["Python", "SQL"]}, 1: {"experience": ["3 years of experience", "At least 3 years"]}}
    evidence = {(r.aspect, r.value): r.evidence for r in hits.collect()}
    assert evidence["skills", "SQL"] == "Strong Python and SQL experience"
    full = {r.doc_id: r for r in C.details(docs, "doc_id", "text").collect()}
    assert {k: (r.n_chunks, len(r.chunks), len(r.sections)) for k, r in full.items()} == {1: (2, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    assert full[2].full_text == full[3].full_text == ""


def test_chunks_and_details_stay_in_their_row(spark):
    """Sections, chunks and details shuffle nothing, and give what the forms of several rows give."""
    text = "Intro line one. " + "A sentence of some length stands here again. " * 60 + "\n\nRequirements:\n- Python and SQL for reports\n- a second longer bullet\n  goes on here\nBENEFITS\n" + "Pension is paid each month to all of us. " * 40
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Requirements:\nBENEFITS\nx")], "doc_id long, text string")
    out = C.details(docs, "doc_id", "text")
    for df in (out, C.chunks(docs, "doc_id", "text"), C.sections(docs, "doc_id", "text", "structural")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = C.chunks(docs, "doc_id", "text")
    whole = {r.doc_id: r.full_text for r in C.without_overlap(rows, "doc_id", "order", "text").collect()}
    own = {}
    for r in C.sections(C.without_overlap(rows, "doc_id", "order", "text"), "doc_id", "full_text", "structural").orderBy("start_line").collect():
        own.setdefault(r.doc_id, []).append((r.start_line, r.name or "intro", r.text))
    got = {r.doc_id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1].n_chunks > 5 and {s.section_raw for s in rows.collect()} == {None, "Requirements:", "BENEFITS"}
    for k, r in got.items():
        assert r.full_text == whole.get(k, "") and [tuple(s) for s in r.sections] == own.get(k, []) and r.n_chunks == len(r.chunks)
        assert [(c.order, c.section, c.text) for c in r.chunks] == [(c.order, c.section, c.text) for c in rows.filter(F.col("doc_id") == k).orderBy("order").collect()]


def test_similar_jobs_leave_their_own_chunks_out(spark, tmp_path, monkeypatch):
    """A job of many like chunks doesn't take the places of others, and only the best rows of a task leave it."""
    from loomtext.operators import index
    from loomtext.plans import registry

    def every(*_, **__):
        raise AssertionError("all scores were asked for")

    monkeypatch.setattr(index, "scores", every)
    line = "A sentence about the same few words in it. "
    spark.createDataFrame([(0, "title\n" + line * 900, "s"), (7, line, "s"), (9, "Words of another kind altogether here.", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["r10_jobs_by_title_and_text"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(0, 7), (0, 9)] and {r["rank"] for r in got} == {1, 2}
