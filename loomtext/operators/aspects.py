"""Aspect extraction by rules and vocabularies, and normalising of the names found.

A rule set becomes one array expression: per label the first rule that hits, with the text around its match, in rule
order; no join and no second scan. Evidence lies ``around`` characters on either side of the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules as R
from .matching import VOCABULARY_TOKEN, similar_names, term_hits
from .store import written

VALUE = "struct<no:int,value:string,evidence:string>"


def _ci(pattern: str) -> str:
    return "(?iu)" + pattern


def _evidence(text: Column, parts: Column, n: int) -> Column:
    """The match between the ``parts`` that it splits a text into, with ``n`` characters on both sides, trimmed."""
    before = F.length(F.get(parts, 0))
    end = F.length(text) - F.length(F.get(parts, 1)) + n
    first = F.greatest(F.lit(1), before + 1 - n)
    return F.trim(F.substring(text, first, end + 1 - first))


def around(text: Column, pattern: str, n: int) -> Column:
    """The first match with ``n`` characters on both sides, trimmed; null without one."""
    return T.bound(F.split(text, _ci(pattern), 2), lambda parts: F.when(F.size(parts) > 1, _evidence(text, parts, n)))


def _labelled(text: Column, rules: tuple[tuple[str, str], ...], n: int, value=None) -> Column:
    """Array of (no, value, evidence), one for each label that hits, in rule order."""
    by: dict[str, list[tuple[int, str]]] = {}
    for no, (pattern, label) in enumerate(rules):
        by.setdefault(label, []).append((no, pattern))

    def hit(no: int, pattern: str, label: str) -> Column:
        def made(context: Column) -> Column:
            v = value(label, context) if value else F.lit(label)
            return F.when(context.isNotNull(), F.struct(F.lit(no).alias("no"), v.alias("value"), context.alias("evidence")))

        # the one run of the pattern
        return T.bound(around(text, pattern, n), made)

    each = [F.coalesce(*[hit(no, p, label) for no, p in own]) for label, own in by.items()]
    return F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull()))


def spoken_languages(text: Column) -> Column:
    return _labelled(text, R.LANGUAGE, 40)


def benefits(text: Column) -> Column:
    return _labelled(text, R.BENEFITS, 40)


def seniority(text: Column) -> Column:
    return _labelled(text, R.SENIORITY, 30)


def education(text: Column) -> Column:
    """Levels with their field and how firmly they are asked for, by what stands around."""
    def value(level: str, context: Column) -> Column:
        field = F.regexp_extract(context, _ci(R.FIELD), 1)
        firm = F.when(context.rlike(_ci(R.PREFERRED)), F.lit(" preferred")).when(context.rlike(_ci(R.REQUIRED)), F.lit(" required")).otherwise(F.lit(""))
        return F.concat(F.lit(level), F.when(field != "", F.concat(F.lit(" in "), field)).otherwise(F.lit("")), firm)

    return _labelled(text, R.EDUCATION, 60, value)


def remote_policy(text: Column) -> Column:
    """The one policy that ranks highest among those found."""
    found = _labelled(text, R.REMOTE_POLICY, 40)
    best = F.coalesce(*[F.get(F.filter(found, _is(p)), 0) for p in R.REMOTE_ORDER])
    return F.filter(F.array(best), lambda x: x.isNotNull())


def _is(value: str):
    return lambda x: x["value"] == value


def with_years(docs: DataFrame, text: str, out: str = "years") -> DataFrame:
    """``docs`` with the array of stated years: of each rule the first match that no earlier rule has, as written."""
    taken = F.array().cast("array<string>")
    docs = docs.withColumn(out, taken)
    for pattern in R.YEARS:
        found = F.regexp_extract_all(F.col(text), F.lit(_ci(pattern)), F.lit(0))
        fresh = F.filter(found, lambda m: ~F.exists(F.col(out), lambda y: F.lower(y) == F.lower(m)))
        docs = docs.withColumn(out, F.concat(out, F.slice(fresh, 1, 1)))
    return docs


def vocabulary_hits(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, match: str = "tokens") -> DataFrame:
    """(key, aspect, term, value, pos, evidence): terms of ``vocabulary`` (aspect, term) in each text, one row a term.

    ``tokens``: whole words, value as first written; ``substring``: anywhere in the text, value as in the vocabulary.
    In tokens mode terms of any length count, in the token form of texts: marks between words don't matter. Terms that
    are empty, or without a word in tokens mode, hit nothing. evidence: the text around, 30 characters on either side.
    """
    vocab = vocabulary.select("aspect", F.col("term").alias("_term"), F.lower("term").alias("term"))
    if match == "substring":
        names = written(vocab.groupBy("aspect", "term").agg(F.min("_term").alias("value")))
        hits = term_hits(docs, key, text, names).groupBy(key, "term").agg(F.min("pos").alias("pos"), F.min_by("evidence", "pos").alias("evidence"))
        return hits.join(names, "term").select(key, "aspect", "term", "value", "pos", "evidence")
    forms = vocab.withColumn("_t", F.regexp_extract_all("term", F.lit(VOCABULARY_TOKEN), F.lit(0))).filter(F.size("_t") > 0)
    forms = written(forms.select("aspect", "term", F.array_join("_t", " ").alias("_form")).distinct())  # a vocabulary may be costly to make
    hits = term_hits(docs, key, text, forms.select(F.col("_form").alias("term")), words=True)
    once = hits.groupBy(key, F.col("term").alias("_form")).agg(F.min_by("value", "pos").alias("value"), F.min_by("evidence", "pos").alias("evidence"), F.min("pos").alias("pos"))
    return once.join(forms, "_form").select(key, "aspect", "term", "value", "pos", "evidence")


def extract(docs: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None, match: str = "tokens") -> DataFrame:
    """Long table (key, aspect, value, pos, evidence) of all aspects; texts that are null or empty have none."""
    slim = with_years(docs.select(key, F.col(text).alias("_text")).filter("_text <> ''"), "_text", "_years")
    text_ = F.col("_text")
    years = F.transform(F.col("_years"), lambda y, i: F.struct(i.alias("no"), y.alias("value"), F.lit(None).cast("string").alias("evidence")))
    levels = F.transform(seniority(text_), lambda s: F.struct((s["no"] + 100).alias("no"), s["value"].alias("value"), s["evidence"].alias("evidence")))
    per = {"language": spoken_languages(text_), "remote_policy": remote_policy(text_), "experience": F.concat(years, levels), "education": education(text_), "benefits": benefits(text_)}
    named = F.flatten(F.array(*[_named(a, c) for a, c in per.items()]))
    out = slim.select(key, F.explode(named).alias("x")).select(key, "x.aspect", "x.value", "x.pos", "x.evidence")
    if vocabulary is None:
        return out
    hits = vocabulary_hits(docs.filter(F.col(text) != ""), key, text, vocabulary, match)
    pos = F.row_number().over(Window.partitionBy(key, "aspect").orderBy("value")) - 1
    return out.unionByName(hits.select(key, "aspect", "value", pos.alias("pos"), "evidence"))


def _named(aspect: str, values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(aspect).alias("aspect"), v["value"].alias("value"), i.alias("pos"), v["evidence"].alias("evidence")))


def as_map(aspects: DataFrame, key: str) -> DataFrame:
    """(key, aspects): map of each aspect to its values in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    per = aspects.groupBy(key, "aspect").agg(values.alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect", "v")))).alias("aspects"))


def distribution(aspects: DataFrame, key: str, jobs: DataFrame, aspect: str, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(value, n) of the most common values, and one row (jobs_with_values, total, coverage)."""
    own = aspects.filter(F.col("aspect") == aspect)
    counts = own.groupBy("value").agg(F.count_distinct(key).alias("n")).orderBy(F.desc("n"), "value").limit(most)
    with_any = own.select(key).distinct().agg(F.count("*").alias("jobs_with_values"))
    total = jobs.select(key).distinct().agg(F.count("*").alias("total"))
    return counts, with_any.crossJoin(total).withColumn("coverage", F.round(F.col("jobs_with_values") / F.greatest(F.col("total"), F.lit(1)), 3))


def side_by_side(aspects: DataFrame, jobs: DataFrame, key: str, aspect: str) -> DataFrame:
    """(key, values) of the asked jobs; unknown ones have none."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    own = aspects.filter(F.col("aspect") == aspect).join(jobs.select(key).distinct(), key).groupBy(key).agg(values.alias("values"))
    return jobs.join(own, key, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def filter_jobs(jobs: DataFrame, aspects: DataFrame, key: str, skills: list[str] | None = None, remote: str | None = None, location: Column | None = None) -> DataFrame:
    """Jobs with any of the skills, the remote policy and the location, if asked for (the reference drops the policy)."""
    if skills:
        have = aspects.filter(F.col("aspect").isin("skills", "tools") & F.lower("value").isin([s.lower() for s in skills]))
        jobs = jobs.join(have.select(key).distinct(), key, "left_semi")
    if remote:
        jobs = jobs.join(aspects.filter((F.col("aspect") == "remote_policy") & (F.col("value") == remote)).select(key), key, "left_semi")
    return jobs if location is None else jobs.filter(location)


# --- names ---------------------------------------------------------------------------------------------------------

def aliases(spark, extra: DataFrame | None = None) -> DataFrame:
    """(alias, canonical): the known spellings, and others; the last of a spelling counts."""
    rows = [(no, a, c) for no, (a, c) in enumerate(R.ALIASES)]
    df = spark.createDataFrame(rows, "no long, alias string, canonical string")
    if extra is not None:
        df = df.union(extra.select(F.lit(len(rows)).alias("no"), F.lower(F.trim("alias")).alias("alias"), "canonical"))
    return df.groupBy("alias").agg(F.max_by("canonical", F.struct("no", "canonical")).alias("canonical"))


def normalised(names: DataFrame, known: DataFrame, col: str = "entity", fuzzy: bool = True, least: float = 85.0) -> DataFrame:
    """``names`` with ``canonical``: by spelling, else the closest canonical name of a ratio of ``least`` or more (ties by name), else as it is.

    Only distinct names that no spelling fits are compared, with canonical names that share enough bigrams.
    """
    form = F.lower(F.trim(col))
    exact = names.withColumn("_form", form).join(known.select(F.col("alias").alias("_form"), F.col("canonical").alias("_exact")), "_form", "left")
    if not fuzzy:
        return exact.withColumn("canonical", F.coalesce("_exact", F.trim(col))).drop("_form", "_exact")
    open_ = exact.filter("_exact is null and _form is not null").select("_form").distinct()
    near = similar_names(open_, known.select(F.col("canonical").alias("_name")).distinct(), least)
    best = near.groupBy("_form").agg(F.min_by("_name", F.struct(-F.col("_r"), F.col("_name"))).alias("_near"))
    return exact.join(best, "_form", "left").withColumn("canonical", F.coalesce("_exact", "_near", F.trim(col))).drop("_form", "_exact", "_near")


def normalised_lists(rows: DataFrame, known: DataFrame, key: str, values: str) -> DataFrame:
    """(key, values): canonical names in order, one of each lower-case form."""
    each = normalised(rows.select(key, F.posexplode(values).alias("_pos", "entity")), known)
    once = each.groupBy(key, F.lower("canonical").alias("_l")).agg(F.min_by("canonical", "_pos").alias("canonical"), F.min("_pos").alias("_pos"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "canonical"))), lambda x: x["canonical"]).alias(values))
