"""Quality by hierarchical empirical Bayes: a document's own evidence upon what its site is like.

Document evidence is a logistic regression on a few surface features, fitted on a bounded sample of labelled rows; its
log-odds less those of the base rate are a likelihood ratio. Site evidence is counted over all labelled documents: the
global rate shrinks hosts, each host's posterior shrinks its paths, with strengths estimated from how much the rates of
hosts (of paths within hosts) vary beyond chance. Posterior log-odds of the path plus the likelihood ratio give the
document's quality. All counts are grouped aggregations; a site without labels inherits from the level above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the regression is fitted on, at most; the ones of smallest hash.
SAMPLE = 20_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
FEATURES = 8


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES): log length, log words, marks and digits by byte, word length, distinct words, distinct lines, line length."""
    raw, off = C.utf8(texts)
    words, begin = C.split_words(C.LOWER[raw], off)
    h = C.word_hashes(words)
    sums = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[off])
    size, n_words = np.diff(off), np.diff(begin)
    lines = sums(raw == 10) + 1
    own = np.array([len(np.unique(h[a:z])) for a, z in zip(begin[:-1], begin[1:], strict=True)])
    text_lines = [len(set(t.split("\n"))) for t in pc.fill_null(texts, "").to_numpy(zero_copy_only=False)]
    per = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    return np.stack([
        np.log1p(size), np.log1p(n_words), per(sums(_PUNCT[raw]), size), per(sums((raw >= 48) & (raw <= 57)), size),
        per(size, n_words) / 10, per(own, n_words), per(np.array(text_lines), lines), np.log1p(per(size, lines)),
    ], 1).astype(np.float64)


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in C.steps(b["text"]):
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(features(part["text"]).tolist(), pa.list_(pa.float64()))], [*part.schema.names[:-1], "x"])


def _expanded(x: np.ndarray, centre: np.ndarray, width: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / width, -6, 6)
    return np.concatenate((np.ones((len(z), 1)), z, z * z), 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict[str, np.ndarray | float]:
    """Ridge logistic regression by Newton steps; without both classes the evidence is nought."""
    if not len(y) or y.min() == y.max():
        return {"centre": np.zeros(FEATURES), "width": np.ones(FEATURES), "w": np.zeros(1 + 2 * FEATURES), "base": 0.0}
    centre, width = x.mean(0), np.maximum(x.std(0), 1e-6)
    z, w = _expanded(x, centre, width), np.zeros(1 + 2 * FEATURES)
    w[0] = base = float(np.log(y.mean() / (1 - y.mean())))
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(keep), z.T @ (y - p) - keep * (w - [base, *[0] * (len(w) - 1)]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"centre": centre, "width": width, "w": w, "base": base}


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior observations of a beta-binomial by moments, over groups (n, y) about the column ``mean``; between 1 and 10,000."""
    m = F.greatest(F.least(F.col(mean), F.lit(1 - 1e-6)), F.lit(1e-6))
    r = groups.filter("n > 0").agg(F.sum(F.col("n") * (F.col("y") / F.col("n") - m) ** 2 / (m * (1 - m))), F.count("*"), F.sum("n"), F.sum(F.col("n") ** 2)).first()
    if not r[1]:
        return 10_000.0
    spread = r[2] - r[3] / r[2] - (r[1] - 1)
    rho = (r[0] - (r[1] - 1)) / spread if spread > 0 else 0.0
    rho = min(max(rho, 1e-4), 0.5)
    return (1 - rho) / rho


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """From (host, path, y): (host, p_host, host_n), (host, path, p_path, path_n) and the global rate, shrunk level by level."""
    paths = C.written(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    r = paths.agg(F.sum("y"), F.sum("n")).first()
    rate = ((r[0] or 0) + 1) / ((r[1] or 0) + 2)
    k = _strength(hosts.withColumn("m", F.lit(rate)), "m")
    hosts = hosts.withColumn("p_host", (F.col("y") + k * rate) / (F.col("n") + k)).select("host", "p_host", F.col("n").alias("host_n"))
    hosts = C.written(hosts)
    both = C.null_safe(paths, hosts, ["host"], "inner")
    k2 = _strength(both, "p_host")
    return hosts, C.written(both.withColumn("p_path", (F.col("y") + k2 * F.col("p_host")) / (F.col("n") + k2)).select("host", "path", "p_path", F.col("n").alias("path_n"))), rate


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", cut: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_host, p_path, evidence (log likelihood ratio), p_quality, keep: a row for each row of ``docs``.

    Null and empty texts are judged by their features, which are noughts; null hosts and paths are sites like others.
    Labels that are null or neither 0 nor 1, or whose id is null, don't count; of several labels of one id the largest
    counts. Without labels every probability is a half.
    """
    C.bounded_batches(docs.sparkSession)
    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), text.alias("text"))
    # at most ``sample`` rows of two numbers: a proven bound
    some = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    got = slim.join(some, "doc_id").select("doc_id", "y", "text").mapInArrow(C.lean(_with_features), "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).toPandas()
    model = fit(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["y"].to_numpy(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in C.steps(b["text"]):
                part = b.slice(lo, hi - lo)
                logit = _expanded(features(part["text"]), model["centre"], model["width"]) @ model["w"] - model["base"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.clip(logit, -30, 30))], [*part.schema.names[:-1], "evidence"])

    hosts, paths, rate = site_posteriors(slim.select("doc_id", "host", "path").join(rated, "doc_id"))
    out = slim.mapInArrow(C.lean(judge), "doc_id long, host string, path string, evidence double")
    out = C.null_safe(out, paths, ["host", "path"], "left")
    out = C.null_safe(out, hosts, ["host"], "left")
    p_host = F.coalesce("p_host", F.lit(rate))
    p_path = F.coalesce("p_path", p_host)
    odds = F.log(p_path / (1 - p_path)) + F.col("evidence")
    return out.select("doc_id", p_host.alias("p_host"), p_path.alias("p_path"), "evidence", (1 / (1 + F.exp(-odds))).alias("p_quality")).withColumn("keep", F.col("p_quality") >= cut)
