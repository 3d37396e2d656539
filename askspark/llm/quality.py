"""Document quality: a text classifier whose prior comes from the site a document is on.

Evidence of the text is a log likelihood ratio. Words that mark a class are found by their document counts in one half of
the labelled documents; a logistic model of those words and of the make-up of the text (marks, capitals, repetition) is
fitted on the other half, so that chance findings among the words earn no weight. The prior is a hierarchy: rates of poor documents per path shrink towards the rate of their host, and rates per
host towards the overall rate, the more so the fewer documents there are. How strongly is estimated from the spread of the
rates themselves (empirical Bayes), so a sparse site says little and a large, uniform one says much.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askspark.llm.common import append_arrow, only_for
from askspark.session import cut_lineage

BITS = 18
CLASSES = ("poor", "toxic")
#: Priors of up to so many paths are sent to all tasks; more are joined.
SMALL_TABLE = 200_000
N_SHAPES = 9


class Model(NamedTuple):
    words: list[np.ndarray]  # per class: log odds of each word bucket, 0 for those that mark nothing
    scale: np.ndarray  # mean and deviation of each measure
    weights: list[np.ndarray]  # per class
    rates: list[float]


def word_buckets(text: str) -> list[int]:
    return list({zlib.crc32(w.encode()) & ((1 << BITS) - 1) for w in set(re.findall(r"\w+", text.lower()))})


def measures(text: str, buckets: list[int], words: list[np.ndarray]) -> list[float]:
    """What the logistic model sees: the make-up of the text, then for each class its strongest word and how many there are."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    blank, digits = counts[9:14].sum() + counts[32], counts[48:58].sum()
    tokens, lines = text.split(), text.split("\n")
    variety = math.log(max(1, len(set(tokens)))) / math.log(max(2, len(tokens)))
    marks = (n - letters - blank - digits) / n
    upper = counts[65:91].sum() / max(1, letters)
    out = [marks, math.sqrt(marks), upper, digits / n, blank / n, variety, math.log1p(len(tokens)), min(variety, 0.8), len(set(lines)) / len(lines)]
    for w in words:
        found = w[buckets]
        out += [float(found.max(initial=0)), math.log1p(int(np.count_nonzero(found)))]
    return out


def count_words(labelled: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Documents per class (all, poor, toxic) and word bucket, and per class; the counts are summed in Spark."""
    at = labelled.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for("quality")
        sums = np.zeros((3, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for value, p, t in zip(batch.column(at), batch.column("_is_poor").to_pylist(), batch.column("_is_toxic").to_pylist()):
                own = [*word_buckets(value.as_py() or ""), 1 << BITS]
                sums[0, own] += 1
                if p:
                    sums[1, own] += 1
                if t:
                    sums[2, own] += 1
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (np.arange(sums.shape[1]), *sums)], names=["bucket", "n", "poor", "toxic"])

    rows = labelled.mapInArrow(count, "bucket long, n long, poor long, toxic long")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("poor").alias("poor"), F.sum("toxic").alias("toxic")).toPandas()
    sums = np.zeros((3, (1 << BITS) + 1))
    sums[:, got["bucket"].to_numpy(np.int64)] = got[["n", "poor", "toxic"]].to_numpy(np.float64).T
    return sums[:, :-1], sums[:, -1]


def marking_words(sums: np.ndarray, totals: np.ndarray, least: float = 12.0, odds: float = 2.0) -> list[np.ndarray]:
    """Per class the log odds of each bucket whose likelihood-ratio statistic is at least ``least`` and log odds ``odds``."""
    found = []
    for c in (1, 2):
        n1, n0 = totals[c], totals[0] - totals[c]
        a, b = sums[c], sums[0] - sums[c]
        share = n1 / max(1.0, n1 + n0)
        expected = np.maximum((a + b) * share, 1e-9)
        g2 = 2 * (np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / expected), 0) + np.where(b > 0, b * np.log(np.maximum(b, 1e-9) / np.maximum((a + b) * (1 - share), 1e-9)), 0))
        weight = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        found.append(np.where((g2 >= least) & (weight >= odds), weight, 0.0).astype(np.float32))
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the first column is constant and not held back by the ridge."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        size = np.abs(step).max()
        w += step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int) -> Model:
    """Models of poor (quality 0) and toxic documents. At most ``max_labelled`` labelled documents are used, those with the
    smallest hash of their id; fewer are used whole. Rows without an id, or with both labels null, are left out. A class
    without documents, or the only one, gets a model that says nothing."""
    marks = labels.where(F.col(id_col).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    marks = marks.groupBy(id_col).agg(
        F.coalesce(F.min("quality") == 0, F.lit(False)).alias("_is_poor"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("_is_toxic")
    )
    marks = marks.withColumn("_order", F.xxhash64(id_col)).orderBy("_order", id_col).limit(max_labelled)
    labelled = docs.select(id_col, text_col).join(F.broadcast(marks), id_col)
    words = marking_words(*count_words(labelled.where("_order % 2 = 0"), text_col))
    shared = docs.sparkSession.sparkContext.broadcast(words)
    half = labelled.where("_order % 2 <> 0")
    at = half.columns.index(text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for("quality")
        for batch in batches:
            rows = [measures(t, word_buckets(t), shared.value) for t in (v.as_py() or "" for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("_is_poor"), batch.column("_is_toxic")], names=["x", "poor", "toxic"])

    seen = half.mapInArrow(look, "x array<double>, poor boolean, toxic boolean").toPandas()
    size = N_SHAPES + 2 * len(CLASSES)
    x = np.array(seen["x"].tolist(), np.float64).reshape(-1, size)
    mean, spread = (x.mean(0), x.std(0)) if len(x) else (np.zeros(size), np.ones(size))
    scale = np.vstack([mean, np.where(spread > 1e-9, spread, 1.0)])
    z = np.hstack([np.ones((len(x), 1)), (x - scale[0]) / scale[1]])
    weights, rates = [], []
    for c in CLASSES:
        y = seen[c].to_numpy(np.float64)
        said = 0 < y.sum() < len(y)
        rates.append(float((y.sum() + 1) / (len(y) + 2)) if said else 0.01)
        w = logistic(z, y) if said else np.zeros(size + 1)
        w[0] -= math.log(rates[-1] / (1 - rates[-1])) if said else 0
        weights.append(w)
    return Model(words, scale, weights, rates)


def with_evidence(docs: DataFrame, model: Model, text_col: str, instead_of_text: bool = False) -> DataFrame:
    """Adds the log likelihood ratios ``_poor`` and ``_toxic``, kept within 12 either way; ``instead_of_text``, in place of the
    last column, the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def begin():
        only_for("quality")
        m = shared.value

        def score(batch: pa.RecordBatch) -> list[pa.Array]:
            x = np.array([measures(t, word_buckets(t), m.words) for t in (v.as_py() or "" for v in batch.column(at))]).reshape(batch.num_rows, -1)
            z = np.hstack([np.ones((len(x), 1)), (x - m.scale[0]) / m.scale[1]]) if len(x) else np.zeros((0, len(m.weights[0])))
            return [pa.array(np.clip(z @ w, -12, 12)) for w in m.weights]

        return score

    return append_arrow(docs, begin, {"_poor": "double", "_toxic": "double"}, int(instead_of_text))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, centre: str, c: str) -> Column:
    """Documents that the prior of ``groups`` is worth: moments of a beta distribution of their rates about ``centre``."""
    rate, mean = F.col(c) / F.col("n"), F.col(centre)
    spread = F.sum(F.col("n") * F.pow(rate - mean, 2)) / F.sum("n")
    chance = F.sum(mean * (1 - mean)) / F.sum("n")
    within = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    return F.least(F.greatest(within / F.greatest(spread - chance, F.lit(1e-9)) - 1, F.lit(2.0)), F.lit(1e6)).alias(f"k_{c}")


def site_priors(evidence: DataFrame, rates: dict[str, float]) -> DataFrame:
    """(``host``, ``path``, ``prior_poor``, ``prior_toxic``, ``n``): shrunken rates per path from grouped sums."""
    soft = {c: F.sum(_sigmoid(F.col(f"_{c}") + float(np.log(r / (1 - r))))).alias(c) for c, r in rates.items()}
    paths = cut_lineage(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *soft.values()), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in rates))
    whole = hosts.agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in rates)).first()
    mean = {c: min(max((whole[c] or 0) / (whole["n"] or 1), 1e-6), 1 - 1e-6) for c in rates}
    hosts = hosts.withColumns({f"mean_{c}": F.lit(m) for c, m in mean.items()})
    k = hosts.agg(*(_strength(hosts, f"mean_{c}", c) for c in rates)).first()
    hosts = hosts.select("host", *(((F.col(c) + (k[f"k_{c}"] or 2.0) * mean[c]) / (F.col("n") + (k[f"k_{c}"] or 2.0))).alias(f"host_{c}") for c in rates))
    paths = paths.join(hosts, "host")
    k = paths.agg(*(_strength(paths, f"host_{c}", c) for c in rates)).first()
    return paths.select(
        "host", "path", "n", *(((F.col(c) + (k[f"k_{c}"] or 2.0) * F.col(f"host_{c}")) / (F.col("n") + (k[f"k_{c}"] or 2.0))).alias(f"prior_{c}") for c in rates)
    )


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    path_cols: tuple[str, ...] = ("lang",), max_labelled: int = 50_000, most: float = 0.5,
) -> DataFrame:
    """Every row of ``docs`` with ``p_poor`` and ``p_toxic`` (posterior probabilities), ``prior_poor`` and ``prior_toxic``
    (of its path) and ``keep`` (both at most ``most``). Columns of these names are replaced.

    ``labels`` has the id, quality (0 poor, 1 good) and toxic (0, 1). Null hosts and paths form groups of their own; a null
    or empty text has the evidence of an empty text; repeated rows are kept. Without labels nothing is learned and all
    rows are kept; an empty table gives an empty one. Only counts, group sums and the labels travel; documents are
    shuffled only where there are more than ``SMALL_TABLE`` paths.
    """
    made = ["p_poor", "p_toxic", "prior_poor", "prior_toxic", "keep", "_poor", "_toxic", "_host", "_path"]
    model = fit(docs, labels, id_col, text_col, max_labelled)
    rates = dict(zip(CLASSES, model.rates))
    plain = docs.drop(*made)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in path_cols))
    sites = plain.select(host.alias("host"), path.alias("path"), F.col(text_col).alias("_text"))
    narrow = with_evidence(sites, model, "_text", instead_of_text=True)
    priors = cut_lineage(site_priors(narrow, rates), "priors").withColumnsRenamed({"host": "_host", "path": "_path"}).drop("n")
    if priors.count() <= SMALL_TABLE:
        priors = F.broadcast(priors)
    scored = with_evidence(plain, model, text_col).withColumns({"_host": host, "_path": path}).join(priors, ["_host", "_path"], "left")
    p = {c: _sigmoid(F.col(f"_{c}") + _logit(F.col(f"prior_{c}"))) for c in CLASSES}
    scored = scored.withColumns({f"p_{c}": x for c, x in p.items()}).withColumn("keep", (F.col("p_poor") <= most) & (F.col("p_toxic") <= most))
    return scored.select(*(F.col(f"`{c}`") for c in plain.columns), "p_poor", "p_toxic", "prior_poor", "prior_toxic", "keep")
