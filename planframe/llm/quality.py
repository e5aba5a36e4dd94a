"""Quality by hierarchical empirical Bayes.

A document classifier (logistic, over the text's words and shape) gives each document its
own evidence. Sites are judged by labelled outcomes, counted over all labelled documents
by grouped aggregation: the rate of good ones of a host is shrunk towards the global rate,
that of a path of a host towards the host's, through beta-binomial priors whose strength
the counts themselves support, so sparse sites keep near the level above. The path's
posterior replaces the global rate as the prior of the document's own evidence. A labelled
document's own outcome is left out of all rates that it is judged by.

Words: each of ``2**16`` buckets of word hashes weighs by how much more often good
documents have it than bad ones; a document has the mean weight of its distinct words.
The classifier learns what that mean is worth from weights that leave a quarter of the
documents out in turn, so words of one document only don't vouch for it.

Scale: one pass over the texts without a shuffle; labels are joined to ids, and the
aggregation moves one row for each site and task. The classifier is fitted on at most
``FIT_ROWS`` labelled rows of each class, chosen by a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, chunks, fit_logistic, tidy
from .shrink import posterior_mean, strength
from .toxicity import fold

FIT_ROWS = 10_000
#: Weight of the site's evidence against the document's own.
SITE_WEIGHT = 1.0
#: Documents that each class is taken to have had with a bucket before any was seen.
PRIOR_COUNT = 1.0
BUCKETS = 1 << 16
_KINDS = np.full(256, 4, np.int8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 symbol, 5 byte over 127
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 5
_KINDS[[32, *range(9, 14)]] = 3
N_SHAPE = 12
N_FEATURES = N_SHAPE + 2


def describe(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows x N_SHAPE) numbers on the shape of each text, and the buckets of its distinct words; null is empty."""
    out, buckets = np.zeros((len(column), N_SHAPE)), []
    for first, data, offsets in chunks(column):
        rows, sizes = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
        doc_of = np.repeat(np.arange(rows), np.diff(offsets))
        kinds = np.bincount(doc_of * 6 + _KINDS[data], minlength=rows * 6).reshape(rows, 6)
        w = Words(data, offsets)
        words = np.maximum(w.counts, 1)
        by = np.lexsort((w.hash, w.doc))
        doc, h = w.doc[by], w.hash[by]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        most = np.zeros(rows)
        np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        ends_odd = np.isin(_KINDS[data[w.end - 1]], (2, 4)) if len(w.end) else np.zeros(0, bool)
        lines = np.bincount(doc_of[data == 10], minlength=rows)
        f = out[first : first + rows]
        f[:, 0] = np.log1p(w.counts)
        f[:, 1] = np.log1p(sizes / words)
        f[:, 2] = kinds[:, 4] / sizes
        f[:, 3] = kinds[:, 1] / sizes
        f[:, 4] = kinds[:, 2] / sizes
        f[:, 5] = np.bincount(doc[fresh], minlength=rows) / words
        f[:, 6] = most / words
        f[:, 7] = np.bincount(w.doc[same], minlength=rows) / words
        f[:, 8] = np.bincount(w.doc[ends_odd], minlength=rows) / words
        f[:, 9] = np.log1p(lines)
        f[:, 10] = np.sqrt(f[:, 2])
        f[:, 11] = np.sqrt(f[:, 7])
        ends = np.searchsorted(doc[fresh], np.arange(rows + 1))
        own = (h[fresh] >> np.uint64(48)).astype(np.int32)
        buckets += [own[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out, buckets


def bucket_weights(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of each bucket: how much more often documents of label 1 have it than those of label 0."""
    seen = np.zeros((2, BUCKETS))
    for own, label in zip(buckets, y, strict=True):
        seen[label, np.unique(own)] += 1
    rate = (seen + PRIOR_COUNT) / (np.bincount(y, minlength=2)[:, None] + 2 * PRIOR_COUNT)
    return np.log(rate[1] / rate[0])


def features(shapes: np.ndarray, buckets: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """(rows x N_FEATURES): the shape, and the mean and the scaled sum of the words' weights."""
    n = np.array([len(b) for b in buckets], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    total = np.bincount(owner, weights[np.concatenate(buckets)] if n.sum() else None, minlength=len(n))
    return np.column_stack([shapes, total / np.maximum(n, 1), total / np.sqrt(np.maximum(n, 1))])


class Classifier:
    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.mean, self.scale, self.coef = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)

    def score(self, column: pa.Array) -> np.ndarray:
        z = (features(*describe(column), self.weights) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.coef[:-1] + self.coef[-1], -30, 30)))


def outcomes(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, y): one label of each id outside fold 0, the lowest of several; null ids and labels are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    return known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on the documents of ``outcomes``, at most ``fit_rows`` of each class, one row of each id (the least text of repeated ids).

    Null texts count as empty. Where a class is missing every score is that of the other
    one; without labels, or with labels of no document at hand, every score is 0.5. Other
    columns are not read, so their names may clash.
    """
    known = outcomes(labels, id_col, label_col)
    true = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = Classifier()
    if not true.get(0) or not true.get(1):
        model.coef[-1] = 0.0 if not true else 30.0 if true.get(1) else -30.0
        return model
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # 2 * fit_rows rows at most

    def work(batches):
        for batch in batches:
            shapes, buckets = describe(batch.column("text"))
            ends = np.cumsum([0, *map(len, buckets)]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *buckets])))
            x = pa.FixedSizeListArray.from_arrays(pa.array(shapes.ravel()), N_SHAPE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), x, own], ["id", "y", "x", "buckets"])

    got = rows.mapInArrow(tidy(work), f"id {rows.schema['id'].dataType.simpleString()}, y int, x array<double>, buckets array<int>").toPandas().sort_values("id")
    if got["y"].nunique() < 2:
        return model
    fit(model, np.stack(got["x"].to_numpy()), [np.asarray(b, np.int32) for b in got["buckets"]], got["y"].to_numpy(), np.array([true[0], true[1]]))
    return model


def fit(model: Classifier, shapes: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, true: np.ndarray) -> None:
    """``true``: how many documents of each class there are, of which these rows are some."""
    quarter = np.arange(len(y)) % 4
    x = np.zeros((len(y), N_FEATURES))
    for q in range(4):
        own, rest = np.flatnonzero(quarter == q), np.flatnonzero(quarter != q)
        weights = bucket_weights([buckets[i] for i in rest], y[rest])
        x[own] = features(shapes[own], [buckets[i] for i in own], weights)
    model.weights = bucket_weights(buckets, y)
    have = np.bincount(y, minlength=2)
    model.mean, model.scale, model.coef = fit_logistic(x, y.astype(float), true[y] / have[y])


def site_rates(paths: DataFrame) -> DataFrame:
    """The counted outcomes of all levels beside each path, and the priors' strengths.

    ``paths`` has (host, path, n, k). Adds ``all_n``, ``all_k``, ``host_n``, ``host_k``,
    ``host_kappa`` and ``path_kappa``.
    """
    total = paths.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    # one row each
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).crossJoin(F.broadcast(total)).withColumn("m", F.try_divide("all_k", "all_n"))
    hosts = hosts.crossJoin(F.broadcast(strength(hosts).withColumnRenamed("kappa", "host_kappa")))
    hosts = checkpoint(hosts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_k"), "all_n", "all_k", "host_kappa", posterior_mean(F.col("n"), F.col("k"), F.col("m"), F.col("host_kappa")).alias("m")))
    sites = checkpoint(paths.join(hosts, "host"))
    return sites.crossJoin(F.broadcast(strength(sites).withColumnRenamed("kappa", "path_kappa"))).drop("m")


def classify(
    docs: DataFrame, model: Classifier, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", site_weight: float = SITE_WEIGHT
) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, score, kept``, one row per input row.

    ``evidence`` is the document's own probability of good quality, ``score`` the combined
    one, ``kept`` whether that is 0.5 or more. ``host_rate`` and ``path_rate`` are posterior
    rates of good documents among the other labelled ones of ``outcomes``; without any they
    are 0.5 and change nothing. Hosts and paths may be null: null is a value of its own.
    Null texts count as empty. Repeated rows count one by one, each with its id's label
    left out of its own rates only. Other columns are not read. An empty table gives an
    empty result.
    """

    def work(batches):
        for batch in batches:
            p = model.score(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], ["doc_id", "host", "path", "evidence"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.col(host_col).alias("h")).alias("h"), F.struct(F.col(host_col).alias("h"), F.col(path_col).alias("p")).alias("p"), F.col(text_col).alias("text"))
    # sites go by the text of their names, in which null differs from any name
    chosen = chosen.select("doc_id", F.to_json("h").alias("host"), F.to_json("p").alias("path"), "text")
    scored = chosen.mapInArrow(tidy(work), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, host string, path string, evidence double")
    known = outcomes(labels, id_col, label_col)
    own = checkpoint(scored.join(known, scored["doc_id"] == known["id"], "left").drop("id"))
    paths = own.groupBy("host", "path").agg(F.count("y").cast("double").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("double").alias("k"))
    sites = checkpoint(site_rates(checkpoint(paths)))

    def without_own(level: str) -> tuple[Column, Column]:
        return F.col(f"{level}n") - F.col("y").isNotNull().cast("int"), F.col(f"{level}k") - F.coalesce("y", F.lit(0))

    def logit(p):
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return F.log(p / (1 - p))

    n, k = without_own("all_")
    out = own.join(sites, ["host", "path"]).withColumn("all_rate", F.coalesce(F.try_divide(k, n), F.lit(0.5)))
    out = out.withColumn("host_rate", posterior_mean(*without_own("host_"), F.col("all_rate"), F.col("host_kappa")))
    out = out.withColumn("path_rate", posterior_mean(*without_own(""), F.col("host_rate"), F.col("path_kappa")))
    odds = logit(F.col("evidence")) + F.lit(site_weight) * (logit(F.col("path_rate")) - logit(F.col("all_rate")))
    return out.withColumn("score", 1 / (1 + F.exp(-odds))).select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
