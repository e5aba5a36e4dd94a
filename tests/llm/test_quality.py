import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import DOCS, ODD, clashing, documents
from pyspark.sql import functions as F

from planframe.llm import quality
from planframe.llm.shrink import strength


def corpus(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < (0.9 if i % 3 else 0.3)
        words = [rng.choice(["the", "river", "runs", "along", "hill"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 60))]
        text = " ".join(words) if good else rng.choice([" ".join(w + "###" for w in words), " ".join([words[0]] * 40), " ".join(w.upper() + "!!" for w in words)])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(600)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, table, quality.train(docs, table)


def test_held_out(spark, trained):
    docs, table, model = trained
    got = quality.classify(docs, model, table).join(table, "doc_id").where(quality.fold(F.col("doc_id")) == 0).toPandas()
    assert len(got) > 80 and (got["kept"] == (got["quality"] == 1)).mean() > 0.97


def kappa(groups):
    """Prior weight by moments from (n, k, parent's rate)."""
    groups = [g for g in groups if g[0] > 0 and 0 < g[2] < 1]
    excess = sum(n * (k / n - m) ** 2 / (m * (1 - m)) - 1 for n, k, m in groups)
    spread = sum(n - 1 for n, _, _ in groups)
    return 1 / max(1e-4, min(0.999, excess / spread if spread else 1e-4)) - 1


def brute(rows, labels, evidence):
    """(host rate, path rate, score) of each row, level by level in plain Python."""
    y = {}
    for i, label, _ in labels:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 5:
            y[i] = min(label, y.get(i, 1))
    counts = defaultdict(lambda: [0, 0])
    for i, _, lang, source, _ in rows:
        if i in y:
            for key in ((), (source,), (source, lang)):
                counts[key][0] += 1
                counts[key][1] += y[i]
    n, k = counts[()]
    hosts, paths = {(r[3],) for r in rows}, {(r[3], r[2]) for r in rows}
    kappa_host = kappa([(*counts[h], k / n) for h in hosts])
    mean = {h: (counts[h][1] + kappa_host * k / n) / (counts[h][0] + kappa_host) for h in hosts}
    kappa_path = kappa([(*counts[p], mean[p[:1]]) for p in paths])
    out = []
    for (i, _, lang, source, _), e in zip(rows, evidence, strict=True):
        one, own = int(i in y), y.get(i, 0)
        m = (k - own) / (n - one)
        host = (counts[(source,)][1] - own + kappa_host * m) / (counts[(source,)][0] - one + kappa_host)
        path = (counts[(source, lang)][1] - own + kappa_path * host) / (counts[(source, lang)][0] - one + kappa_path)
        odds = math.log(e / (1 - e)) + math.log(path / (1 - path)) - math.log(m / (1 - m))
        out.append((host, path, 1 / (1 + math.exp(-odds))))
    return out


def sites_corpus(n, seed=6):
    """Texts that say nothing: only hosts and their paths differ, some with few documents."""
    rng, rows, labels = random.Random(seed), [], []
    rate = {(h, p): min(0.97, max(0.03, rng.choice([0.08, 0.92]) + rng.gauss(0, 0.04))) for h in range(6) for p in ("en", "fr", None)}
    for i in range(n):
        site = (rng.choice([0, 0, 0, 1, 1, 2, 3, 4, 5]), rng.choice(["en", "en", "fr", None]))
        text = " ".join(rng.choice(["the", "river", "runs", "along", "hill"]) for _ in range(12))
        rows.append((i, text, site[1], f"h{site[0]}" if site[0] < 5 else None, 0))
        labels.append((i, int(rng.random() < rate[site]), 0))
    return rows, labels


def test_against_brute_force_where_sites_decide(spark):
    rows, labels = sites_corpus(900)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    labels = [*labels, (5, 0, 0)]
    got = {r["doc_id"]: r for r in quality.classify(docs, quality.train(docs, table), table).collect()}
    expected = brute(rows, labels, [got[r[0]]["evidence"] for r in rows])
    for r, e in zip(rows, expected, strict=True):
        assert (got[r[0]]["host_rate"], got[r[0]]["path_rate"], got[r[0]]["score"]) == pytest.approx(e, abs=1e-9)
    truth = {i: y for i, y, _ in labels[:900]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    with_sites = sum(got[i]["kept"] == bool(truth[i]) for i in held) / len(held)
    alone = sum((got[i]["evidence"] >= 0.5) == bool(truth[i]) for i in held) / len(held)
    assert with_sites > 0.8 and with_sites > alone + 0.15


def test_own_outcome_is_left_out(spark):
    """Two documents alike but for their own labels: the rates of each hold the other's."""
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:2]
    docs = spark.createDataFrame([(ids[0], "a", "en", "s", 0), (ids[1], "a", "en", "s", 0)], DOCS)
    table = spark.createDataFrame([(ids[0], 1, 0), (ids[1], 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["host_rate"] for r in quality.classify(docs, quality.Classifier(), table).collect()}
    assert got == pytest.approx({ids[0]: 0.0, ids[1]: 1.0})


def test_word_weights_by_hand():
    buckets = [np.array([1, 2, 2]), np.array([2]), np.array([3])]
    w = quality.bucket_weights(buckets, np.array([1, 0, 1]))
    assert w[1] == pytest.approx(math.log((2 / 4) / (1 / 3))) and w[2] == pytest.approx(math.log((2 / 4) / (2 / 3))) and w[9] == pytest.approx(math.log((1 / 4) / (1 / 3)))
    x = quality.features(np.zeros((3, 12)), [np.array([1, 2]), np.array([], int), np.array([3])], w)
    assert x[:, 12].tolist() == pytest.approx([(w[1] + w[2]) / 2, 0, w[3]]) and x[0, 13] == pytest.approx((w[1] + w[2]) / math.sqrt(2))


def test_words_are_evidence(spark):
    """The shape is the same; only words tell good from bad."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "delta"] if i % 2 else ["gamma", "kappa"]) if rng.random() < 0.3 else rng.choice(["seven", "eight"]) for _ in range(30)), "en", "s", 0) for i in range(400)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, table), table).where(quality.fold(F.col("doc_id")) == 0).collect()
    assert sum(r["kept"] == bool(r["doc_id"] % 2) for r in got) > 0.95 * len(got)


def test_repeated_ids_are_fitted_once(spark):
    rows, labels = corpus(80)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, many = spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows + rows[:9] * 50, DOCS)
    assert quality.train(one, table).coef.tolist() == pytest.approx(quality.train(many, table).coef.tolist())


def test_strength_by_hand(spark):
    groups = spark.createDataFrame([(10.0, 9.0, 0.5), (10.0, 1.0, 0.5), (1.0, 1.0, 0.5)], "n double, k double, m double")
    excess = 2 * (10 * 0.16 / 0.25 - 1) + (0.25 / 0.25 - 1)
    rho = excess / 18
    assert strength(groups).first()["kappa"] == pytest.approx(1 / rho - 1)
    assert strength(groups.where("n < 0")).first()["kappa"] == pytest.approx(1e4 - 1)


def test_odd_rows(spark, trained):
    got = quality.classify(clashing(documents(spark, ODD)), trained[2], trained[1]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    nulls = spark.createDataFrame([(1, "a", None, None, 1), (2, "a", None, "s", 1), (3, None, "en", None, 1), (None, "b", None, None, None)], DOCS)
    assert quality.classify(nulls, trained[2], trained[1]).count() == 4


@pytest.mark.parametrize("labels", [[], [(0, 0, 0)], [(0, 1, 0), (1, 1, 0)], [(None, 1, 1), (1, None, None)]])
def test_few_labels(spark, labels):
    docs = documents(spark, ["a b", "c d", None])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, table), table).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got)


def test_empty_table(spark, trained):
    assert quality.classify(spark.createDataFrame([], DOCS), trained[2], trained[1]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_on_the_test_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, table = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, quality.train(docs, table), table).join(table, "doc_id").where(quality.fold(F.col("doc_id")) == 0).toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.95
