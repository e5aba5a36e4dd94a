from collections import defaultdict

import pytest
from llm_helpers import DOCS, ODD, clashing, documents, words_of

from planframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, cut at the cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    left = total
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(docs, **how):
    return [r.asDict() for r in mixing.mix(docs, **how).collect()]


def check(docs, rows):
    given = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r["source"]] += len(words_of(r["text"]))
    target = brute_targets(dict(sizes))
    assert len(rows) == len(given)
    taken, biggest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(2, 1.5 * biggest[s])
    return taken, target


def test_targets_and_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "en", f"s{min(i % 7, 4)}", 0) for i in range(900)], DOCS)
    rows = rows_of(docs)
    taken, target = check(docs, rows)
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    # each document within a source expects the same: copies differ by one at most
    for s in target:
        c = {r["copies"] for r in rows if r["source"] == s}
        assert max(c) - min(c) <= 1
    assert sorted(map(repr, rows)) == sorted(map(repr, rows_of(docs.repartition(7))))


def test_caps(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "big" if i > 4 else "a-small", 0) for i in range(400)], DOCS)
    rows = rows_of(docs)
    check(docs, rows)
    assert {r["copies"] for r in rows if r["source"] == "a-small"} == {3}


def test_targets_by_brute_force(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 2}, {"a": 0, "b": 7}, {"a": 3, None: 50, "b": 50}, {"x": 5}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r["source"]: r["target"] for r in got} == pytest.approx(brute_targets(sizes))


def test_odd_rows(spark):
    docs = clashing(documents(spark, ODD))
    check(docs, rows_of(docs))
    nulls = spark.createDataFrame([(1, "a b", None, None, 1), (2, None, None, "s", 1), (None, "c", None, None, None)], DOCS)
    rows = rows_of(nulls)
    assert {r["doc_id"]: r["size"] for r in rows} == {1: 2, 2: 0, None: 1}
    assert {r["target"] for r in rows if r["source"] == "s"} == {0.0}


def test_empty_tables(spark):
    assert rows_of(spark.createDataFrame([], DOCS)) == []
    assert {r["copies"] for r in rows_of(documents(spark, [None, "", " "]))} == {0}


def test_rows_are_carried(spark):
    docs = documents(spark, [f"w{i} x" for i in range(50)])
    got = mixing.mix(docs, carry=docs.columns).select("row.*").collect()
    assert sorted(got) == sorted(docs.collect())


def test_every_document_expects_the_same_over_seeds(spark):
    """One random offset: each is taken target / size times on average, long ones too."""
    docs = spark.createDataFrame([(i, "w " * (400 if i < 4 else 1 + i % 13), "en", "ab"[i % 2], 0) for i in range(60)], DOCS).cache()
    copies, seeds = defaultdict(int), 40
    for seed in range(seeds):
        rows = rows_of(docs, seed=seed)
        for r in rows:
            copies[r["doc_id"]] += r["copies"]
    for r in rows:
        each = r["target"] / r["source_size"]
        part = each % 1
        assert abs(copies[r["doc_id"]] / seeds - each) <= 4.5 * (part * (1 - part) / seeds) ** 0.5 + 1e-9


def test_ties_and_slots(spark, monkeypatch):
    """Rows of one id and size keep their copies whatever the partitions; small slots change the order, not the shares."""
    texts = [(i % 3, f"w{i} x") for i in range(200)]
    docs = documents(spark, texts)
    carried = lambda d: sorted((r["row"]["text"], r["copies"]) for r in mixing.mix(d, carry=d.columns).collect())
    assert carried(docs) == carried(docs.repartition(9, "text"))
    monkeypatch.setattr(mixing, "ROWS_A_SLOT", 1)
    check(docs, rows_of(docs))
