import random

import numpy as np
import pyarrow as pa
from llm_helpers import words_of

from planframe.llm import common


def test_words_and_shingles_agree_with_python():
    random.seed(1)
    texts = ["", " a  b\tc\n", "É é a", "x" * 3000, None, *["".join(random.choice("ab \n\tÉ\x0b.") for _ in range(random.randint(0, 60))) for _ in range(300)]]
    by_word, by_shingle = {}, {}
    for first, data, offsets in common.chunks(pa.array(texts), 200):
        w = common.Words(data, offsets)
        docs, h = common.shingles(w, 3)
        for i in range(len(offsets) - 1):
            own = words_of(texts[first + i])
            got = w.hash[w.doc == i].tolist()
            assert len(own) == len(got) == w.counts[i]
            for word, x in zip(own, got, strict=True):
                assert by_word.setdefault(word, x) == x
            grams = [tuple(own[j : j + 3]) for j in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else []
            assert len(grams) == (docs == i).sum()
            for g, x in zip(grams, h[docs == i].tolist(), strict=True):
                assert by_shingle.setdefault(g, x) == x
    assert len(set(by_word.values())) == len(by_word) and len(set(by_shingle.values())) == len(by_shingle)


def test_hash_does_not_depend_on_place():
    a = common.Words(*common.utf8(pa.array(["word"]))).hash
    b = common.Words(*common.utf8(pa.array(["other words before Word", "word"]))).hash
    assert b[-1] == a[0] == b[-2]


def test_sliced_and_null_columns():
    column = pa.array([None, "a b", None, "c"]).slice(1)
    data, offsets = common.utf8(column)
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 3, 4]


def test_bloom(spark):
    keys = [k * 7919 - 5000 for k in range(2000)]
    bloom = common.Bloom.build(spark.createDataFrame([(k,) for k in keys], "k long"), 16)
    assert bloom.has(np.array(keys, np.int64)).all()
    assert bloom.has(np.arange(10**9, 10**9 + 2000)).mean() < 0.05
    assert not common.Bloom.build(spark.createDataFrame([], "k long"), 10).has(np.arange(5)).any()


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(100)] + [(1, 1)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    expected = {x: find(x) for x in parent if x not in alone}
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "__ROW int, x int")
    assert common.free_names(df, "row", "lines") == ["___row", "__lines"]
