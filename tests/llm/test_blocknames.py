import hashlib
import random
from collections import Counter

import pytest
from llm_helpers import DOCS, ODD, clashing, documents
from pyspark.sql import functions as F

from planframe.llm import blocknames


def check(docs, **how):
    given = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    group = Counter(t for _, t in given)
    keep = {t: max((d for d, x in given if x == t and d is not None), default=None) for t in group}
    out = blocknames.exact_dedup(docs, **how).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in group}
    assert sorted(map(repr, ((r["doc_id"], sha[r["text_sha256"]]) for r in out))) == sorted(map(repr, given))
    for r in out:
        t = sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (keep[t], group[t])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(sha[r["text_sha256"]] for r in out if r["kept"]) == Counter(group.keys())


def texts():
    random.seed(5)
    base = ["".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(150)]
    return base + random.choices(base, k=150) + ["é" * 17, "é" * 17, "é" * 16 + "e"]


@pytest.mark.parametrize("size", [1, 3, 8, 64])
def test_any_block_size(spark, size):
    check(documents(spark, texts()), block_bytes=size)


def test_keys_that_stand_for_many_blocks(spark):
    check(documents(spark, texts()), block_bytes=4, block_key=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))


def test_odd_rows(spark):
    check(clashing(documents(spark, ODD)))
    check(clashing(documents(spark, ODD)), block_bytes=1000)


def test_empty_table(spark):
    assert blocknames.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_group(spark):
    check(documents(spark, ["same"] * 200 + [f"t{i}" for i in range(100)]))
