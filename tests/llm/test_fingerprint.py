import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCS, ODD, clashing, documents, shingles_of

from planframe.llm import fingerprint
from planframe.llm.fingerprint import Fingerprinter


def jaccard(a, b):
    a, b = shingles_of(a, 5), shingles_of(b, 5)
    return len(a & b) / len(a | b) if a or b else 1.0


def like(maker, a, b):
    x, y = maker.codes(pa.array(a)), maker.codes(pa.array(b))
    return maker.likeness(*x, *y)


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimates(bits):
    rng = random.Random(bits)
    a, b = [], []
    for _ in range(120):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([12, 60, 300, 1500]))]
        cut = rng.randint(0, len(words))
        a.append(" ".join(words))
        b.append(" ".join(words[:cut] + [f"x{rng.randint(0, 10**6)}" for _ in words[cut:]]))
    maker = Fingerprinter(bits=bits)
    true = np.array([jaccard(x, y) for x, y in zip(a, b, strict=True)])
    errors = like(maker, a, b) - true
    # of m independent bins, each equal with chance r + (1 - r) / 2**bits; small sets fill few bins of their own
    m = np.array([min(maker.bins, len(shingles_of(x, 5) | shingles_of(y, 5))) for x, y in zip(a, b, strict=True)])
    by_chance = 2.0**-bits
    equal = true + (1 - true) * by_chance
    deviation = np.sqrt(equal * (1 - equal) / m) / (1 - by_chance)
    z = errors / np.maximum(deviation, 1e-3)
    assert abs(errors.mean()) < 4 * np.sqrt((deviation**2).mean() / len(errors)) + 0.01
    assert np.sqrt((z**2).mean()) < 1.5 and np.abs(z).max() < 6


def test_equal_and_empty():
    maker = Fingerprinter()
    assert like(maker, ["a b c", "", None, "", "a"], ["a b c", "", " \n", "a", "b"]).tolist() == [1.0, 1.0, 1.0, 0.0, 0.0]
    p = maker.pack(*maker.codes(pa.array(["A b c d e f", "a B c d e f", "", "x"])))
    assert p[0] == p[1] and p[2] == "" and p[3] not in ("", p[0])


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_packing(bits):
    maker = Fingerprinter(bins=64, bits=bits)
    codes, some = maker.codes(pa.array(["a b c d e f g h", "", "one"]))
    packed = maker.pack(codes, some)
    back, there = maker.unpack(packed)
    assert (back[there] == codes[there]).all() and there.tolist() == some.tolist() and len(packed[0]) == 64 * bits // 4


def brute(texts):
    """By descending id, each text with its last third replaced by the start of the next one."""
    rows = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        yield d, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, n


def check(docs, texts):
    got = fingerprint.edited_likeness(docs).collect()
    expected = list(brute(texts))
    assert sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got) == sorted(repr(x[:3]) for x in expected)
    maker = Fingerprinter()
    by = {x[2]: x for x in expected}
    for r in got:
        _, _, _, text, e, n = by[r["edited_sha256"]]
        assert r["edited_fingerprint"] == maker.pack(*maker.codes(pa.array([e])))[0]
        if sum(x[2] == r["edited_sha256"] for x in expected) == 1:
            assert r["fingerprint"] == maker.pack(*maker.codes(pa.array([text])))[0]
            assert r["near_edited"] == pytest.approx(like(maker, [text], [e])[0])
            assert r["near_next"] == pytest.approx(like(maker, [text], [n])[0])
            assert abs(r["near_edited"] - jaccard(text, e)) < 0.15


@pytest.mark.parametrize("rows", [4096, 7, 1])
def test_edited(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    texts = [(rng.randint(-(10**12), 10**12), " ".join(rng.choice(["é", "ab", "日本", "x"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    check(documents(spark, texts), texts)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    check(clashing(documents(spark, ODD)), ODD)


def test_one_and_none(spark):
    check(documents(spark, [(5, "a b c d e f")]), [(5, "a b c d e f")])
    assert fingerprint.edited_likeness(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(documents(spark, ["a b", "A B", None])).collect()}
    assert got[0] == got[1] != "" and got[2] == ""
