from collections import Counter

import numpy as np
import pyarrow as pa

from planframe.llm import rarity


def counts(spark, tokens, monkeypatch, held):
    """What a task that holds so many tokens, and then the sum over tasks, make of the tokens."""
    monkeypatch.setattr(rarity, "HELD", held)

    def work(batches):
        tally = rarity.Tally()
        for batch in batches:
            yield from tally.add(np.asarray(batch.column(0)).view(np.uint64))
        yield from tally.flush()

    rows = spark.createDataFrame(pa.table({"token": pa.array(tokens, pa.int64())})).repartition(3)
    return rarity.tallied(rows.mapInArrow(work, rarity.PACKED))


def test_tallies_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    tokens = [*rng.integers(-(2**63), 2**63, 300).tolist() * 3, *range(50), *[7] * 500, -1]
    for held in (1 << 20, 16):
        got = {r["token"]: r["df"] for r in counts(spark, tokens, monkeypatch, held).collect()}
        assert got == {t: n for t, n in Counter(tokens).items() if n > 1}


def test_no_tokens(spark, monkeypatch):
    assert counts(spark, [], monkeypatch, 16).count() == 0


def test_places_follow_counts():
    rng = np.random.default_rng(2)
    token = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    token[1] = token[0] + np.uint64(1)
    count = rng.integers(33, 300, len(token))
    order = rarity.Order(token[::-1].copy(), count[::-1].copy())
    place = order.places(token)
    assert sorted(place.tolist()) == list(range(64, 64 + len(token)))
    assert count[np.argsort(place)].tolist() == sorted(count.tolist())
    assert all((place[i] >= order.over(100)) == (count[i] > 100) for i in range(len(token)))
    other = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    assert not order.places(other).any() and len(order.places(other[:0])) == 0
    nothing = rarity.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert not nothing.places(other).any()


def test_sorted_by_owner_place_and_hash():
    rng = np.random.default_rng(3)
    owner = np.sort(rng.integers(0, 50, 4000))
    h = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    h[::2] = rng.integers(0, 40, 2000, dtype=np.uint64)  # differ in their last bits only
    token = np.unique(np.concatenate([h[:200], h[1:300:2]]))
    order = rarity.Order(token, rng.integers(33, 99, len(token)))
    for own in (owner, owner * (1 << 55)):
        by, place = order.sorted(h, own)
        expected = sorted(zip(own.tolist(), place.tolist(), h.tolist(), strict=True))
        assert list(zip(own[by].tolist(), place[by].tolist(), h[by].tolist(), strict=True)) == expected


def test_classes_by_range():
    low, high = np.zeros(8, np.uint8), np.zeros(8, np.uint8)
    low[3], high[3] = 5, 9
    order = rarity.Order(np.array([11], np.uint64), np.array([100]), low, high, 1 << 62)
    h = np.array([3, 11, 3 + (1 << 63), 4], np.uint64)
    assert order.places(h).tolist() == [5, 64, 9, 0]


def test_heavy_tokens_and_the_classes_of_the_rest(spark, monkeypatch):
    monkeypatch.setattr(rarity, "MOST_HEAVY", 3)
    monkeypatch.setattr(rarity, "CLASS_CELLS", 16)
    rows = [(i, 40) for i in range(8)] + [(20, 70), (21, 200), (22, 10), (4, 33)]
    token, df, classes = rarity.heavy(spark.createDataFrame(rows, "token long, df long"))
    assert sorted(zip(token.tolist(), df.tolist(), strict=True)) == [(20, 70), (21, 200)]
    assert classes[:8].tolist() == [5] * 8 and not classes[8:].any()
