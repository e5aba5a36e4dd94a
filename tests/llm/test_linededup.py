import random

import pyarrow as pa
import pytest
from llm_helpers import DOCS, ODD, clashing, documents, words_of

from planframe.llm import linededup, rarity


def brute(texts, percent=80, least=1):
    """Each text without the lines that an earlier line of any text is like."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0, i))
    earlier, out = [], {}
    for i in order:
        kept = []
        for line in (texts[i][1] or "").split("\n"):
            s = set(words_of(line))
            like = len(s) >= least and any(100 * len(s & e) >= percent * len(s | e) for e in earlier)
            if len(s) >= least:
                earlier.append(s)
            if not like:
                kept.append(line)
        out[i] = "\n".join(kept) if texts[i][1] is not None else None
    return [out[i] for i in range(len(texts))]


def check(docs, texts, **how):
    got = linededup.dedup_lines(docs, **how).collect()
    expected = brute(texts, **{{"percent": "percent", "least_words": "least"}[k]: v for k, v in how.items()})
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, ((texts[i][0], t) for i, t in enumerate(expected))))
    for r in got:
        before = next(t for d, t in texts if d == r["doc_id"])
        assert r["n_lines"] == (len(before.split("\n")) if before else 0)
    return got


@pytest.mark.parametrize("seed,words", [(1, (3, 9)), (2, (5, 25)), (3, (30, 70))])
def test_against_all_pairs(spark, seed, words):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)] + ["the", "of", "a"] * 40
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(*words))] for _ in range(60)]

    def line():
        own = [rng.choice(vocabulary) if rng.random() < 0.06 else w for w in rng.choice(bases)]
        rng.shuffle(own)
        return " ".join(own)

    texts = [(i, "\n".join(line() if rng.random() < 0.8 else "" for _ in range(rng.randint(0, 8)))) for i in range(90)]
    rng.shuffle(texts)
    got = check(documents(spark, texts), texts)
    assert sum(r["n_removed"] for r in got) > 50


def test_long_passage_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = passage.replace("p30", "x").replace("p31", "y")
    texts = [(3, f"own line of three here\n{other}"), (1, f"{passage}\nown line of one here"), (2, f"a\n{passage}\nb")]
    got = {r["doc_id"]: r["text"] for r in check(documents(spark, texts), texts)}
    assert got == {1: f"{passage}\nown line of one here", 2: "a\nb", 3: "own line of three here"}


def test_lines_on_both_sides_of_256_words_meet(spark):
    words = [f"w{i}" for i in range(330)]
    texts = [(i, " ".join(words[:n]) + f"\nown line {i}") for i, n in enumerate((250, 262, 330, 200, 255, 256))]
    got = {r["doc_id"]: r["n_removed"] for r in check(documents(spark, texts), texts)}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1}


def test_hot_line(spark):
    texts = [(i, f"all rights reserved by us\nline {i} has its own words a{i} b{i} c{i} d{i} e{i}") for i in range(120)]
    got = check(documents(spark, texts), texts)
    assert sum(r["n_removed"] for r in got) == 119


def test_chain_goes_by_matches(spark):
    """A line that matches a removed line goes too."""
    words = [f"w{i}" for i in range(10)]
    texts = [(i, " ".join(words[i:] + [f"x{j}" for j in range(i)])) for i in range(4)]
    got = check(documents(spark, texts), texts)
    assert sum(r["n_removed"] for r in got) == 3


def test_parameters(spark):
    texts = [(1, "a b c\na b c\na b"), (2, "a b\nc b a x")]
    check(documents(spark, texts), texts, percent=70)
    check(documents(spark, texts), texts, percent=70, least_words=3)


def test_odd_rows(spark):
    rows = [*ODD, (20, "\n\n"), (21, "a b c d e\r\na b c d e\r\n"), (22, "\n a b c d e \n")]
    check(clashing(documents(spark, rows)), rows)


def test_other_columns_stay(spark):
    docs = documents(spark, ["a b c d e", "a b c d e"])
    got = linededup.dedup_lines(docs).select("doc_id", "lang", "source", "n_chars").collect()
    assert sorted(got) == sorted(docs.select("doc_id", "lang", "source", "n_chars").collect())


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_short_lines_go_too(spark):
    """Equal lines of 1 to 3 words, and 4 words against 5."""
    texts = [(1, "All rights reserved.\nhome\na b c d e\na b"), (2, "x\nall RIGHTS reserved.\nHome\na b c d\na b c"), (3, "d c b a\n\nb a")]
    got = {r["doc_id"]: r["text"] for r in check(documents(spark, texts), texts)}
    assert got == {1: texts[0][1], 2: "x\na b c", 3: ""}


def test_sets_of_few_words_are_like_equal_ones_only():
    for percent in (51, 70, 80, 90):
        n = linededup._least_joined(percent)
        assert 100 * n >= percent * (n + 1) and all(100 * k < percent * (k + 1) for k in range(1, n))


def similar_lines(seed, count=140):
    """Lines of a few frequent words, most of them nearly alike, and some with none in common."""
    rng = random.Random(seed)
    common, bases = [f"c{i}" for i in range(14)], []
    for _ in range(6):
        bases.append(rng.sample(common, 9) + [f"r{rng.randrange(10**6)}" for _ in range(3)])
    lines = [" ".join(w if rng.random() > 0.08 else rng.choice(common) for w in rng.choice(bases)) for _ in range(count)]
    lines += [" ".join(rng.sample(common, 8)) for _ in range(count)]
    rng.shuffle(lines)
    return [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]


@pytest.mark.parametrize("settings", [{"FREQUENT": 3}, {"SHORT_LIST": 4}, {"MOST_PAIRS": 0}, {"FREQUENT": 3, "SHORT_LIST": 3, "MOST_PAIRS": 1, "BUCKET": 1, "HELD": 64}])
def test_twos_long_lists_and_crowded_lists(spark, monkeypatch, settings):
    monkeypatch.setattr(rarity, "LEAST_HEAVY", 1)
    for name, value in settings.items():
        monkeypatch.setattr(linededup, name, value)
    texts = similar_lines(len(settings))
    got = check(documents(spark, texts), texts)
    assert sum(r["n_removed"] for r in got) > 40


def test_cut_lines():
    texts = ["a\nb\nc", "a\nb\nc", "a\n", "", None, "one", "x\n\ny", "é\nü"]
    gone = [[1], [0, 2], [1], None, [0], [0], None, [0]]
    got = linededup._without(pa.array(texts), pa.array(gone, pa.list_(pa.int32()))).to_pylist()
    assert got == ["a\nc", "b", "a", "", None, "", "x\n\ny", "ü"]
    assert linededup._without(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_more_lines_than_24_bits_count(spark):
    """One text of 17 million lines: a line at its end still meets its like."""
    texts = [(1, "\n" * 17_000_000 + "a b c d e f"), (2, "f e d c b a\nown words")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(documents(spark, texts)).where("doc_id = 2").collect()}
    assert got == {2: "own words"}


def test_cutting_takes_a_chunk_at_once(monkeypatch):
    rng, calls, once = random.Random(5), [], linededup.np.flatnonzero
    monkeypatch.setattr(linededup.np, "flatnonzero", lambda x: calls.append(1) or once(x))
    texts = [rng.choice([None, "", "\n", "\n\n", "é\nb", *["\n".join(rng.choice(["", "a b", "ü", "long " * 9]) for _ in range(rng.randint(1, 6)))] * 9]) for _ in range(4000)]
    gone = [rng.choice([None, [i for i in range(len((t or "").split("\n"))) if rng.random() < 0.5]]) for t in texts]
    got = linededup._without(pa.array(texts)[7:], pa.array(gone, pa.list_(pa.int32()))[7:]).to_pylist()
    assert got == [t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in (g or [])) for t, g in zip(texts[7:], gone[7:], strict=True)]
    assert len(calls) < 100
