import os
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import DOCS, ODD, clashing, documents
from pyspark.sql import functions as F

from planframe.llm import toxicity
from planframe.llm.toxicity import Restorer

INSULTS = ["idiot", "stupid", "moron", "trash", "loser"]
PLAIN = "the quick brown fox jumps over lazy dogs while many people walk along quiet rivers and read good books about distant lands".split()


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def trained(spark):
    texts, labels = corpus(800, 1)
    docs, table = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, table, toxicity.train(docs, table)


def scores(model, *texts):
    return model.score(pa.array(texts))


def test_restores_disguises(trained):
    r: Restorer = trained[2].restorer
    for raw, word in {"1d10t": "idiot", "stuuuupid": "stupid", "m0r0n": "moron", "tr4sh": "trash", "l0s3r": "loser", "$tupid": "stupid", "idiot": "idiot"}.items():
        assert r.restore(raw) == word


def test_search_is_exact(trained):
    """The best path of a small lattice, by trying all of them."""
    from itertools import product

    r: Restorer = trained[2].restorer

    def weight(parts):
        state, total = (0, 0, 0), sum(w for _, w in parts)
        for c in "".join(t for t, _ in parts):
            k = r._class(c)
            total += float(r.logp[state][k])
            state = (*state[1:], k)
        return total + float(r.logp[state][0])

    for word in ("1d10t", "a11", "b000k", "5+4", "é1!"):
        best = max(weight(p) for p in product(*r.lattice(word)))
        found = r.restore(word)
        assert any("".join(t for t, _ in p) == found and weight(p) == pytest.approx(best) for p in product(*r.lattice(word)))


def test_disguised_insults_are_found(trained):
    model = trained[2]
    clean = " ".join(PLAIN)
    plain = scores(model, clean)[0]
    for text in ("you idiot and moron", "you 1d10t and m0r0n", "you i d i o t and m o r o n", "you i.d.i.o.t and s-t-u-p-i-d", "you stuuupid loooser"):
        assert scores(model, clean + " " + text)[0] >= 0.5 > plain


@pytest.mark.parametrize("insult", ["1d107", "idio7", "$7up1d", "7r4$h", "10$3r", "idi000t", "l0sss", "iidiiot", "mmoron", "tr4$$h"])
def test_disguises_of_any_place(insult):
    """Substitutes with no letter after them, few letters left, letters doubled only."""
    assert Restorer._marks(np.frombuffer(insult.encode(), np.uint8), np.array([0, len(insult)])).any()


def test_more_disguised_insults_are_found(trained):
    model, clean = trained[2], " ".join(PLAIN)
    for text in ("1d107 7r4$h", "idio7 and m0r0nn", "iidiiot and ttrash", "IIDIOT $7UP1D"):
        assert scores(model, clean + " " + text)[0] >= 0.5


def test_repeated_letters_are_code_points(trained):
    raw = "un imb\u00e9\u00e9\u00e9cile".encode()
    assert Restorer._marks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).sum() == 2
    # rows that meet without a space don't mark each other's words
    assert not Restorer._marks(np.frombuffer(b"x-aa-x", np.uint8), np.array([0, 3, 6])).any()


@pytest.mark.parametrize("text", ["you are a m o r o n", "i d i o t m o r o n", "that mo ron is st u p id", "a st.up id i-d i.ot", "you are a m 0 r 0 n", "I d  i\to t and los er"])
def test_gaps_are_decided_by_the_language_model(trained, text):
    """Articles beside the letters, two insults in a row, gaps not at every letter, leet and gaps."""
    assert scores(trained[2], " ".join(PLAIN) + " " + text)[0] >= 0.5
    _, restored = trained[2].restorer.undisguise(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert any(w in INSULTS for _, t in restored for w in t.split())


def test_runs_left_out_are_those_whose_gaps_all_stay(trained):
    r: Restorer = trained[2].restorer
    rng = random.Random(3)
    pieces = [w[i : i + 3] for w in INSULTS + PLAIN for i in range(0, len(w), 2)] + ["o", "v", "\u00e9n", "over", "dogs", "and", "read"]
    hits = 0
    for _ in range(300):
        text = rng.choice([" ", " ", "-", "  ", "."]).join(rng.choice(pieces) for _ in range(rng.randint(2, 9)))
        raw = text.encode()
        data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        if (marks := Restorer._marks(data, offsets)).any():
            continue
        spans = r._spans(data, offsets, marks)[0]
        assert bool(spans) == (r.restore(text) != text)
        hits += bool(spans)
    assert 20 < hits


def test_clean_numbers_are_left_alone(trained):
    assert (scores(trained[2], "call 555 6268 or write to a1b2@mail.example on 3/4/2020 at 173.33.203.46", "model x100 costs $40 and 3rd class", "a b c d e f g h") < 0.5).all()


def test_held_out_accuracy(spark, trained):
    docs, table, model = trained
    got = toxicity.score(docs, model).join(table, "doc_id").withColumn("fold", toxicity.fold(F.col("doc_id"))).toPandas()
    own = got[got["fold"] == 0]
    assert len(own) > 100 and ((own["score"] >= 0.5) == (own["toxic"] == 1)).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_held_out_labels_are_not_used(spark, trained):
    docs, table, model = trained
    turned = table.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, turned)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.coef, again.coef)


def test_scores_depend_on_the_text_alone(trained):
    model = trained[2]
    texts = [t for _, t in corpus(60, 2)[0]]
    together = scores(model, *texts)
    assert [scores(model, t)[0] for t in texts] == together.tolist()


def test_rejecting(spark, trained):
    docs, _, model = trained
    all_rows, kept = toxicity.score(docs, model), toxicity.score(docs, model, reject=0.5)
    assert kept.columns == [*docs.columns, "score"]
    assert sorted(kept.collect()) == sorted(all_rows.where("score < 0.5").collect())


def test_odd_rows(spark, trained):
    docs = clashing(documents(spark, ODD))
    got = toxicity.score(docs, trained[2]).select("doc_id", "score").collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.5 for r in got)
    empties = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empties) == 1


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 1, 1), (1, 1, 1)], [(None, 1, 1), (1, None, None), (0, 1, 0), (0, 1, 1)]])
def test_few_labels(spark, labels):
    docs = documents(spark, ["a b", "c d", None])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())


def test_empty_table(spark, trained):
    none = spark.createDataFrame([], DOCS)
    model = toxicity.train(none, trained[1])
    assert toxicity.score(none, model).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_on_the_test_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, table = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, table)).join(table, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.9


def test_a_task_lets_go_of_its_memo(trained, monkeypatch):
    """Before its end, when memory is given back; what goes later stays with an idle worker."""
    docs, _, model = trained
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: work)
    work, held = toxicity.score(docs, model), []
    table = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a st00pid m0ron", "lang": "en", "source": "s", "n_chars": 15}])
    monkeypatch.setattr("planframe.llm.common.release_memory", lambda: held.append((len(model.restorer.memo), model.restorer._flat)))
    for _ in work(iter([table])):
        assert model.restorer.memo
    assert held == [(0, None)]
