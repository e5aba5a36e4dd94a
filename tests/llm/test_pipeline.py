"""Each stage on what the one before kept, against plain Python."""

import os
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import DOCS, ODD, clashing, documents, shingles_of
from test_linededup import brute as lines_brute

import corpus_pipeline
from planframe.llm import bpe, toxicity

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    docs, held = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append([tuple(r) for r in docs.select(COLUMNS).collect()])
        if k == 0:
            model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    start, clean, lines, once, mixed = held
    assert sorted(clean) == sorted(r for r in start if scores[r[0]] < 0.5) and len(clean) < len(start)

    expected = lines_brute([(r[0], r[1]) for r in clean])
    want = [(r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]) for r, t in zip(clean, expected, strict=True) if t == r[1] or t.split()]
    assert sorted(lines) == sorted(want)

    sets = {r[0]: shingles_of(r[1], 5) for r in lines}
    left, groups = dict(sets), []
    while left:
        todo = [min(left)]
        seen = {todo[0]}
        while todo:
            a = sets[todo.pop()]
            near = {d for d, s in left.items() if d not in seen and a and s and 100 * len(a & s) >= 80 * len(a | s)}
            seen |= near
            todo += near
        groups.append(min(seen))
        for d in seen:
            del left[d]
    assert sorted(r[0] for r in once) == sorted(groups) and set(once) <= set(lines)

    assert set(mixed) <= set(once) and max(Counter(r[0] for r in mixed).values()) <= 3

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r[0]: r[1] for r in mixed}
    out = docs.collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in mixed)
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.fixture
def labelled(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i == 6)) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_empty_tables(spark, labelled, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (documents(spark, ODD), spark.createDataFrame([], DOCS), clashing(documents(spark, ODD[:5]))):
        out = stage(spark, docs, labelled)
        rows = out.collect()
        assert k == 4 or out.columns == docs.columns
        assert docs.isEmpty() or rows
        if k < 4:  # each row that stays is as it was, but for the lines that it loses
            given = {tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in docs.collect()}
            assert {tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in rows} <= given
