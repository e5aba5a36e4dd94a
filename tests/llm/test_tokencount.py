import public_tokenizers as P
import pytest
from llm_helpers import DOCS, ODD, clashing, documents
from test_bpe import random_texts

from planframe.llm import tokencount

PATH = P.path("byte_bpe_50k.json")


def library_counts(texts):
    return [len(e.ids) for e in tokencount._library(PATH).encode_batch(texts, add_special_tokens=False)]


def test_proof():
    proven, special = tokencount.prove(PATH, P.PATTERN)
    some = sorted(proven)[::97]
    assert len(proven) > 40_000 and special == ("<|endoftext|>",) and set(library_counts(some)) == {1}


def test_counts_are_the_library_s():
    texts = random_texts(500) + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", " <|endoftext|>x"] + [t or "" for _, t in ODD]
    counter = tokencount.Counter(PATH, P.PATTERN, *tokencount.prove(PATH, P.PATTERN))
    assert counter.count(texts) == library_counts(texts)


def test_query(spark):
    got = tokencount.count_tokens(clashing(documents(spark, ODD)), PATH, P.PATTERN).collect()
    counts = library_counts([t or "" for _, t in ODD])
    expected = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(ODD, counts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS), PATH, P.PATTERN).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokencount.prove(P.path("word_bpe_49k.json"), P.PATTERN)
