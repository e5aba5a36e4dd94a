"""Token counts with a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is put to the library by itself:
those that come back as one token are proven. A pre-token that is a proven string counts
as one token without any merging; only the rest is merged, by the library, once for each
distinct pre-token that a worker's bounded memo lacks.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, tidy
from .pretokens import splitter

#: The memo starts anew beyond so many entries, or so many characters of pre-tokens not proven whole.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 1 << 25


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from
    256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def prove(path: str, pattern: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """(vocabulary strings that alone encode as one token, added special strings)."""
    with open(path) as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"] or {}
    added = spec.get("added_tokens", [])
    if (
        spec.get("normalizer")
        or before.get("type") != "ByteLevel"
        or before.get("add_prefix_space")
        or not before.get("use_regex", True)
        or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    ):
        raise ValueError(f"{path}: only a plain byte-level tokenizer has this shortcut")
    special = tuple(a["content"] for a in added)
    letters, texts = _byte_letters(), []
    for token in spec["model"]["vocab"]:
        if token in special or not all(c in letters for c in token):
            continue
        try:
            texts.append(bytes(letters[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    split, library = splitter(pattern), _library(path)
    texts = [t for t in texts if split(t) == [t]]
    coded = library.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, coded, strict=True) if len(e.ids) == 1), special


class Counter:
    def __init__(self, path: str, pattern: str, proven: frozenset[str], special: tuple[str, ...]):
        self.path, self.pattern, self.proven, self.special = path, pattern, proven, special
        self.library, self.memo, self.memo_chars = None, {}, 0
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __getstate__(self):
        return self.__dict__ | {"library": None, "memo": {}, "memo_chars": 0}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; an added special string within a text counts as one."""
        split = splitter(self.pattern)
        self.library = self.library or _library(self.path)
        self._trim()
        out = []
        for text in texts:
            parts = [text] if self.cut is None or not self.cut.search(text) else self.cut.split(text)
            total = len(parts) - 1
            for part in parts:
                pieces = split(part)
                if new := list(set(pieces).difference(self.memo)):
                    for piece, coded in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
                        self.memo[piece] = len(coded.ids)
                        self.memo_chars += len(piece)
                total += sum(map(self.memo.__getitem__, pieces))
            out.append(total)
            self._trim()
        return out

    def _trim(self) -> None:
        if len(self.memo) > MEMO_ENTRIES or self.memo_chars > MEMO_CHARS or not self.memo:
            self.memo, self.memo_chars = dict.fromkeys(self.proven, 1), 0


_counters: dict[tuple, Counter] = {}
KEPT[__name__] = _counters.clear


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, repeats included.

    Null counts as empty: 0 bytes, 0 tokens. An empty table gives an empty result. The
    counts are the library's, without begin, end or padding tokens. Nothing is shuffled.
    """
    made, key = Counter(path, pattern, *prove(path, pattern)), (path, pattern)

    def work(batches):
        own = _counters.setdefault(key, made)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(work), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
