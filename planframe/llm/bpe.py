"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings. All new distinct
pre-tokens of a batch are looked up together; a slot holds one candidate, whose bytes
are compared, so a hit is certain. Tier two: a miss is merged byte by byte with a heap
of ranked neighbouring pairs over a doubly linked list.

A bounded memo in each Python worker keeps the ids of recent pre-tokens. The vocabulary
is shipped with the task: its size is that of the vocabulary file, whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, free_names, mix, tidy, utf8
from .pretokens import splitter

#: The memo starts anew beyond so many entries, or so many bytes of pre-tokens and ids.
MEMO_ENTRIES, MEMO_BYTES = 200_000, 1 << 25
_U = np.uint64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each byte string: bytes folded by place, eight at a time."""
    out = np.diff(offsets).astype(np.uint64)
    lengths = np.diff(offsets)
    for k in range(int(lengths.max(initial=0))):
        use = np.flatnonzero(lengths > k)
        out[use] = (out[use] ^ data[offsets[use] + k].astype(np.uint64)) * _U(0x100000001B3) + (out[use] >> _U(29))
    return mix(out)


class PerfectHash:
    """A minimal perfect hash of n distinct byte strings to n slots (hash and displace).

    Keys fall into buckets; buckets are placed largest first, each with the first
    displacement that sends all its keys to free slots. ``find`` answers with the number
    of each string among the keys, or -1; it compares the bytes, so it is exact.
    """

    LONGEST = 256  # longer strings are no keys and aren't hashed; a vocabulary with one is refused

    def __init__(self, strings: list[bytes]):
        column = pa.array(strings, pa.binary())
        self.data, self.offsets = utf8(column)
        n = self.n = len(strings)
        if max(map(len, strings), default=0) > self.LONGEST:
            raise ValueError(f"a vocabulary string has more than {self.LONGEST} bytes")
        self.buckets = max(1, n // 4)
        keys = _keys(self.data, self.offsets)
        if len(np.unique(keys)) != n:
            raise ValueError("two vocabulary strings have one key")
        where = (keys % _U(self.buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        starts = np.searchsorted(where[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot = np.full(n, -1, np.int32)
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            d, step = 0, 64
            while True:  # a block of displacements at a time
                tries = np.arange(d, d + step, dtype=np.uint64)
                at = self._place(keys[own][None, :], tries[:, None])
                ok = free[at].all(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                good = np.flatnonzero(ok)
                if len(good):
                    self.shift[b] = tries[good[0]]
                    self.slot[at[good[0]]] = own
                    free[at[good[0]]] = False
                    break
                d, step = d + step, min(step * 2, 8192)

    def _place(self, keys, shifts):
        return (mix(keys + (shifts + _U(1)) * _U(0x9E3779B97F4A7C15)) % _U(self.n)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, -1, np.int64)
        lengths = np.diff(offsets)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.LONGEST))
        if not len(short):
            return out
        # the strings side by side, without the long ones
        take = np.repeat(offsets[short] - np.concatenate([[0], np.cumsum(lengths[short])[:-1]]), lengths[short]) + np.arange(lengths[short].sum())
        own, begin = data[take], np.concatenate([[0], np.cumsum(lengths[short])])
        keys = _keys(own, begin)
        candidate = self.slot[self._place(keys, self.shift[(keys % _U(self.buckets)).astype(np.int64)])]
        same = np.diff(self.offsets)[candidate] == lengths[short]
        at = np.flatnonzero(same)
        if len(at):
            n = lengths[short][at]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            inner = np.arange(n.sum()) - np.repeat(first, n)
            equal = own[np.repeat(begin[at], n) + inner] == self.data[np.repeat(self.offsets[candidate[at]], n) + inner]
            hit = np.logical_and.reduceat(equal, first)
            out[short[at[hit]]] = candidate[at[hit]]
        return out


class Codec:
    """A vocabulary with its perfect hash; ``encode`` gives ids as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ids = np.array(list(ranks.values()), np.uint32)
        self.strings = list(ranks)
        self.hash = PerfectHash(self.strings)
        self._ready = False

    def __getstate__(self):
        return self.__dict__ | {"_ready": False, "memo": None, "memo_bytes": 0, "pairs": None, "two": None, "single": None, "text_data": None, "text_start": None, "text_size": None}

    def prepare(self) -> None:
        """What the merges and decoding need; made in the worker, once."""
        if self._ready:
            return
        ranks = dict(zip(self.strings, self.ids.tolist(), strict=True))
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ids of 20 bits at most")
        self.single = [ranks[bytes([b])] for b in range(256)]
        # every way to put a vocabulary string together from two others
        self.pairs = {
            (ranks[s[:i]] << 20) | ranks[s[i:]]: r for s, r in ranks.items() for i in range(1, len(s)) if s[:i] in ranks and s[i:] in ranks
        }
        byte_pairs = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        self.two = lambda a, b: byte_pairs[a][b]
        # token strings by id, for decoding
        order = np.argsort(self.ids)
        self.text_data, offsets = utf8(pa.array([self.strings[i] for i in order], pa.binary()))
        self.text_start = np.zeros(int(self.ids.max()) + 1, np.int64)
        self.text_size = np.zeros_like(self.text_start)
        self.text_start[self.ids[order]], self.text_size[self.ids[order]] = offsets[:-1], np.diff(offsets)
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0
        self._ready = True

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a string by merging the lowest-ranked neighbouring pair, leftmost first.

        A heap entry is rank and place in one integer. ``after`` and ``before`` link the
        parts that are left; a part that went into its left neighbour has id -1.
        """
        single, find, n = self.single, self.pairs.get, len(piece)
        ids = [single[b] for b in piece]
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(map(self.two, piece, piece[1:])) if r is not None]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        ids.append(-2)  # an end that no pair has
        while heap:
            top = heappop(heap)
            r, i = top >> bits, top & mask
            left, j = ids[i], after[i]
            # an entry is stale when either side has been merged since
            if left < 0 or find(left << 20 | ids[j]) != r:
                continue
            k = after[i] = after[j]
            ids[i], ids[j] = r, -1
            before[k] = i
            x = find(r << 20 | ids[k])
            if x is not None:
                heappush(heap, x << bits | i)
            h = before[i]
            if h >= 0:
                x = find(ids[h] << 20 | r)
                if x is not None:
                    heappush(heap, x << bits | h)
        return [x for x in ids if x >= 0]

    def _learn(self, new: list[str]) -> None:
        """Both tiers for pre-tokens that the memo lacks."""
        data, offsets = utf8(pa.array(new, pa.large_string()))
        found = self.hash.find(data, offsets)
        ids, memo, merge = self.ids.tolist(), self.memo, self.merge
        for piece, at in zip(new, found.tolist(), strict=True):
            memo[piece] = own = array("I", (ids[at],) if at >= 0 else merge(piece.encode())).tobytes()
            self.memo_bytes += len(piece) + len(own)

    def _trim(self) -> None:
        if len(self.memo) > MEMO_ENTRIES or self.memo_bytes > MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        self.prepare()
        split, out = splitter(self.pattern), []
        self._trim()
        pieces, new, size = [], set(), 0
        for i, text in enumerate(texts):
            pieces.append(own := split(text))
            new |= set(own).difference(self.memo)
            size += len(own)
            if size > 100_000 or i == len(texts) - 1:
                if new:
                    self._learn(list(new))
                get = self.memo.__getitem__
                out += [b"".join(map(get, p)) for p in pieces]
                pieces, new, size = [], set(), 0
                self._trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        self.prepare()
        own = np.frombuffer(ids, "<u4")
        out = []
        for i in range(0, len(own), 1 << 16):
            part = own[i : i + (1 << 16)]
            size = self.text_size[part]
            ends = np.cumsum(size)
            take = np.repeat(self.text_start[part] - (ends - size), size) + np.arange(ends[-1])
            out.append(self.text_data[take].tobytes())
        return b"".join(out)


_codecs: dict[tuple, Codec] = {}
KEPT[__name__] = _codecs.clear


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def _shared(key: tuple, made: Codec) -> Codec:
    """One codec for each worker process, so that its memo lives on between tasks."""
    return _codecs.setdefault(key, made)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_tokens`` (long) and ``token_ids`` (ids as little-endian uint32).

    Null and empty texts give no ids. Rows stay as they are, repeats included; an empty
    table gives an empty result. Nothing is shuffled.
    """
    made, key = codec(path, pattern), (path, pattern)

    def work(batches):
        own = _shared(key, made)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = own.encode_batch(texts)
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n, pa.array(ids, pa.binary())], [*keep, "n_tokens", "token_ids"])

    (text,) = free_names(docs.select(*keep), "text")
    chosen = docs.select(*keep, F.col(text_col).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(tidy(work), f"{schema}, n_tokens long, token_ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode every text, decode the ids.

    Null counts as empty. Digests are lower-case hex. Repeated rows stay and equal texts
    agree; an empty table gives an empty result. Other columns are not read.
    """
    made, key = codec(path, pattern), (path, pattern)

    def work(batches):
        own = _shared(key, made)
        for batch in batches:
            ids = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(work), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
