"""How often hashed tokens occur, and an order of tokens by rarity that every task knows.

Counting: each task tallies its tokens in memory and hands them out packed, one row for
each bucket of tokens, so the shuffle moves buckets and not tokens. All tokens are counted.

Order: the most frequent tokens are known with their exact counts, as many as a table of
fixed size holds. Where more tokens than that are frequent, a second table of fixed size
has the class (base-2 logarithm of the count) of the others, the largest one where several
share a cell. Any order that all tasks agree on gives right results; this one keeps
frequent tokens last whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tidy

#: Tokens of the exact table at most; it is sent to every task (16 bytes each).
MOST_HEAVY = 1 << 18
#: A token that occurs no more often than this counts as rare.
LEAST_HEAVY = 32
#: Cells of the table of classes, a byte each.
CLASS_CELLS = 1 << 22
#: Tokens that a task holds before it hands out its tally.
HELD = 1 << 20
#: Buckets of a tally; each holds the tokens of one range of hashes.
BUCKETS = 1 << 12
PACKED = "bucket int, blob binary"
_U = np.uint64
#: Records that are packed at once, and bytes of a batch of them (one bucket at least).
_PART, _BATCH = 1 << 24, 1 << 22
#: A task's count of a token is below 2**32; sums have 64 bits.
_COUNT = np.dtype([("token", "<i8"), ("n", "<u4")])
_SUM = np.dtype([("token", "<i8"), ("n", "<i8")])


def packed(records: np.ndarray, bucket: np.ndarray):
    """Batches of ``PACKED``: the records of each bucket as one row."""
    for i in range(0, len(records), _PART):
        own, of = records[i : i + _PART], bucket[i : i + _PART]
        by = np.argsort(of.astype(np.uint16) if 0 <= of.min() and of.max() < 1 << 16 else of, kind="stable")  # few bits are sorted faster
        own, of = own[by], of[by]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        ends = (np.append(first, len(own)) * own.itemsize).astype(np.int32)
        blobs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
        batch = pa.RecordBatch.from_arrays([pa.array(of[first].astype(np.int32)), blobs], ["bucket", "blob"])
        rows = max(1, len(first) * _BATCH // own.nbytes)
        for k in range(0, len(first), rows):
            yield batch.slice(k, rows)


def unpacked(batch: pa.RecordBatch, kind: np.dtype):
    """Yield (bucket, records) of the rows of a batch of ``PACKED``."""
    for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield bucket, np.frombuffer(blob.as_buffer(), kind)


class Tally:
    """The tokens of a task, counted."""

    def __init__(self):
        self.tokens, self.size = [], 0

    def add(self, tokens: np.ndarray):
        self.tokens.append(tokens)
        self.size += len(tokens)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if self.size:
            token, n = np.unique(np.concatenate(self.tokens), return_counts=True)
            records = np.empty(len(token), _COUNT)
            records["token"], records["n"] = token.view(np.int64), n
            self.tokens, self.size = [], 0
            yield from packed(records, (token >> _U(52)).astype(np.uint16))


def tallied(tallies: DataFrame) -> DataFrame:
    """(token, df) of the tokens that the tallies count twice or more."""

    def work(batches):
        held, size, now = [], 0, None

        def summed(least: int) -> np.ndarray:
            every = np.concatenate(held)
            every = every[np.argsort(every["token"])]
            first = np.flatnonzero(np.concatenate([[True], every["token"][1:] != every["token"][:-1]]))
            out = every[first]
            out["n"] = np.add.reduceat(every["n"], first)
            return out[out["n"] >= least]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out["token"])), pa.array(np.ascontiguousarray(out["n"]))], ["token", "df"])

        for batch in batches:
            for bucket, records in unpacked(batch, _COUNT):
                if bucket != now and size >= HELD // 4:
                    yield batch_of(summed(2))
                    held, size = [], 0
                elif size >= 2 * HELD:  # one bucket: tokens met again and again become one record
                    held = [summed(1)]
                    size = len(held[0])
                now = bucket
                held.append(records.astype(_SUM))
                size += len(records)
        if held:
            yield batch_of(summed(2))

    return tallies.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(work), "token long, df long")


class Order:
    """The place of each token in the order, 0 for rare ones; tokens of one place go by the hash.

    Tokens of the table have a place of their own, by count, after all others. ``low`` and
    ``high`` are tables of classes for the hashes below and from ``split``.
    """

    #: More than any class.
    FIRST = 64
    #: Places need so many bits at most.
    BITS = 20

    def __init__(self, token: np.ndarray, count: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, split: int = 0):
        by = np.argsort(token)
        self.token, count = token[by], count[by]
        rank = np.lexsort((self.token, count))
        self.place = np.empty(len(rank), np.int64)
        self.place[rank] = np.arange(len(rank)) + self.FIRST
        self.counts = count[rank]
        self.low, self.high, self.split = low, high, _U(split)
        # where the tokens with the same leading bits begin
        bits = max(4, len(token).bit_length() + 2)
        self.shift = _U(64 - bits)
        self.start = np.searchsorted(self.token >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def over(self, count: int) -> int:
        """The first place of tokens that occur more often than ``count``."""
        return self.FIRST + int(np.searchsorted(self.counts, count, "right"))

    def places(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for table, own in ((self.low, h < self.split), (self.high, h >= self.split)):
            if table is not None:
                at = np.flatnonzero(own)
                out[at] = table[(h[at] & _U(len(table) - 1)).astype(np.int64)]
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            found = self.token[here] == h[left]
            out[left[found]] = self.place[here[found]]
            at[left] += 1
            left = left[~found & (here + 1 < end[left])]
        return out

    def sorted(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, places): an order of the tokens by owner, place and hash; owners ascend already."""
        place = self.places(h)
        if not len(h) or not place.any():
            return np.arange(len(h)), place
        bits = 64 - int(owner[-1]).bit_length() - self.BITS
        if bits >= 8:
            key = ((owner.astype(np.uint64) << _U(self.BITS)) | place.astype(np.uint64)) << _U(bits) | (h >> _U(64 - bits))
            by = np.argsort(key)
            key = key[by]
            if not (key[1:] == key[:-1]).any():  # else hashes differ in bits that the key leaves out
                return by, place
        return np.lexsort((h, place, owner)), place


def heavy(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The most frequent tokens of (token, df), as many as the table may have, and the classes of the next ones."""
    steps = [LEAST_HEAVY << k for k in range(36)]
    row = counts.agg(*[F.count(F.when(F.col("df") > s, 1)).alias(f"c{k}") for k, s in enumerate(steps)]).first()
    least = next(s for k, s in enumerate(steps) if row[f"c{k}"] <= MOST_HEAVY)
    got = counts.where(F.col("df") > least).toArrow()
    classes = None
    if least > LEAST_HEAVY:
        cell = F.col("token").bitwiseAND(CLASS_CELLS - 1).alias("cell")
        others = counts.where((F.col("df") > LEAST_HEAVY) & (F.col("df") <= least))
        # a row for each cell at most
        rows = others.groupBy(cell).agg(F.max(F.floor(F.log2("df"))).alias("class")).toArrow()
        classes = np.zeros(CLASS_CELLS, np.uint8)
        classes[rows.column("cell").to_numpy()] = rows.column("class").to_numpy()
    return got.column("token").to_numpy().view(np.uint64), got.column("df").to_numpy(), classes


def counted(tallies: DataFrame) -> DataFrame:
    return checkpoint(tallied(tallies))
