"""Shared pieces: vectorised word hashing, Bloom filters, checkpoints, components.

The hashing works on the raw UTF-8 buffers of Arrow batches, in chunks of about
``CHUNK_BYTES`` of text (one text at least), so memory follows the longest text and
not the batch.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder of ``spark.checkpoint.dir``.

    Where the session has none: a folder of this machine if the master is local, else an
    error, as executors wouldn't see the files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "planframe-checkpoints"))
    out = df.checkpoint(eager=True)
    # Spark removes the shuffle files of plans that nothing refers to when the driver collects
    # its garbage; else they would stay on the executors' disks until the job ends
    del df
    sc._jvm.System.gc()
    return out


def stable(df: DataFrame) -> DataFrame:
    """``df``, checkpointed unless it reads files or checkpoints row by row.

    Operators number the rows and read them several times. A scan gives every row the same
    number each time, also when a lost executor's part is read anew; rows from a shuffle
    can come in another order.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = set(re.findall(r"^[\s:+-]*([A-Za-z]+)", plan, re.MULTILINE))
    return df if nodes <= {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation", "RelationV"} and not re.search(r"\b(rand|randn|uuid|shuffle|monotonically_increasing_id)\(", plan) else checkpoint(df)


#: What a worker keeps between the tasks of one operator: how to let go of it, by module.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(work):
    """``work`` for ``mapInArrow`` that lets go of what other operators kept, and gives what it has freed back to the system at its end.

    Workers outlive their tasks, and idle ones hold on to memory that others need.
    """
    owner = work.__module__

    def run(batches):
        for module, let_go in KEPT.items():
            if module != owner:
                let_go()
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has its own ways
        pass


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while f"__{w}".lower() in taken:
            w = f"_{w}"
        out.append(f"__{w}")
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser over uint64, in place on a copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes, offsets) of runs of rows with about ``limit`` bytes of text."""
    data, offsets = utf8(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: For 0 to 8 bytes: the bits of a little-endian word that hold them.
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words:
    """The words of a chunk: ``start``, ``end`` (bytes), ``doc`` (row) and 64-bit ``hash``.

    ``counts`` holds the number of words of each row and ``first`` its first word. Words
    are runs of bytes outside ``space`` (by default space and 9 to 13, the separators of
    every contract); hashes see A-Z as a-z.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None):
        n = len(data)
        solid = np.zeros(n + 2, bool)
        # space and 9 to 13, or the table given; uint8 arithmetic wraps
        np.logical_not((data == 32) | (data - np.uint8(9) < 5) if space is None else space[data], out=solid[1:-1])
        turns = np.flatnonzero(solid[1:] != solid[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        # a row's end within a run of solid bytes ends a word and begins the next
        at = offsets[1:-1]
        at = at[(at > offsets[:-2]) & (at < n)]
        at = at[solid[at] & solid[at + 1]]
        if len(at):
            self.start = np.insert(self.start, np.searchsorted(self.start, at), at)
            self.end = np.insert(self.end, np.searchsorted(self.end, at), at)
        first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(first)
        self.first = first[:-1]
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        low = np.zeros(n + 8, np.uint8)
        np.add(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=low[:n])
        # the eight bytes from each place on, as one number
        self._eight = np.ndarray((n + 1,), "<u8", low, 0, (1,))
        size = self.end - self.start
        h = (self._eight[self.start] & _BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _BASE)
        for k in range(8, int(size.max(initial=0)), 8):
            more = np.flatnonzero(size > k)
            x = h[more] * _BASE
            h[more] = (x ^ (x >> _U(32))) ^ (self._eight[self.start[more] + k] & _BYTES[np.minimum(size[more] - k, 8)])
        self.hash = mix(h * _BASE + _U(0x51ED))

    def beginning(self, k: int) -> np.ndarray:
        """Hashes of the words' first ``k`` bytes, 8 at most."""
        return mix((self._eight[self.start] & _BYTES[k]) * _BASE + _U(k))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of ``width`` words; a shorter non-empty row gives one window."""
    h, n = words.hash, len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n) - words.first[words.doc]
    left = words.counts[words.doc] - place
    full = np.flatnonzero(left >= width)
    out = np.zeros(len(full), np.uint64)
    for k in range(width):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[full + k])
    docs = words.doc[full]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            use = words.counts[short] > k
            extra[use] = mix(extra[use] * _U(0xA0761D6478BD642F) + h[words.first[short[use]] + k])
        extra = mix(extra + words.counts[short].astype(np.uint64))
        docs, out = np.concatenate([docs, short]), np.concatenate([out, extra])
    return docs, out


def distinct_sets(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort (row, hash) and drop repeats: hashes by row then value, with rows + 1 offsets."""
    bits = max(1, int(rows).bit_length())
    key = (doc.astype(np.uint64) << _U(64 - bits)) | (h >> _U(bits))
    order = np.argsort(key)
    key, doc, h = key[order], doc[order], h[order]
    if len(h):
        same = key[1:] == key[:-1]
        if (same & (h[1:] != h[:-1])).any():  # hashes that differ in their last bits only
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        keep = np.ones(len(h), bool)
        keep[1:] = ~same
        doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(rows + 1)), doc


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of uint64 segments, modulo 2**64; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64), out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Bloom:
    """A Bloom filter over 64-bit keys: no false negatives at any input size.

    It is built by an aggregation on the executors, of 12 to 24 bits a key up to
    ``2**MOST_BITS`` in all (32 MB, which every task gets). With more keys than fit it passes
    more, which costs time and never changes a result.
    """

    PROBES = 2
    LEAST_BITS, MOST_BITS = 18, 28

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        keys = keys.astype(np.uint64, copy=False) if keys.dtype != np.int64 else keys.view(np.uint64)
        return [mix(keys + _U(Bloom.salt(k))) >> _U(64 - bits) for k in range(Bloom.PROBES)]

    @staticmethod
    def salt(k: int) -> int:
        return 0x632BE59BD9B4E019 * (k + 1) % (1 << 64)

    @classmethod
    def build(cls, df: DataFrame, bits: int | None = None) -> "Bloom":
        """From the first column (long, not null) of ``df``; sized by the number of rows unless ``bits`` are given."""
        bits = bits or min(max((12 * df.count()).bit_length(), cls.LEAST_BITS), cls.MOST_BITS)

        from .rarity import PACKED, packed, unpacked

        word = np.dtype([("w", "<i4"), ("v", "<u8")])

        def words(batches):
            own = None
            for batch in batches:
                if own is None:
                    own = np.zeros(1 << (bits - 6), np.uint64)
                for slot in cls.slots(np.asarray(batch.column(0), np.int64), bits):
                    np.bitwise_or.at(own, (slot >> _U(6)).astype(np.int64), _U(1) << (slot & _U(63)))
            if own is not None:
                at = np.flatnonzero(own)
                records = np.empty(len(at), word)
                records["w"], records["v"] = at, own[at]
                if len(at):
                    yield from packed(records, at >> 12)

        def merged(batches):
            own, now = np.zeros(1 << 12, np.uint64), None
            for batch in batches:
                for block, records in unpacked(batch, word):
                    if block != now and now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([own.tobytes()])], ["bucket", "blob"])
                        own[:] = 0
                    now = block
                    own[records["w"] & 4095] |= records["v"]
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([own.tobytes()])], ["bucket", "blob"])

        blocks = df.mapInArrow(tidy(words), PACKED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(merged), PACKED).toArrow()
        out = np.zeros(max(1 << (bits - 6), 1 << 12), np.uint64)
        for batch in blocks.to_batches():
            for block, own in unpacked(batch, np.dtype("<u8")):
                out[block << 12 : (block + 1) << 12] = own
        return cls(out, bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in self.slots(keys, self.bits):
            found &= (self.words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1
        return found


def with_filter(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with the boolean column ``flag``: false only where ``key`` isn't in the first column of ``keys``.

    A Bloom filter as in ``Bloom``, built and asked by the JVM, for rows that shouldn't pass
    through Python: one row with an array, of the same bound, is joined to all rows.
    """
    bits = min(max((12 * keys.count()).bit_length(), 10), Bloom.MOST_BITS)
    (words,) = free_names(df, "words")

    def slots(column):
        return [F.shiftrightunsigned(F.xxhash64(column, F.lit(k)), 64 - bits) for k in range(Bloom.PROBES)]

    each = keys.select(F.explode(F.array(*slots(F.col(keys.columns[0])))).alias("s"))
    rows = each.groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v")).toArrow()
    own = np.zeros(1 << (bits - 6), np.int64)
    own[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    one = df.sparkSession.createDataFrame(pa.table({words: pa.array([own])}))
    found = reduce(lambda a, b: a & b, [F.getbit(F.get(words, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1 for s in slots(F.col(key))])
    return df.join(F.broadcast(one)).withColumn(flag, found).drop(words)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, comp), comp the least node.

    Alternates large-star and small-star steps, each an aggregation and a join on the
    edge list, until the edges stop changing; every step ends in a checkpoint. No step
    gathers a node's neighbours in one place: a hub is one aggregated row, and its
    edges stay spread over the join that adaptive execution can split.
    """
    now = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if n == 0 or (n, s) == last:
            break
        last = (n, s)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # a > b in every edge now; the small star joins a node's smaller neighbours to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        now = checkpoint(small)
    return now.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps: (mean, scale, coefficients with the constant last)."""
    weight = weight * len(weight) / weight.sum()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    keep = np.eye(len(b)) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b
