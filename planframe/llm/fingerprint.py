"""Document fingerprints: one-permutation MinHash, optimally densified, low bits packed.

Each word shingle is hashed once; the top bits choose one of ``BINS`` bins and a bin
keeps its least hash. An empty bin takes the value of the first filled bin in an order
of all bins that is its own and random, so donors are uniform and independent. Only
``BITS`` low bits of each bin are stored. Two fingerprints agree by chance in one bin
of ``2**BITS``; ``likeness`` takes that share out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, shingles, tidy

BINS = 512
BITS = 8
WIDTH = 5
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    """``bins`` is a power of two; ``bits`` is 1, 2, 4 or 8."""

    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH, seed: int = 1):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bins: a power of two; bits: 1, 2, 4 or 8")
        self.bins, self.bits, self.width, self.seed = bins, bits, width, seed
        self._order = None

    def __getstate__(self):
        return self.__dict__ | {"_order": None}

    def donors(self) -> np.ndarray:
        """Row j: the place of every bin in the order in which empty bin j asks."""
        if self._order is None:
            self._order = np.random.default_rng(self.seed).permuted(np.tile(np.arange(self.bins, dtype=np.int16), (self.bins, 1)), axis=1)
        return self._order

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x bins) low-order codes, and which rows have any shingle; null is empty."""
        out, some = np.zeros((len(column), self.bins), np.uint8), np.zeros(len(column), bool)
        top = _U(64 - self.bins.bit_length() + 1)
        for first, data, offsets in chunks(column):
            rows = len(offsets) - 1
            doc, h = shingles(Words(data, offsets), self.width)
            least = np.full(rows * self.bins, _EMPTY)
            np.minimum.at(least, doc * self.bins + (h >> top).astype(np.int64), h & ((_U(1) << top) - _U(1)))
            least = least.reshape(rows, self.bins)
            full = least != _EMPTY
            count = full.sum(axis=1)
            for r in np.flatnonzero((count > 0) & (count < self.bins)):
                have = np.flatnonzero(full[r])
                need = np.flatnonzero(~full[r])
                if len(have) == 1:
                    least[r, need] = least[r, have[0]]
                else:
                    least[r, need] = least[r, have[self.donors()[need[:, None], have].argmin(axis=1)]]
            out[first : first + rows] = (least & _U((1 << self.bits) - 1)).astype(np.uint8)
            some[first : first + rows] = count > 0
        return out, some

    def pack(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        """Hex strings of the packed bits; a text without words has the empty string."""
        if self.bits < 8:
            per = 8 // self.bits
            packed = np.zeros((len(codes), self.bins // per), np.uint8)
            for k in range(per):
                packed |= codes[:, k::per] << np.uint8(k * self.bits)
            codes = packed
        return [row.tobytes().hex() if s else "" for row, s in zip(codes, some, strict=True)]

    def unpack(self, packed: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = self.bins * self.bits // 8
        raw = np.frombuffer(b"".join(bytes.fromhex(p) or bytes(size) for p in packed), np.uint8).reshape(-1, size)
        per = 8 // self.bits
        out = np.zeros((len(raw), self.bins), np.uint8)
        for k in range(per):
            out[:, k::per] = raw >> np.uint8(k * self.bits) & np.uint8((1 << self.bits) - 1)
        return out, np.array([bool(p) for p in packed], bool)

    def likeness(self, a: np.ndarray, has_a: np.ndarray, b: np.ndarray, has_b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard likeness of rows: 1 for two texts without words, 0 for one such."""
        chance = 2.0**-self.bits
        share = (a == b).mean(axis=1)
        j = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
        return np.where(has_a & has_b, j, np.where(has_a | has_b, 0.0, 1.0))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", maker: Fingerprinter | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (hex string) of every row; nothing is shuffled.

    Null texts count as empty; a text without words has the empty string. Equal texts
    have equal fingerprints. An empty table gives an empty result.
    """
    maker = maker or Fingerprinter()

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maker.pack(*maker.codes(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidy(work), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: Documents of a range of ids, and ranges at most (their bounds go to every task).
RANGE_ROWS, MOST_RANGES = 4096, 65536


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Deal documents into ranges of ids, sorted by descending id, ready to be read in pairs.

    Columns ``range, guest, id, text``. Rows of a range follow one another, then comes the
    guest: a copy of the row that follows the range's last one (after the last of all: the
    first of all). Ties and repeats are in order of the text; null ids come last. Whole
    texts are shuffled once; no task has more than its range.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("id"))
    n = ids.count()
    ranges = int(min(MOST_RANGES, max(1, -(-n // RANGE_ROWS))))
    cuts: list[int] = []
    if ranges > 1:
        at = F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))
        cuts = sorted(set(ids.agg(at.alias("q")).first()["q"]))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, id.to_numpy(), "right").astype(np.int32))

    # the largest id of each range that has rows: at most MOST_RANGES rows
    tops = sorted((r["range"], r["top"]) for r in ids.groupBy(range_of("id").alias("range")).agg(F.max("id").alias("top")).collect())
    asked_by = np.array([tops[(i + 1) % len(tops)][0] for i in range(len(tops))], np.int32)
    top_ids = np.array([t for _, t in tops], np.int64)

    @F.pandas_udf("array<int>")
    def places(id: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, id.to_numpy(), "right") * 2
        out = [[x] for x in own.tolist()]
        if len(top_ids):
            at = np.minimum(np.searchsorted(top_ids, id.to_numpy()), len(top_ids) - 1)
            for i in np.flatnonzero(top_ids[at] == id.to_numpy()):
                out[i].append(int(asked_by[at[i]]) * 2 + 1)
        return pd.Series(out)

    dealt = (
        docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("id", "text", F.explode(places("id")).alias("place"))
        .select(F.expr("place div 2").cast("int").alias("range"), (F.col("place") % 2).alias("guest"), "id", "text")
    )
    parts = len(bounds) + 1
    return dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "guest", F.desc("id"), "text")


def edited_likeness(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", maker: Fingerprinter | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first
    as many of the next document's, by descending id. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. One row per
    input row; null texts are empty, a null id comes last. A single document is its own
    next one.
    """
    maker = maker or Fingerprinter()

    def work(batches):
        text, where, guest, ident = [], [], [], []  # the row that waits for its next one
        codes, some = np.zeros((0, maker.bins), np.uint8), np.zeros(0, bool)
        for batch in batches:
            c, s = maker.codes(batch.column("text"))
            codes, some = np.concatenate([codes, c]), np.concatenate([some, s])
            text += batch.column("text").to_pylist()
            where += batch.column("range").to_pylist()
            guest += batch.column("guest").to_pylist()
            ident += batch.column("id").to_pylist()
            at = [i for i in range(len(text) - 1) if not guest[i] and where[i] == where[i + 1]]
            if at:
                edited = []
                for i in at:
                    m = len(text[i]) // 3
                    edited.append(text[i][: len(text[i]) - m] + text[i + 1][:m])
                e, has = maker.codes(pa.array(edited, pa.large_string()))
                a = np.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if ident[i] == -(1 << 63) else ident[i] for i in at], pa.int64()),
                        pa.array([len(text[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                        pa.array(maker.pack(codes[a], some[a]), pa.string()),
                        pa.array(maker.pack(e, has), pa.string()),
                        pa.array(maker.likeness(codes[a], some[a], e, has)),
                        pa.array(maker.likeness(codes[a], some[a], codes[a + 1], some[a + 1])),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            text, where, guest, ident, codes, some = text[-1:], where[-1:], guest[-1:], ident[-1:], codes[-1:], some[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, id_col, text_col).mapInArrow(tidy(work), schema)
