"""N-gram Jaccard self-join by a size-aware heavy-light split.

A document is the set of its word shingles. Two sets link when
``100 * |A and B| >= percent * |A or B|``.

* Small sets (size up to a boundary) enumerate their subsets of each size that a link
  between them can have in common; two small sets link exactly when they share such a
  subset of a large enough size.
* Large sets scan inverted lists. A set enters the lists of its first
  ``n - ceil(percent/100 * n) + 1`` shingles in one global order, rare ones first, so
  two linked sets meet in a list; length and position bound their overlap, and pairs
  that pass, and whose parity sketches allow a link, are verified on whole texts.

The boundary is where the cost of enumerating overtakes that of scanning, on the counts
of sets of each size. Shingles that occur in one set only are in no list.

Links are wanted for their components, so a list of n sets isn't turned into n * n
pairs. First every set is verified against one set that it meets most often as the
smallest of a list (a star). The lists that still hold sets of different components are
then compared by sketches, across components only, in blocks of bounded size: sets that
may link, by whatever chain, form a cluster. At last the sets of a cluster are compared
whole, in one place or block by block. What leaves a task at either step is a forest, as
a pair that the task has joined already says nothing new: fewer rows than sets, whatever
the number of pairs. Two sets of one component need no further link, and linked sets are
in one cluster, so nothing is lost.

Equal sets are one class from the start. Sets and shingles go by 64-bit hashes: two
different sets of n are mistaken for one with probability below n * n / 2**65.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Words, checkpoint, chunks, components, distinct_sets, mix, segment_sum, shingles, stable, tidy
from .rarity import PACKED, Order, Tally, counted, heavy

WIDTH = 4
PERCENT = 85
#: Shingles in this first part of the hash range are counted in all documents; the rest
#: only in documents that have too few rare ones there to fill their prefix.
COUNTED = 0.25
#: What verifying one candidate costs, in list entries.
VERIFY_COST = 20
#: Longs of a set's parity sketch.
SKETCH = 8
#: Sketches of larger sets than this take a sample, of at most so many shingles; a link is
#: taken for impossible where the sample's difference is so many standard deviations above
#: the most that a link allows (a chance below 1e-15).
WHOLE, SAMPLED, DEVIATIONS = 1000, 320, 11.0
#: Largest size for which subsets are considered.
MOST_SMALL = 24
#: Entries of a list, and shingles of their sets, that a block has on average at most. The
#: entries of a longer list are dealt into blocks, and each two of these meet in one place.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
_U = np.uint64
_SPLIT = _U(int(COUNTED * 2**64))


def least_overlap(n, percent: int):
    """Fewest shingles that a set of n shares with any set that it links to."""
    return -(-n * percent // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, j) for j in range(n - least_overlap(n, percent) + 1))


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """Sets up to this size enumerate subsets: least cost over the counts of sizes."""
    best = (0, 0)
    gain = 0
    for n in range(1, MOST_SMALL + 1):
        prefix = n - least_overlap(n, percent) + 1
        gain += sizes.get(n, 0) * (prefix * (1 + VERIFY_COST) - subset_count(n, percent))
        if gain >= best[0] and subset_count(n, percent) <= 2 * prefix * (1 + VERIFY_COST):
            best = (gain, n)
    return best[1]


class Sets:
    """Distinct shingle sets of the rows of a chunk: ``h`` by row then value, ``at`` offsets."""

    def __init__(self, data, offsets, width: int):
        rows = self.rows = len(offsets) - 1
        doc, h = shingles(Words(data, offsets), width)
        self.h, self.at, self.doc = distinct_sets(doc, h, rows)
        self.n = np.diff(self.at)
        self.sid = mix(segment_sum(mix(self.h ^ _U(0x5EED5E7)), self.at) + self.n.astype(np.uint64)).view(np.int64)


def level(n):
    """Sketches of sets of n take the shingles of one in ``2**level`` hashes."""
    n = np.asarray(n, np.int64)
    return np.where(n <= WHOLE, 0, np.ceil(np.log2(np.maximum(n, 1) / SAMPLED))).astype(np.int32)


def parity_sketches(h: np.ndarray, doc: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """(rows x SKETCH) longs: for each of ``64 * SKETCH`` bins of hashes, whether it holds an odd number of the row's sample."""
    rows, bins = len(levels), 64 * SKETCH
    h = mix(h)
    if levels.any():
        taken = (h >> _U(32)) & ((_U(1) << levels.astype(np.uint64)) - _U(1))[doc] == 0
        h, doc = h[taken], doc[taken]
    odd = np.bincount(doc * bins + (h % _U(bins)).astype(np.int64), minlength=rows * bins) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bins), axis=1).view(np.int64)


def both_sketches(h: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, sketches, sketches at the level of the largest set that each may link to, 0 where that is its own)."""
    own, above = level(n), level(100 * n.astype(np.int64) // percent)
    sketch, other = parity_sketches(h, doc, own), np.zeros((len(n), SKETCH), np.int64)
    rows = np.flatnonzero(own != above)
    if len(rows):
        place = np.full(len(n), -1)
        place[rows] = np.arange(len(rows))
        of = place[doc]
        other[rows] = parity_sketches(h[of >= 0], of[of >= 0], above[rows])
    return own, sketch, other


_PARITY = [f"{c}{i}" for c in "su" for i in range(SKETCH)]


def _may_link(x: str, y: str, percent: int):
    """Whether sketches allow the likeness asked for; ``x`` has no more shingles than ``y``.

    A bin whose parity differs holds a shingle that only one of the sets has, so the
    differing bins are no more than the shingles outside the overlap: exact at any size
    where the sketches aren't of samples.
    """
    own = [F.when(F.col(f"{x}.lv") == F.col(f"{y}.lv"), F.col(f"{x}.s{i}")).otherwise(F.col(f"{x}.u{i}")) for i in range(SKETCH)]
    differ = reduce(lambda a, b: a + b, [F.bit_count(c.bitwiseXOR(F.col(f"{y}.s{i}"))) for i, c in enumerate(own)])
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    most = total * ((100 - percent) / (100 + percent)) / F.pow(F.lit(2.0), F.col(f"{y}.lv"))
    return F.when(F.col(f"{y}.lv") == 0, 100 * (total - differ) >= percent * (total + differ)).otherwise(differ <= most + DEVIATIONS * F.sqrt(most))


def _near(lv: np.ndarray, sketch: list[np.ndarray], other: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """``_may_link`` for arrays of sketches."""
    same = lv[x] == lv[y]
    differ = sum(np.bitwise_count((np.where(same, s[x], u[x]) ^ s[y]).view(np.uint64)).astype(np.int64) for s, u in zip(sketch, other, strict=True))
    total = n[x].astype(np.int64) + n[y]
    most = total * ((100 - percent) / (100 + percent)) / 2.0 ** lv[y]
    return np.where(lv[y] == 0, 100 * (total - differ) >= percent * (total + differ), differ <= most + DEVIATIONS * np.sqrt(most))


def _new_rows(sets: Sets, seen: set[int], bound: int = 1 << 20) -> np.ndarray:
    """Rows whose set this task has not had before (as far as a bounded memory tells)."""
    keep = np.zeros(len(sets.n), bool)
    if len(seen) > bound:
        seen.clear()
    for i, s in enumerate(sets.sid.tolist()):
        if sets.n[i] and s not in seen:
            seen.add(s)
            keep[i] = True
    return keep


def _counts(docs: DataFrame, width: int, percent: int, order: Order | None, least_n: int) -> DataFrame:
    """(token, df) of shingles that occur in two sets or more.

    Without ``order``: those of the counted range, over all documents. With it: all the
    others, over the documents whose rare shingles of the counted range don't fill the
    prefix; no other document has them in its prefix.
    """

    def work(batches):
        seen: set[int] = set()
        tally = Tally()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                s = Sets(data, offsets, width)
                use = _new_rows(s, seen)
                low = s.h < _SPLIT
                if order is None:
                    h = s.h[use[s.doc] & low]
                else:
                    rare = low & (order.places(s.h) == 0)
                    have = segment_sum(rare.astype(np.uint64), s.at).astype(np.int64)
                    use &= (have < s.n - least_overlap(s.n, percent) + 1) & (s.n >= least_n)
                    h = s.h[use[s.doc] & ~low]
                yield from tally.add(h)
        yield from tally.flush()

    return counted(docs.select("text").mapInArrow(tidy(work), PACKED))


def _entries(docs: DataFrame, width: int, percent: int, order: Order, shared: Bloom, small: int, least_n: int) -> DataFrame:
    """Entries (token, size, sid, n, pos, prev): ``size`` 0 for lists, a subset's size otherwise.

    ``prev`` is the token of the set's entry before this one, 0 for its first.
    """

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                s = Sets(data, offsets, width)
                use = _new_rows(s, seen)
                # lists
                by, _ = order.sorted(s.h, s.doc)
                h, doc = s.h[by], s.doc
                pos = np.arange(len(h)) - s.at[doc]
                n = s.n[doc]
                pick = use[doc] & (n >= least_n) & (pos < n - least_overlap(n, percent) + 1)
                pick[pick] = shared.has(h[pick])
                token, sid, n, pos = h[pick].view(np.int64), s.sid[doc[pick]], n[pick], pos[pick]
                size = np.zeros(len(token), np.int32)
                prev = np.zeros(len(token), np.int64)
                prev[1:] = np.where(sid[1:] == sid[:-1], token[:-1], 0)
                # subsets of small sets
                extra: list[tuple[int, int, int, int]] = []
                for i in np.flatnonzero(use & (s.n <= small)).tolist():
                    k = int(s.n[i])
                    own = mix(s.h[s.at[i] : s.at[i + 1]] ^ _U(0xABCDEF0123))
                    for left_out in range(k - least_overlap(k, percent) + 1):
                        places = np.array(list(combinations(range(k), left_out)), np.int64).reshape(comb(k, left_out), left_out)
                        whole = own.sum(dtype=np.uint64)
                        sums = whole - own[places].sum(axis=1, dtype=np.uint64)
                        extra += [(t, k - left_out, int(s.sid[i]), k) for t in np.unique(mix(sums)).view(np.int64).tolist()]
                if extra:
                    e = np.array(extra, np.int64)
                    token, size = np.concatenate([token, e[:, 0]]), np.concatenate([size, e[:, 1].astype(np.int32)])
                    sid, n, pos = np.concatenate([sid, e[:, 2]]), np.concatenate([n, e[:, 3]]), np.concatenate([pos, np.zeros(len(e), np.int64)])
                    prev = np.concatenate([prev, np.zeros(len(e), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(size), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(prev)],
                    ["token", "size", "sid", "n", "pos", "prev"],
                )

    return docs.select("text").mapInArrow(tidy(work), "token long, size int, sid long, n int, pos int, prev long")


def _stars(entries: DataFrame, percent: int, small: int) -> DataFrame:
    """(a, b, sure): the least set of each list or subset with each other one.

    ``sure`` pairs share a subset that proves the link. The entries of one token come in
    order of size, so one row is kept in mind and nothing is gathered.
    """

    def work(batches):
        last = None
        for batch in batches:
            token, size, sid, n, pos = (np.asarray(c) for c in batch.columns)
            if last is not None:
                token, size, sid, n, pos = (np.concatenate([[x], y]) for x, y in zip(last, (token, size, sid, n, pos), strict=True))
            if not len(token):
                continue
            head = np.ones(len(token), bool)
            head[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(token)), 0))
            last = tuple(x[at[-1]] for x in (token, size, sid, n, pos))
            a, b, na, nb = sid[at], sid, n[at].astype(np.int64), n.astype(np.int64)
            most = np.where(size > 0, size, 1 + np.minimum(na - pos[at], nb - pos) - 1)
            ok = (a != b) & (100 * most >= percent * (na + nb - most)) & ((size > 0) | (nb > small))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(size[ok] > 0)], ["a", "b", "sure"])

    dealt = entries.drop("prev").repartition("token").sortWithinPartitions("token", "size", "n", "sid")
    return dealt.mapInArrow(tidy(work), "a long, b long, sure boolean")


def _sets(docs: DataFrame, width: int, wanted: Bloom) -> DataFrame:
    """(sid, shingles): each wanted set once, its hashes in ascending order."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                s = Sets(data, offsets, width)
                at = np.flatnonzero((s.n > 0) & wanted.has(s.sid))
                if len(seen) > 1 << 20:
                    seen.clear()
                at = at[[x not in seen and not seen.add(x) for x in s.sid[at].tolist()]] if len(at) else at
                chosen = np.zeros(s.rows, bool)
                chosen[at] = True
                ends = np.concatenate([[0], np.cumsum(s.n[at])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.h[chosen[s.doc]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s.sid[at]), shingles], ["sid", "shingles"])

    return docs.select("text").mapInArrow(tidy(work), "sid long, shingles array<long>").dropDuplicates(["sid"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and offsets of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) that link, compared shingle by shingle on whole sets."""
    pairs = checkpoint(pairs)
    wanted = Bloom.build(pairs.select("a").union(pairs.select("b")))
    sets = _sets(docs, width, wanted)
    both = (
        pairs.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b")), "b")
        .join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("of_a")), "a")
        .select("a", "b", "of_a", "of_b")
    )

    def work(batches):
        for batch in batches:
            (x, x_at), (y, y_at) = (_lists(batch.column(i)) for i in (2, 3))
            ok = np.array([_link(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]], percent) for i in range(len(batch))], bool)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return checkpoint(both.mapInArrow(tidy(work), "a long, b long"))


def _groups(batches):
    """Tables of whole groups; the rows of a group (token, lo, hi) follow one another."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not len(table):
            continue
        key = [np.asarray(table.column(i)) for i in range(3)]
        start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))[-1]
        if start:
            yield table.slice(0, start).combine_chunks()
        held = table.slice(start)
    if held is not None and len(held):
        yield held.combine_chunks()


def _partners(table: pa.Table, percent: int, small: int):
    """Yield (x, y): rows of one group that may link by size and position and must still be compared."""
    token, lo, hi, own, n, pos, prev, comp = (np.asarray(table.column(c)) for c in ("token", "lo", "hi", "own", "n", "pos", "prev", "comp"))
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    of = np.cumsum(np.concatenate([[True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    at = np.arange(len(token) - 1)
    for d in count(1):
        at = at[at < len(token) - d]
        # sizes rise within a group: what is too large now stays so
        at = at[(of[at + d] == of[at]) & (percent * n[at + d] <= 100 * n[at])]
        if not len(at):
            return
        # two entries of one block meet where that block meets itself
        ok = (comp[at] != comp[at + d]) & (n[at + d] > small) & ((own[at] != own[at + d]) | (lo[at] == hi[at]))
        # with one entry before this in common they meet there already; at their first shared one they have none
        ok &= (prev[at] != prev[at + d]) | (prev[at] == 0)
        x = at[ok]
        y = x + d
        most = np.minimum(n[x] - pos[x], n[y] - pos[y])
        ok = 100 * most >= percent * (n[x] + n[y] - most)
        if ok.any():
            yield x[ok], y[ok]


class _Joined:
    """What a task has joined already; it may forget, which only lets more pairs out."""

    def __init__(self, bound: int = 1 << 20):
        self.up: dict[int, int] = {}
        self.bound = bound

    def root(self, c: int) -> int:
        up = self.up
        while (above := up.get(c, c)) != c:
            up[c] = c = up.get(above, above)
        return c

    def join(self, one: int, other: int) -> None:
        if len(self.up) > self.bound:
            self.up.clear()
        self.up[one] = other


_PAIRED = ("token", "lo", "hi", "own", "sid", "n", "pos", "prev", "comp")


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """A row for each two blocks (``lo``, ``hi``) of its list in which a row's block ``own`` meets."""
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("own")
    met = rows.select("*", own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})


def _dealt(met: DataFrame, *more: str) -> DataFrame:
    return met.select(*_PAIRED, *more).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "sid")


def _blocks():
    """How many blocks a list has, from its rows."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _candidates(entries: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int, small: int) -> DataFrame:
    """Pairs (a, b) of sets that share an entry and may link by their sketches, of different components.

    Not all pairs, but enough to connect all sets that such pairs connect.
    """
    lists = entries.where("size = 0").join(comp.select(F.col("node").alias("sid"), "comp"), "sid", "left")
    lists = checkpoint(lists.dropDuplicates(["sid", "token"]).select("token", "sid", "n", "pos", "prev", F.coalesce("comp", "sid").alias("comp")))
    several = lists.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), _blocks())
    several = checkpoint(several.where("least < most").select("token", "blocks"))
    met = _in_blocks(lists.join(several, "token").join(sketches.drop("n"), "sid"), F.col("blocks"))

    def work(batches):
        joined = _Joined()
        for table in _groups(batches):
            n, sid, lv = (np.asarray(table.column(c)) for c in ("n", "sid", "lv"))
            sketch, other_level = ([np.asarray(table.column(f"{c}{i}")) for i in range(SKETCH)] for c in "su")
            a, b = [], []
            for x, y in _partners(table, percent, small):
                ok = _near(lv, sketch, other_level, n, x, y, percent)
                for i, j in zip(sid[x[ok]].tolist(), sid[y[ok]].tolist(), strict=True):
                    one, other = joined.root(i), joined.root(j)
                    if one != other:
                        joined.join(one, other)
                        a.append(i)
                        b.append(j)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return checkpoint(_dealt(met, "lv", *_PARITY).mapInArrow(tidy(work), "a long, b long"))


def _bridges(candidates: DataFrame, comp: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between sets of different components that the candidates connect, verified on whole sets."""
    clusters = checkpoint(components(candidates))
    sets = _sets(docs, width, Bloom.build(clusters.select("node")))
    sets = (
        clusters.select(F.col("node").alias("sid"), F.col("comp").alias("token"))
        .join(comp.select(F.col("node").alias("sid"), "comp"), "sid", "left")
        .withColumn("comp", F.coalesce("comp", "sid"))
        .join(sets, "sid")
        .withColumns({"n": F.size("shingles"), "pos": F.lit(0), "prev": F.lit(0).cast("long")})
    )
    sets = checkpoint(sets)
    met = _in_blocks(sets.join(checkpoint(sets.groupBy("token").agg(_blocks())), "token"), F.col("blocks"))

    def work(batches):
        joined = _Joined()
        for table in _groups(batches):
            h, at = _lists(table.column("shingles"))
            n, sid, of = (np.asarray(table.column(c)) for c in ("n", "sid", "comp"))
            lv, *sketches = both_sketches(h, np.repeat(np.arange(len(n)), np.diff(at)), n, percent)
            sketch, other_level = (list(np.ascontiguousarray(k.T)) for k in sketches)
            a, b = [], []
            for x, y in _partners(table, percent, 0):
                ok = _near(lv, sketch, other_level, n, x, y, percent)
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    one, other = joined.root(int(of[i])), joined.root(int(of[j]))
                    if one != other and _link(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]], percent):
                        joined.join(one, other)
                        a.append(int(sid[i]))
                        b.append(int(sid[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return checkpoint(_dealt(met, "shingles").mapInArrow(tidy(work), "a long, b long"))


def ngram_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept``, one row per input row.

    Words are runs outside space and the control characters 9 to 13, A-Z lower-cased. A
    text with fewer than ``width`` words is one shingle; null and empty texts have no
    shingle, link with nothing and are their own component. ``component_id`` is the least
    id reachable by links, itself included; a null id counts as the largest. ``kept``
    marks one row of each component, the one with that least id (one of them if rows
    repeat). ``row`` numbers the input rows of this reading. Other columns are not read;
    an empty table gives an empty result. ``percent`` must be over 50.
    """
    docs = stable(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def facts(batches):
        for batch in batches:
            size = len(batch)
            n, sid, lv = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int32)
            sketch, other = np.zeros((size, SKETCH), np.int64), np.zeros((size, SKETCH), np.int64)
            for first, data, offsets in chunks(batch.column(2)):
                s = Sets(data, offsets, width)
                own = slice(first, first + s.rows)
                n[own], sid[own] = s.n, s.sid
                lv[own], sketch[own], other[own] = both_sketches(s.h, s.doc, s.n, percent)
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(sid), pa.array(lv), *[pa.array(np.ascontiguousarray(k[:, i])) for k in (sketch, other) for i in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "sid", "lv", *_PARITY])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = checkpoint(rows.mapInArrow(tidy(facts), f"row long, doc_id {kind}, n long, sid long, lv int, {', '.join(f'{s} long' for s in _PARITY)}"))
    sketches = known.where("n > 0").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "lv", *_PARITY)])
    known = known.drop("lv", *_PARITY)
    sizes = {r["n"]: r["c"] for r in known.where(F.col("n").between(1, MOST_SMALL)).groupBy("n").agg(F.count_distinct("sid").alias("c")).collect()}
    small = choose_boundary(sizes, percent)
    least_n = least_overlap(small + 1, percent) if small else 1

    frequent = _counts(rows, width, percent, None, 1)
    token, df, low = heavy(frequent)
    others = _counts(rows, width, percent, Order(token, df, low=low, split=int(_SPLIT)), least_n)
    more_token, more_df, high = heavy(others)
    order = Order(np.concatenate([token, more_token]), np.concatenate([df, more_df]), low, high, int(_SPLIT))
    shared = Bloom.build(frequent.select("token").unionByName(others.select("token")))
    entries = checkpoint(_entries(rows, width, percent, order, shared, small, least_n))

    # each set with the one that it most often meets as the least of a list
    stars = checkpoint(_stars(entries, percent, small).groupBy("a", "b").agg(F.count("*").alias("times"), F.max("sure").alias("sure")))
    sure = stars.where("sure").select("a", "b")
    first = (
        stars.where("not sure")
        .join(sketches.alias("x"), F.col("a") == F.col("x.sid"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.sid"))
        .where(_may_link("x", "y", percent))
        .groupBy("b")
        .agg(F.max_by("a", F.struct("times", "a")).alias("a"))
        .select("a", "b")
    )
    edges = checkpoint(sure.unionByName(_verify(first, rows, width, percent)))
    comp = checkpoint(components(edges))

    # lists that still hold several components, compared across them
    candidates = _candidates(entries, comp, sketches, percent, small)
    if not candidates.isEmpty():
        comp = checkpoint(components(edges.unionByName(_bridges(candidates, comp, rows, width, percent))))

    # both inputs of the next two joins are plain, so that adaptive execution can split a large component
    known = checkpoint(known.join(comp.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("class", F.coalesce("comp", "sid")))
    some = known.where("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("least")
    groups = checkpoint(some.groupBy("class").agg(least))
    linked = some.join(groups, "class").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("least.row") == F.col("row")).alias("kept")
    )
    alone = known.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
