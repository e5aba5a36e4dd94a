"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words. Words are ordered by rarity over the lines of
all documents; each line enters the lists of its first ``n - ceil(t * n) + 1`` words, so
two lines of Jaccard likeness t or more meet in a list. Frequent words would make long
lists: they count by twos. Two such lines share two words of a prefix one longer, so a
line enters a list for each two frequent words of that prefix, and the lists of single
words are those of rare ones. Length, position and a parity
sketch of the words (bins that differ hold words of one line only) bound the overlap of
a pair; what passes is verified word by word. Of two lines that match, the later goes.

Equal lines are one class from the start, and classes are what is joined; those of so few
words that only equal lines are alike enter no list. Lists of at most ``SHORT_LIST``
entries are compared pair by pair in one place, unless too many pairs pass. In the others,
a class needs one earlier match only: first each is tried against the earliest one that
it meets most often, then those that still stand are joined with all earlier ones of
their lists. So a list of n like lines costs n pairs, and no match is lost.

Scale: list entries are shuffled once, packed by ranges of tokens, and never stored; texts
are shuffled only for the documents that lose a line. Lines and words go by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Words, checkpoint, chunks, distinct_sets, free_names, mix, segment_sum, stable, tidy, with_filter
from .rarity import PACKED, Order, Tally, counted, heavy, packed

PERCENT = 80
LEAST_WORDS = 1
#: A word in more lines than this is frequent.
FREQUENT = 4096
#: Entries of a list that is compared pair by pair in one place, and pairs for each of them
#: that may pass there; a list with more of either goes the way of long ones.
SHORT_LIST, MOST_PAIRS = 512, 8
#: Entries that a task holds before it hands them out, and those of a bucket on average.
HELD, BUCKET = 1 << 19, 1 << 16
_ENTRY = np.dtype([("token", "<i8"), ("sid", "<i8"), ("b1", "<i8"), ("b2", "<i8"), ("n", "<i4"), ("pos", "<i4")])
#: What is shuffled of lines of fewer than 256 words.
_NARROW = np.dtype([*_ENTRY.descr[:4], ("n", "u1"), ("pos", "u1")])
_U = np.uint64


class Lines:
    """Word sets of the lines of a chunk; ``row`` of the chunk and ``line`` within it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begins = np.zeros(len(data) + 1, bool)
        begins[1:] = data == 10
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        self.row = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(self.row, self.row)
        self.line = np.arange(len(starts)) - first
        words = Words(data, np.concatenate([starts, [len(data)]]).astype(np.int64))
        self.h, self.at, self.owner = distinct_sets(words.doc, words.hash, len(starts))
        self.n = np.diff(self.at)
        self.sid = mix(segment_sum(mix(self.h ^ _U(0x11AE5)), self.at) + self.n.astype(np.uint64)).view(np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bins of each line's words: whether a bin holds an odd number of them."""
        rows = len(self.n)
        odd = np.bincount(self.owner * 128 + (self.h >> _U(57)).astype(np.int64), minlength=rows * 128) & 1
        both = np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view(np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _fresh(lines: Lines, least: int, seen: set[int], bound: int = 1 << 20) -> np.ndarray:
    """Lines long enough to count whose set this task has not had before."""
    if len(seen) > bound:
        seen.clear()
    keep = np.zeros(len(lines.n), bool)
    at = np.flatnonzero(lines.n >= least)
    own = dict(zip(reversed(lines.sid[at].tolist()), reversed(at.tolist()), strict=True))  # the first line of each set
    fresh = [sid for sid in own if sid not in seen]
    keep[[own[sid] for sid in fresh]] = True
    seen.update(fresh)
    return keep


def _read(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """One reading of all lines: (row, doc_id, line, sid) of those with ``least`` words or more, and packed tallies of the words of those that can be like others."""
    kind = rows.schema["doc_id"].dataType
    none = {"row": pa.int64(), "line": pa.int32(), "sid": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
    joined = max(least, _least_joined(percent))

    def work(batches):
        seen: set[int] = set()
        tally = Tally()
        id_type = None

        def tallies(parts):
            for t in parts:
                n = len(t)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, none["row"]), pa.nulls(n, id_type), pa.nulls(n, none["line"]), pa.nulls(n, none["sid"]), *t.columns], columns)

        columns = ["row", "doc_id", "line", "sid", "bucket", "blob"]
        for batch in batches:
            id_type = batch.column(1).type
            for first, data, offsets in chunks(batch.column(2)):
                lines = Lines(data, offsets)
                at = np.flatnonzero(lines.n >= least)
                where = pa.array(lines.row[at] + first)
                own = [batch.column(0).take(where), batch.column(1).take(where), pa.array(lines.line[at].astype(np.int32)), pa.array(lines.sid[at])]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(at), none["bucket"]), pa.nulls(len(at), none["blob"])], columns)
                yield from tallies(tally.add(lines.h[_fresh(lines, joined, seen)[lines.owner]]))
        yield from tallies(tally.flush())

    return checkpoint(rows.mapInArrow(tidy(work), f"row long, doc_id {kind.simpleString()}, line int, sid long, {PACKED}"))


def _as(kind: np.dtype, records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), kind)
    for name in kind.names:
        out[name] = records[name]
    return out


def _entries(rows: DataFrame, least: int, percent: int, order: Order, shared: Bloom, buckets: int) -> DataFrame:
    """Packed list entries (token, sid, b1, b2, n, pos) of every distinct line, of bucket b under 2b (narrow) or 2b + 1.

    ``pos``: no word before this place of the order is shared, but for the first of two.
    """
    frequent_from = order.over(FREQUENT)

    def work(batches):
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            records = np.concatenate(held)
            bucket = (((records["token"].view(np.uint64) >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)
            wide = records["n"] > 0xFF
            for kind, own in ((_NARROW, ~wide), (_ENTRY, wide)):
                if own.any():
                    yield from packed(_as(kind, records[own]), 2 * bucket[own] + (kind is _ENTRY))

        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                lines = Lines(data, offsets)
                chosen = _fresh(lines, least, seen)[lines.owner]
                h, owner = lines.h[chosen], lines.owner[chosen]
                by, place = order.sorted(h, owner)
                h, place = h[by], place[by]
                n = lines.n[owner]
                pos = np.arange(len(h)) - np.searchsorted(owner, np.arange(len(lines.n)))[owner]
                common = -(-n * percent // 100)
                frequent = (place >= frequent_from) & (common > 1)
                alone = (pos < n - common + 1) & ~frequent
                alone[alone] = shared.has(h[alone])
                token, who, where = [h[alone]], [owner[alone]], [pos[alone]]
                # twos of frequent words, the words themselves being the last of a prefix
                at = np.flatnonzero(frequent & (pos < n - common + 2))
                d = 1
                while True:
                    two = np.flatnonzero(owner[at[d:]] == owner[at[:-d]]) if d < len(at) else at[:0]
                    if not len(two):
                        break
                    x, y = at[two], at[two + d]
                    token.append(mix(h[x] * _U(0x9FB21C651E98DF25) + h[y]))
                    who.append(owner[x])
                    where.append(pos[y] - 1)
                    d += 1
                who = np.concatenate(who)
                records = np.empty(len(who), _ENTRY)
                records["token"], records["pos"] = np.concatenate(token).view(np.int64), np.concatenate(where)
                b1, b2 = lines.sketches()
                for name, values in (("sid", lines.sid), ("b1", b1), ("b2", b2), ("n", lines.n)):
                    records[name] = values[who]
                held.append(records)
                size += len(records)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return rows.select("text").mapInArrow(tidy(work), PACKED)


def _word_sets(rows: DataFrame, least: int, wanted: Bloom) -> DataFrame:
    """(sid, words): the word hashes of each wanted line, once."""

    def work(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                lines = Lines(data, offsets)
                at = np.flatnonzero((lines.n >= least) & wanted.has(lines.sid))
                _, once = np.unique(lines.sid[at], return_index=True)
                at = np.sort(at[once])
                chosen = np.zeros(len(lines.n), bool)
                chosen[at] = True
                ends = np.concatenate([[0], np.cumsum(lines.n[at])]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines.h[chosen[lines.owner]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(lines.sid[at]), words], ["sid", "words"])

    return rows.select("text").mapInArrow(tidy(work), "sid long, words array<long>").dropDuplicates(["sid"])


def _may_match(x: str, y: str, percent: int):
    """Length, position and sketch bounds of an overlap that gives the likeness asked for."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    differ = F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))
    # words in one line only are (n + m) - 2 * overlap at most
    return (100 * most >= percent * (n + m - most)) & (100 * (n + m - differ) >= percent * (n + m + differ))


def _unpacked(batch: pa.RecordBatch):
    for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield bucket >> 1, _as(_ENTRY, np.frombuffer(blob.as_buffer(), _ENTRY if bucket & 1 else _NARROW))


def _meet(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists that may match, and the entries of long lists.

    Rows (token, sid, n, pos, b1, b2, other): ``other`` is the second class of a pair, which
    has ``sid`` only beside it, and null in an entry of a long list. A task holds one bucket of lists, without those that
    have turned out to be long; of each other list at most ``SHORT_LIST`` entries.
    """
    columns = ["token", "sid", "n", "pos", "b1", "b2"]

    def rows(own: np.ndarray, other: np.ndarray | None = None):
        if other is not None:
            arrays = [pa.array(np.ascontiguousarray(own[c])) if c == "sid" else pa.nulls(len(own), pa.from_numpy_dtype(_ENTRY[c])) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(other)], [*columns, "other"])
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(own[c])) for c in columns), pa.nulls(len(own), pa.int64())], [*columns, "other"])

    def pairs(c: np.ndarray):
        """Pairs of short lists, given by token and size; entries of those with too many."""
        token, sid, b1, b2 = (np.ascontiguousarray(c[k]) for k in ("token", "sid", "b1", "b2"))
        n, pos = (c[k].astype(np.int64) for k in ("n", "pos"))
        of = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        size = np.bincount(of)
        passed = np.zeros(len(size), np.int64)
        out = []
        at = np.arange(len(token) - 1)
        for d in range(1, SHORT_LIST):
            at = at[at < len(token) - d]
            # sizes rise along a list: what is too long now stays so
            at = at[(token[at + d] == token[at]) & (percent * n[at + d] <= 100 * n[at]) & (passed[of[at]] <= MOST_PAIRS * size[of[at]])]
            if not len(at):
                break
            x, y = at, at + d
            total, most = n[x] + n[y], np.minimum(n[x] - pos[x], n[y] - pos[y])
            ok = (100 * most >= percent * (total - most)) & (sid[x] != sid[y])  # a class can come from several tasks
            x, y, total = x[ok], y[ok], total[ok]
            differ = sum(np.bitwise_count((b[x] ^ b[y]).view(np.uint64)).astype(np.int64) for b in (b1, b2))
            ok = 100 * (total - differ) >= percent * (total + differ)
            if ok.any():
                out.append((x[ok], y[ok]))
                passed += np.bincount(of[x[ok]], minlength=len(size))
        crowded = (passed > MOST_PAIRS * size)[of]
        if crowded.any():
            yield rows(c[crowded])
        if out:
            x, y = (np.concatenate(v) for v in zip(*out, strict=True))
            fine = ~crowded[x]
            if fine.any():
                yield rows(c[x[fine]], sid[y[fine]])

    def work(batches):
        held, size, limit, now = [], 0, 8 * BUCKET, None
        long: set[int] = set()

        def lists(over: bool):
            """Short lists become pairs once a bucket is ``over``, long ones go on at once."""
            nonlocal held, size
            every = np.concatenate(held)
            every = every[_by_token_and_size(every)]
            token = np.ascontiguousarray(every["token"])
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(head, len(token)))
            is_long = count > SHORT_LIST
            if long:
                is_long |= np.isin(token[head], np.fromiter(long, np.int64, len(long)))
            long.update(token[head[is_long]].tolist())
            of = np.repeat(is_long, count)
            if of.any():
                yield rows(every[of])
            if over:
                short = ~of & np.repeat(count > 1, count)
                if short.any():
                    yield from pairs(every[short])
                held, size = [], 0
                long.clear()
            else:
                held = [every[~of]]
                size = len(held[0])

        for batch in batches:
            for bucket, records in _unpacked(batch):
                if size and bucket != now:
                    yield from lists(True)
                    limit = 8 * BUCKET
                elif size > limit:
                    yield from lists(False)
                    limit = max(limit, 2 * size)
                now = bucket
                held.append(records)
                size += len(records)
        if size:
            yield from lists(True)

    dealt = entries.repartition(F.shiftright("bucket", 1)).sortWithinPartitions("bucket")
    return checkpoint(dealt.mapInArrow(tidy(work), "token long, sid long, n int, pos int, b1 long, b2 long, other long"))


def _by_token_and_size(c: np.ndarray) -> np.ndarray:
    token, n = np.ascontiguousarray(c["token"]), c["n"].astype(np.int64)
    key = (token & ~np.int64(0xFFFF)) | np.minimum(n, 0xFFFF)
    by = np.argsort(key)
    near = key[by] >> 16
    own = token[by]
    if n.max(initial=0) > 0xFFFF or ((near[1:] == near[:-1]) & (own[1:] != own[:-1])).any():
        return np.lexsort((n, token))
    return by


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of the pairs whose word sets are alike."""
    common = F.size(F.array_intersect("words_a", "words_b"))
    both = pairs.join(sets.select(F.col("sid").alias("b"), F.col("words").alias("words_b")), "b").join(sets.select(F.col("sid").alias("a"), F.col("words").alias("words_a")), "a")
    return checkpoint(both.where(100 * common >= percent * (F.size("words_a") + F.size("words_b") - common)).select("a", "b"))


def _least_joined(percent: int) -> int:
    """Sets of fewer words are like equal ones only: one word more or less is too much."""
    return -(-percent // max(1, 100 - percent))


def _found(rows: DataFrame, tallies: DataFrame, least: int, percent: int) -> DataFrame:
    counts = counted(tallies)
    token, df, classes = heavy(counts)
    words = counts.agg(F.sum("df")).first()[0] or 0
    buckets = min(max(words * (100 - percent) // 100 // BUCKET, 16), 1 << 20)
    shared = Bloom.build(counts.select("token"))
    return _meet(_entries(rows, least, percent, Order(token, df, high=classes), shared, buckets), percent)


def repeated_lines(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, line) of all lines to remove; ``rows`` has ``row`` (unique, the same at each reading), ``doc_id``, ``text``."""
    read = _read(rows, least_words, percent)
    facts = read.where("row is not null").select("row", "doc_id", "line", "sid")
    joined = max(least_words, _least_joined(percent))
    found = _found(rows, read.where("bucket is not null").select("bucket", "blob"), joined, percent)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    classes = checkpoint(facts.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("lines")))

    # pairs of short lists, and the first lines of all classes that are compared
    short = found.where("other is not null").select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))
    short = checkpoint(short.distinct())
    lists = checkpoint(found.where("other is null").drop("other").distinct())
    compared = lists.select("sid").union(short.select("a")).union(short.select("b")).distinct()
    firsts = checkpoint(classes.select("sid", "first").join(compared, "sid", "left_semi"))
    # long lists: each class with the earliest one that it meets most often
    lists = checkpoint(lists.join(firsts, "sid"))
    earliest = checkpoint(lists.groupBy("token").agg(F.min(F.struct("first", "sid", "n", "pos", "b1", "b2")).alias("x")))  # one row for each list; plain, so that a long list can be split
    stars = checkpoint(
        lists.alias("y")
        .join(earliest.select("token", "x.*").alias("x"), "token")
        .where((F.col("x.sid") != F.col("y.sid")) & _may_match("x", "y", percent))
        .groupBy(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        .count()
        .groupBy("b")
        .agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        .select("a", "b")
    )
    # short lists: all pairs; of two that match, the later one goes
    pairs = checkpoint(short.unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    # one reading of the texts gives the words of all lines that may be compared
    wanted = Bloom.build(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(lists.select("sid")))
    sets = checkpoint(_word_sets(rows, joined, wanted))
    near = _alike(pairs, sets, percent)
    first_a, first_b = (firsts.select(F.col("sid").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    gone = checkpoint(near.join(first_a, "a").join(first_b, "b").select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("sid")).distinct())

    # what still stands in a long list, with all earlier ones of the list
    if not lists.isEmpty():
        standing = lists.join(gone, "sid", "left_anti")
        rest = (
            lists.alias("x")
            .join(standing.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.first") < F.col("y.first")) & _may_match("x", "y", percent))
            .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
            .distinct()
            .join(stars, ["a", "b"], "left_anti")
        )
        gone = gone.unionByName(_alike(rest, sets, percent).select(F.col("b").alias("sid"))).distinct()
    # one row for each class that loses a line, so adaptive execution can split the lines of a frequent one
    twice = classes.where("lines > 1").select("sid", "first")
    losing = checkpoint(twice.join(gone.withColumn("gone", F.lit(True)), "sid", "full"))
    return facts.join(losing, "sid").where(F.col("gone").isNotNull() | (F.col("first.row") != F.col("row")) | (F.col("first.line") != F.col("line"))).select("row", "line")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The input rows with ``text_col`` rid of repeated lines, plus ``n_lines`` and ``n_removed``.

    Lines end at a line feed. Words are runs outside space and the control characters 9
    to 13, A-Z lower-cased. A line goes when an earlier line, by (``id_col``, row, line),
    null ids last, has a Jaccard likeness of ``percent`` or more, whether that one stays
    or not. Lines without a word, or of fewer than ``least_words`` distinct words, always
    stay. Null and empty
    texts stay as they are and have 0 lines; a document may be left with an empty text;
    repeated rows lose all such lines but the first. ``percent`` must be over 50. Other
    columns are carried along, but for ones named like the two new ones, which these
    replace. An empty table gives an empty result.
    """
    number, lines_col, losing = free_names(docs, "row", "lines", "losing")
    docs = stable(docs.drop("n_lines", "n_removed"))
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    rows = numbered.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    removed = checkpoint(repeated_lines(rows, percent, least_words).groupBy(F.col("row").alias(number)).agg(F.collect_set("line").alias(lines_col)))

    @F.arrow_udf("string")
    def cut(text: pa.Array, lines: pa.Array) -> pa.Array:
        return _without(text, lines)

    text = F.col(text_col)
    size = F.octet_length(text)
    counts = {
        "n_lines": F.when(F.coalesce(size, F.lit(0)) == 0, 0).otherwise(size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.size(lines_col), F.lit(0)).cast("long"),
    }

    def out(kept) -> list:
        return [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns] + [e.alias(c) for c, e in counts.items()]

    # only documents that may lose a line are shuffled; a task's numbers and lines are small beside its texts
    asked = with_filter(numbered, removed.select(number), number, losing)
    changed = asked.where(losing).join(removed.hint("shuffle_hash"), number, "left").select(*out(cut(text, F.col(lines_col))))
    same = asked.where(~F.col(losing)).withColumn(lines_col, F.lit(None).cast("array<int>")).select(*out(text))
    return changed.unionByName(same)


def _without(text: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without their lines of the numbers given; null lists take nothing away."""
    rows, numbers = pc.list_parent_indices(lines).to_numpy(), pc.list_flatten(lines).to_numpy()
    if text.null_count:
        there = text.is_valid().to_numpy(zero_copy_only=False)[rows]
        rows, numbers = rows[there], numbers[there]
    out, sizes = [], []
    for begin, data, offsets in chunks(text):
        n = len(offsets) - 1
        # each row with a line feed of its own at its end, so that each line has one
        data = np.insert(data, offsets[1:], np.uint8(10))
        ends = np.flatnonzero(data == 10) + 1
        first = np.searchsorted(ends, offsets + np.arange(n + 1), "right")
        own = slice(*np.searchsorted(rows, [begin, begin + n]))
        stays = np.ones(len(ends), bool)
        stays[first[rows[own] - begin] + numbers[own]] = False
        size = np.diff(ends, prepend=0)
        keep = np.repeat(stays, size)
        # a line goes with the line feed after it, and the last one that stays loses its own
        left = np.flatnonzero(stays)
        row = np.searchsorted(first, left, "right") - 1
        keep[ends[left[np.append(row[1:] != row[:-1], True)[: len(left)]]] - 1] = False
        total = np.concatenate([[0], np.cumsum(np.where(stays, size, 0))])[first]
        out.append(data[keep])
        sizes.append(np.maximum(np.diff(total) - 1, 0))
    whole = np.concatenate(out) if out else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0]
    texts = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.array(at, np.int64)), pa.py_buffer(whole))
    return texts.cast(pa.string()) if text.null_count == 0 else pa.array([t if v.is_valid else None for t, v in zip(texts.to_pylist(), text, strict=True)], pa.string())
