"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised (a symbol or digit that can stand for a letter beside another
or a letter, doubled letters) and runs of short pieces between spaces or separators, which
may be one word set apart, are turned into a lattice of what they may stand for.
The best path under a character language model, counted over all documents, is the
restored text: an exact Viterbi search over the last three characters, which also decides
what gaps between pieces go and where words begin. Then the restored
text is scored: each word has a weight by its form and its beginnings, learned from
labelled documents, and a logistic model turns a document's strongest words into a
score in [0, 1].

Scale: the language model is one table of ``LETTERS ** 4`` counts and the weights are one
table of ``BUCKETS`` buckets, whatever the input; both are summed on the executors. The
labelled rows used to fit are at most ``FIT_ROWS`` of each class, chosen by a hash of
the id. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, fit_logistic, tidy

FIT_ROWS = 10_000
BUCKETS = 1 << 20
TOP = 3
_U = np.uint64

# What a disguise may stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
}
SEPARATORS = ".-_*"

#: Characters of the language model: boundary, a-z, any other letter, anything else.
LETTERS = 29
_OTHER_LETTER, _OTHER = 27, 28
_STATES = LETTERS**3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = _OTHER_LETTER
_CLASS_BYTES = _CLASS.tobytes()

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in LEET]] = True
#: For features, words are runs of letters, digits and bytes over 127.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_GAP[128:] = False
#: Never part of a word at its ends.
_AROUND = ".,;:?\"'*#%&-_/\\[]{}<>=~^`)"
#: What pieces are made of; between them, gaps of white space and separators may be a disguise.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, LEET)]] = False
_BETWEEN[128:] = False
_FIRM = np.ones(256, bool)
_FIRM[[0x20, *range(9, 14), *map(ord, SEPARATORS)]] = False
_RUN = re.compile(r"[ \t-\r.\-_*]+|(.)\1*", re.S)
#: The runs with more than one way to read them: gaps, leet characters, repeated ones.
_CHOICE = re.compile(r"[ \t-\r.\-_*]+|([" + re.escape("".join(LEET)) + r"])\1*|(.)\2+", re.S)
#: Characters of a short piece, gaps of a long run, and log weights of a gap that stays and one that goes.
SHORT = 4
LONG_RUN = 24
STAYS, GOES = log(0.95), log(0.05)


def _first_bytes(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all runs of four characters over all documents, as a (29, 29, 29, 29) array."""

    def work(batches):
        total = np.zeros(LETTERS**4, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                first = _first_bytes(data)  # a character of several bytes counts once
                offsets, data = np.concatenate([[0], np.cumsum(first)])[offsets], data[first]
                c = np.zeros(len(data) + 3 * len(offsets), np.int64)
                # three boundaries before each text and after the last one
                c[np.arange(len(data)) + 3 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _CLASS[data]
                if len(c) > 3:
                    total += np.bincount(((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:], minlength=LETTERS**4)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["gram", "n"])

    rows = docs.select(text_col).mapInArrow(tidy(work), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**4, np.int64)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape((LETTERS,) * 4)


@lru_cache(1 << 14)
def _options(run: str) -> list[tuple[str, float, list[int]]]:
    """What a run of equal characters, or a gap, may stand for: text, log weight, classes."""
    c, n = run[0], len(run)
    if c in SEPARATORS or c in " \t\n\v\f\r":
        out = [(run, STAYS), ("", GOES)]
    else:
        out = stands = [(c, log(0.4))] + [(x, log(0.6 / len(LEET[c]))) for x in LEET[c]] if c in LEET else [(c, 0.0)]
        if n == 2:
            out = [(x * 2, w) for x, w in stands] + [(x, w + log(0.05)) for x, w in stands]
        elif n > 2:
            out = [(x, w + log(0.5)) for x, w in stands] + [(x * 2, w + log(0.4)) for x, w in stands] + [(c * n, log(0.1))]
    return [(text, w, [Restorer._class(x) for x in text]) for text, w in out]


class Restorer:
    """Viterbi decoding of a disguised word under the character language model."""

    MEMO_ENTRIES, MEMO_LONGEST = 100_000, 256

    def __init__(self, counts: np.ndarray):
        # each order is smoothed towards the next shorter one
        p = np.full(LETTERS, 1 / LETTERS)
        for order in (1, 2, 3, 4):
            c = counts.sum(axis=tuple(range(4 - order))).astype(float) if order < 4 else counts.astype(float)
            p = (c + 4.0 * p) / (c.sum(axis=-1, keepdims=True) + 4.0)
        self.logp = np.log(p).astype(np.float32)
        self.memo: dict[str, str] = {}
        self._flat: list[float] | None = None

    def __getstate__(self):
        return {"logp": self.logp, "memo": {}, "_flat": None}

    def let_go(self) -> None:
        """Give up what can be made again."""
        self.memo, self._flat = {}, None

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters, and each gap: the strings that it may stand for, with log weights."""
        return [[(text, w) for text, w, _ in _options(run[0])] for run in _RUN.finditer(word.lower())]

    @staticmethod
    def _class(c: str) -> int:
        o = ord(c)
        return int(_CLASS[o]) if o < 128 else _OTHER_LETTER

    def restore(self, word: str) -> str:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.MEMO_ENTRIES:
                self.memo.clear()
            found = self._search(word)
            if found == word:  # most are: kept once
                found = word
            if len(word) <= self.MEMO_LONGEST:
                self.memo[word] = found
        return found

    def _search(self, word: str) -> str:
        if self._flat is None:
            # runs of three that never occur share their values, and so their numbers
            value, at = np.unique(self.logp, return_inverse=True)
            self._flat = value.astype(object)[at.ravel()].tolist()
        logp = self._flat
        word = word.lower()
        kinds = word.encode().translate(_CLASS_BYTES) if word.isascii() else [self._class(c) for c in word]
        # best way to each state (the last three characters, as one number): weight, way back
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        at = 0
        for run in _CHOICE.finditer(word):
            if run.start() > at:
                states = self._say(logp, states, kinds[at : run.start()], word[at : run.start()])
            at = run.end()
            after: dict[int, tuple[float, tuple | None]] = {}
            options = _options(run[0])
            for state, (weight, way) in states.items():
                for text, w, classes in options:
                    s, total = state, weight + w
                    for k in classes:
                        s = s * LETTERS + k
                        total += logp[s]
                        s %= _STATES
                    if s not in after or total > after[s][0]:
                        after[s] = (total, (text, way))
            states = after
        if at < len(word):
            states = self._say(logp, states, kinds[at:], word[at:])
        _, way = max((weight + logp[s * LETTERS], way) for s, (weight, way) in states.items())
        parts = []
        while way is not None:
            parts.append(way[0])
            way = way[1]
        return "".join(reversed(parts))

    @staticmethod
    def _say(logp: list[float], states: dict, kinds, text: str) -> dict:
        """The states after characters that stand for themselves only; three of them leave one state."""
        i = 0
        while len(states) > 1 and i < len(kinds):
            k = kinds[i]
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, way) in states.items():
                s = state * LETTERS + k
                weight += logp[s]
                s %= _STATES
                if s not in after or weight > after[s][0]:
                    after[s] = (weight, way)
            states = after
            i += 1
        if i == len(kinds):
            return {s: (weight, (text, way)) for s, (weight, way) in states.items()}
        ((s, (weight, way)),) = states.items()
        for k in kinds[i:]:
            s = s * LETTERS + k
            weight += logp[s]
            s %= _STATES
        return {s: (weight, (text, way))}

    @staticmethod
    def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes where a character begins that makes its word one to decode, by what comes after it.

        A leet character beside a letter or another one, or a letter twice. Characters are
        code points; those over 127 count as letters.
        """
        at = np.flatnonzero(_first_bytes(data))
        mark = np.zeros(len(data), bool)
        if len(at) < 2:
            return mark
        low = np.zeros(len(data) + 4, np.uint8)
        low[: len(data)] = data
        low[: len(data)][_IS_LETTER[data]] |= 0x20
        size = np.diff(np.append(at, len(data)))
        code = np.ndarray((len(data) + 1,), "<u4", low, 0, (1,))[at] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size]
        letter, leet = _IS_LETTER[data[at]] | (data[at] >= 128), _IS_LEET[data[at]]
        x, y = slice(None, -1), slice(1, None)
        two = (leet[x] & (letter | leet)[y]) | (letter[x] & leet[y]) | (letter[x] & (code[x] == code[y]))
        # not from one row into the next
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        two[np.searchsorted(at, inner) - 1] = False
        mark[at[x][two]] = True
        return mark

    def undisguise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """The chunk with disguised words blanked, and (row, restored text) for each of them."""
        spans, marks, whole = [], self._marks(data, offsets), data.tobytes()
        for row, s, e in zip(*self._spans(data, offsets, marks), strict=True):
            raw = whole[s:e].decode("utf-8", "replace").lower()
            if (new := self.restore(raw)) != raw:
                spans.append((row, s, e, new))
        restored = [(row, new) for row, _, _, new in spans]
        if spans:
            data = self._blanked(data, np.array([s for _, s, _, _ in spans]), np.array([e for _, _, e, _ in spans]))
            whole = data.tobytes()
        words = Words(data, offsets)
        if not len(words.start):
            return data, restored
        # each distinct word of the chunk is decoded once
        marks = np.concatenate([[0], np.cumsum(marks & (data != 0x20))])  # none of what is blank now
        alone = np.flatnonzero(marks[words.end] > marks[words.start])
        _, once, of = np.unique(words.hash[alone], return_index=True, return_inverse=True)
        found = []
        first = alone[once]
        for s, e in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True):
            raw = whole[s:e].decode("utf-8", "replace").lower().strip(_AROUND)
            new = self.restore(raw)
            found.append(new if new != raw else None)
        changed = np.array([w is not None for w in found], bool)[of] if found else np.zeros(0, bool)
        at = alone[changed]
        restored += zip(words.doc[at].tolist(), (found[i] for i in of[changed].tolist()), strict=True)
        return self._blanked(data, words.start[at], words.end[at]) if len(at) else data, restored

    @staticmethod
    def _blanked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        return np.where(np.cumsum(inside)[:-1] > 0, np.uint8(0x20), data)

    def _spans(self, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Rows, starts and ends of the runs of short pieces that the search may change.

        Where a run has nothing but gaps to decide, the search is done here for all runs at
        once, and those whose gaps all stay are left out. The few very long runs are left to
        the search itself, which decides the same.
        """
        pieces = Words(data, offsets, _BETWEEN)
        if len(pieces.start) < 2:
            return [], [], []
        firm = np.concatenate([[0], np.cumsum(_FIRM[data])])
        at = np.flatnonzero(_first_bytes(data))
        begin, over = np.searchsorted(at, pieces.start), np.searchsorted(at, pieces.end)
        short = over - begin <= SHORT
        joined = short[1:] & short[:-1] & (pieces.doc[1:] == pieces.doc[:-1]) & (firm[pieces.start[1:]] == firm[pieces.end[:-1]])
        turn = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
        first, last = turn[::2], turn[1::2]  # pieces
        start, end = pieces.start[first], pieces.end[last]
        other = np.concatenate([[0], np.cumsum(marks | _IS_LEET[data])])
        take = (other[end] > other[start]) | (last - first >= LONG_RUN)
        plain = np.flatnonzero(~take)
        if len(plain):
            take[plain] = self._some_gap_goes(_CLASS[data[at]].astype(np.int64), begin, over, first[plain], last[plain])
        return pieces.doc[first[take]].tolist(), start[take].tolist(), end[take].tolist()

    def _some_gap_goes(self, kind: np.ndarray, begin: np.ndarray, over: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For runs of pieces first to last: whether the best path leaves a gap out.

        The last three characters follow from what became of the last two gaps, so four
        states are enough; a fifth column is the path on which all gaps stay.
        """
        logp = self.logp.ravel()

        def say(state, weight, a, b):
            for k in range(int((b - a).max(initial=0))):
                go = np.flatnonzero(b - a > k)
                s = state[go] * LETTERS + kind[a[go] + k][:, None]
                weight[go] += logp[s]
                state[go] = s % LETTERS**3

        by = np.argsort(first - last, kind="stable")  # most pieces first
        first, last = first[by], last[by]
        state, weight = np.zeros((len(by), 5), np.int64), np.zeros((len(by), 5))
        weight[:, 1:4] = -np.inf
        say(state, weight, begin[first], over[first])
        steps = last - first
        for j in range(1, int(steps.max()) + 1):
            m = int(np.searchsorted(-steps, -j, "right"))
            piece = first[:m] + j
            stay, w_stay = state[:m].copy(), weight[:m] + STAYS
            say(stay, w_stay, over[piece - 1], begin[piece])
            # columns: this gap, the one before, the one before that; all stay
            both = np.concatenate([stay[:, :4], state[:m, :4], stay[:, 4:]], axis=1)
            w_both = np.concatenate([w_stay[:, :4], weight[:m, :4] + GOES, w_stay[:, 4:]], axis=1)
            say(both, w_both, begin[piece], over[piece])
            two = w_both[:, :8].reshape(m, 4, 2)
            best = two.argmax(axis=2)[:, :, None]
            weight[:m, :4] = np.take_along_axis(two, best, 2)[:, :, 0]
            state[:m, :4] = np.take_along_axis(both[:, :8].reshape(m, 4, 2), best, 2)[:, :, 0]
            weight[:m, 4], state[:m, 4] = w_both[:, 8], both[:, 8]
        weight += logp[state * LETTERS]
        out = np.zeros(len(by), bool)
        out[by] = weight[:, :4].max(axis=1) > weight[:, 4] + 1e-9
        return out


#: A word's features: its form and its first bytes, so many of them.
_BEGINNINGS = (4, 5, 6, 7)


def word_features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer):
    """(row, form, buckets): for each word of the restored chunk its row, its hash and one bucket per feature."""
    data, restored = restorer.undisguise(data, offsets)
    rows, forms, buckets = [], [], []

    def add(words: Words, rows_of: np.ndarray):
        size = words.end - words.start
        own = [words.hash] + [np.where(size > k, words.beginning(k), words.hash) for k in _BEGINNINGS]
        rows.append(rows_of)
        forms.append(words.hash)
        buckets.append(np.stack([(h >> _U(17)).astype(np.int64) & (BUCKETS - 1) for h in own]) if len(words.hash) else np.zeros((len(own), 0), np.int64))

    words = Words(data, offsets, _GAP)
    add(words, words.doc)
    if restored:
        more = pa.array([w.encode() for _, w in restored], pa.large_binary())
        text, ends = np.frombuffer(b"".join(more.to_pylist()), np.uint8), np.concatenate([[0], np.cumsum([len(w.encode()) for _, w in restored])])
        extra = Words(text, ends, _GAP)
        add(extra, np.array([r for r, _ in restored], np.int64)[extra.doc])
    return np.concatenate(rows), np.concatenate(forms), np.concatenate(buckets, axis=1)


class Model:
    """Bucket weights and the logistic model over a document's strongest words."""

    def __init__(self, restorer: Restorer, weights: np.ndarray):
        self.restorer, self.weights = restorer, weights.astype(np.float32)
        self.mean, self.scale, self.coef = np.zeros(TOP + 3), np.ones(TOP + 3), np.zeros(TOP + 4)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per row: the TOP highest word weights, log count of strong words, their share, log words."""
        out = np.zeros((len(column), TOP + 3))
        for first, data, offsets in chunks(column):
            rows = len(offsets) - 1
            doc, form, buckets = word_features(data, offsets, self.restorer)
            if not len(doc):
                continue
            score = self.weights[buckets].max(axis=0)
            by = np.lexsort((form, -score, doc))
            doc, form, score = doc[by], form[by], score[by]
            words = np.bincount(doc, minlength=rows)
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (form[1:] != form[:-1])
            doc, score = doc[fresh], score[fresh]
            place = np.arange(len(doc)) - np.searchsorted(doc, doc)
            for k in range(TOP):
                at = place == k
                out[first + doc[at], k] = np.maximum(score[at], 0)
            strong = np.bincount(doc, weights=score > 2.0, minlength=rows)
            own = slice(first, first + rows)
            out[own, TOP] = np.log1p(strong)
            out[own, TOP + 1] = np.sqrt(strong / np.maximum(words, 1))
            out[own, TOP + 2] = np.log1p(words)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        z = (self.features(column) - self.mean) / self.scale
        total = np.full(len(z), self.coef[-1])
        for k in range(z.shape[1]):  # term by term, so a row's score doesn't depend on its batch
            total += z[:, k] * self.coef[k]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _ending(work, restorer: Restorer):
    """``tidy(work)``, at whose end the restorer lets go first.

    A worker frees what its task held after the task only, too late to be given back: idle
    workers would hold on to it.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            restorer.let_go()

    return tidy(run)


def fold(id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents outside fold 0: word weights on folds 1 to 3, the logistic model on fold 4.

    At most ``fit_rows`` of each class and part, chosen by a hash of the id, weighted back
    to the classes' true counts. Null labels and ids are left out; of several labels of
    an id the highest counts. Of repeated ids the least text is fitted, once; null and empty
    texts are texts without words. Where a part lacks a class, both parts are used for both;
    where a class has no row at all, every score is the share of the other.
    """
    restorer = Restorer(letter_counts(docs, text_col))
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id is not null and y is not null")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .withColumn("fold", fold(F.col("id")))
        .where("fold != 0")
        .withColumn("part", (F.col("fold") == 4).cast("int"))
    )
    true = {(r["y"], r["part"]): r["n"] for r in known.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        for part in (0, 1):
            some = known.where((F.col("y") == y) & (F.col("part") == part)).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
            chosen = some if chosen is None else chosen.unionByName(some)
    # bounded by 4 * fit_rows rows of an id and two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen.select("id", "y", "part")), "id")
    rows = rows.groupBy("id", "y", "part").agg(F.min("text").alias("text"))  # one row of an id, whatever its repeats
    empty = [k for k in ((0, 0), (0, 1), (1, 0), (1, 1)) if not true.get(k)]
    model = Model(restorer, np.zeros(BUCKETS))
    share = sum(true.get((1, p), 0) for p in (0, 1)) / max(1, sum(true.values()))
    if not sum(true.get((0, p), 0) for p in (0, 1)) or not sum(true.get((1, p), 0) for p in (0, 1)):
        model.coef[-1] = 30.0 if share > 0.5 else -30.0
        return model
    weigh = rows if empty else rows.where("part = 0")

    def count(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        docs_of = np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            for first, data, offsets in chunks(batch.column("text")):
                doc, _, buckets = word_features(data, offsets, restorer)
                pairs = np.unique((doc[None, :] * BUCKETS + buckets).ravel())
                own, bucket = y[first + pairs // BUCKETS], pairs % BUCKETS
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[own == c], minlength=BUCKETS)
                docs_of += np.bincount(y[first : first + len(offsets) - 1], minlength=2)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(docs_of[:1]), pa.array(docs_of[1:])], ["bucket", "clean", "toxic"])
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0][part]), pa.array(seen[1][part])], ["bucket", "clean", "toxic"])

    got = weigh.mapInArrow(_ending(count, restorer), "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, clean, toxic = (got.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    all_clean, all_toxic = max(1, clean[bucket == -1].sum()), max(1, toxic[bucket == -1].sum())
    at = bucket >= 0
    # log ratio of smoothed shares, each class brought to the same number of documents
    n = max(all_clean, all_toxic)
    model.weights[bucket[at]] = np.log((toxic[at] * (n / all_toxic) + 2.0 * n / all_toxic) / (clean[at] * (n / all_clean) + 2.0 * n / all_toxic))

    def describe(batches):
        for batch in batches:
            x = model.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "y", "part", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = (rows if empty else rows.where("part = 1")).mapInArrow(_ending(describe, restorer), f"id {kind}, y int, part int, x array<double>").toPandas().sort_values("id")
    if got["y"].nunique() < 2:  # labelled rows without their documents
        model.coef[-1] = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    y, x = got["y"].to_numpy(), np.stack(got["x"].to_numpy())
    have = got.groupby(["y", "part"]).size()
    weight = np.array([true[k] / have[k] for k in zip(got["y"], got["part"], strict=True)])
    model.mean, model.scale, model.coef = fit_logistic(x, y.astype(float), weight)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", reject: float | None = None) -> DataFrame:
    """The input rows and ``score`` (0 to 1); with ``reject``, without the rows of that score or more.

    Equal texts have equal scores; null counts as empty, and empty texts have the score of
    a text without words. Nothing but the text counts. A column that is named ``score``
    already is replaced. Nothing is shuffled.
    """
    docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            s = model.score(batch.column(at))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])
            yield out if reject is None else out.filter(pa.array(s < reject))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_ending(work, model.restorer), f"{fields}, score double")
