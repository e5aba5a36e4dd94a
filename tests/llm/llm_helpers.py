"""Plain Python versions of what the operators share."""

from __future__ import annotations

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles_of(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def documents(spark, texts, **columns):
    """A documents table of (doc_id, text) pairs or texts; other columns get plain values."""
    rows = []
    for i, t in enumerate(texts):
        d, t = t if isinstance(t, tuple) else (i, t)
        rows.append((d, t, "en", f"s{i % 3}", len(t or "")))
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with columns named like those that operators make or keep inside."""
    from pyspark.sql import functions as F

    for c in ("row", "n", "sid", "size", "copies", "taken", "band", "slot", "token", "kept", "name", "level", "key", "h", "score", "n_lines", "evidence", "host", "path", "comp", "class", "id", "range", "guest", "__row", "__lines", "__copy", "__text", "__losing", "__words", "n_removed", "offset"):
        df = df.withColumn(c, F.lit("clash"))
    return df


#: Awkward rows: nulls, empty and blank texts, a very long one, ties, repeats, negative ids.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one two three four five six seven eight"),
    (6, "one two three four five six seven eight"),
    (7, "é ü 日本語 🎉 ñandú á"),
    (8, "word " * 30_000),
    (8, "word " * 30_000),
    (-9, "x\x00y\x01 z"),
    (None, "null id"),
    (None, "null id"),
]
