"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Targets fill up like water: each source gets its weight's share of all words, no source
more than ``max_repeat`` times its own size, the excess going to the others by weight.
With sources sorted by (cap / weight) the capped ones are a prefix, so one running sum
over the sources' totals finds the level; nothing is iterated.

Within a source every document expects ``target / size`` copies. The documents are laid
out by size, their expected copies summed along that order, one random offset added, drawn
for each source from a digest of its name and the seed, and each crossed integer emits a
copy. So every document expects the same over the seeds, and as documents of like size are
neighbours, the words taken differ from the target by no more than the longest document.

Scale: the order within a source is (size class, slot by id digest, size, id, text digest),
with more slots the more rows there are, so a source that holds a third of all rows is
spread over many groups of bounded size; the groups' counts are summed on a table of one
row for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Slots of each size class: as many at least, and one for so many rows of the table.
LEAST_SLOTS, ROWS_A_SLOT = 64, 1 << 18
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text column; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) with one row per source -> (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn. Sources of size 0 get
    target 0. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("size") * F.lit(float(max_repeat)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("size").over(every).cast("double"))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("before_w", F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("before_w")))
        .withColumn("open", F.col("ratio") >= F.col("level"))
    )
    # the first source that its cap does not hold back sets the level for itself and all after it
    level = F.min_by("level", F.when(F.col("open"), F.struct("ratio", F.col("source").isNull(), "source"))).over(every)
    return t.select("source", F.col("size").alias("source_size"), F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _fraction(value, seed: int):
    """A number in [0, 1) with 28 bits, from the MD5 digest of the value and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value).cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` says how often the mix takes the document and ``taken`` how many words
    that makes; ``carry`` names further input columns to hand through, whole, in a struct
    ``row``. Null text has size 0; a null source is a source of its own, last in order;
    null ids are one id. Documents without words take part and add no words. Repeated
    rows count one by one. No document is taken more than ``ceil(max_repeat)`` times.
    Runs agree, as nothing but the rows' values and their number decides.
    """
    size = word_count(F.col(text_col))
    slots = max(LEAST_SLOTS, -(-docs.count() // ROWS_A_SLOT))
    # rows of one id and size go by their text, and where whole rows are carried by these
    ties = [F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("tie")]
    if carry:
        ties = [F.xxhash64(*carry).alias("tie")]
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        *ties,
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    )
    bits = F.length(F.bin("size"))
    # size class: bit length and the next three bits
    band = bits * 8 + F.when(bits > 3, F.expr("shiftrightunsigned(size, cast(length(bin(size)) - 4 as int)) & 7L")).otherwise(F.col("size"))
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")).cast("binary")), 9, 7), 16, 10).cast("long") % slots
    base = base.withColumn("band", band.cast("long")).withColumn("slot", slot)
    if not carry:  # whole rows are read again rather than stored twice
        base = checkpoint(base)
    key = ["source", "band", "slot"]
    groups = base.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sums = targets(groups.groupBy("source").agg(F.sum("words").alias("size")), weights, max_repeat)
    along = Window.partitionBy("source").orderBy("band", "slot").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("words")
    g, s = groups.alias("g"), sums.alias("s")
    each = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    placed = (
        g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")))
        .select("g.*", "s.source_size", "s.target")
        .withColumn("whole", F.floor(each))
        .withColumn("part", each - F.col("whole"))
    )
    placed = checkpoint(placed)
    within = Window.partitionBy(*key).orderBy("size", "doc_id", "tie")
    b, p = base.withColumn("nth", F.row_number().over(within)).alias("b"), placed.alias("p")
    same = F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.band") == F.col("p.band")) & (F.col("b.slot") == F.col("p.slot"))
    x = b.join(p, same).select("b.*", "p.source_size", "p.target", "p.whole", "p.part", (F.col("p.before") + F.col("b.nth")).alias("at"))

    def crossed(offset):
        return F.least(F.floor(offset + F.col("at") * F.col("part")) - F.floor(offset + (F.col("at") - 1) * F.col("part")), F.lit(1))

    offset = _fraction(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), seed)
    x = x.withColumn("copies", (F.col("whole") + crossed(offset)).cast("long"))
    return x.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))
