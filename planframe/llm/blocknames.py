"""Exact dedup by deterministic block naming.

Every text is cut into blocks of ``block_bytes`` UTF-8 bytes. The distinct blocks are
sorted and numbered; then, level by level, the distinct pairs of adjacent numbers are
sorted and numbered, until one number is left for each document. Equal numbers at the
same level mean equal texts and unequal ones unequal texts: the names are positions in
sorted lists of distinct values, not digests, so they cannot collide. Each partition has a
list of its own and a name says which, so names depend on the number of partitions; which
texts have the same name does not.

Scale: whole texts are shuffled once (distinct blocks, collapsed before the shuffle).
Everything else moves rows of a few integers. A block reaches its name by a 64-bit key;
a key that stands for two different blocks is looked up by the block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stable

BLOCK_BYTES = 32768


def _sorted_names(distinct: DataFrame, *keys: str) -> DataFrame:
    """Number rows that are already distinct: sort each partition, number by place.

    The partition's number is the high part, so names are unique over all partitions.
    The result is checkpointed: all later reads see the same numbers.
    """
    return checkpoint(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def block_names(rows: DataFrame, text: Column, key: Column, block_bytes: int = BLOCK_BYTES, block_key=None) -> DataFrame:
    """One row per input row: ``key``, ``level`` and ``name``, equal exactly for equal texts.

    ``key`` must be unique. ``block_key`` maps a binary column to a long and is
    ``xxhash64`` unless tests want collisions.
    """
    block_key = block_key or F.xxhash64
    data = F.coalesce(text, F.lit("")).cast("binary")
    # the length is of the binary value: octet_length(string) and this agree
    blocks = (
        rows.select(key.alias("key"), data.alias("data"))
        .withColumn("n", F.greatest(F.ceil(F.octet_length("data") / F.lit(block_bytes)), F.lit(1)).cast("int"))
        .select("key", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "data")
        .select("key", "n", "i", F.expr(f"substring(data, i * {int(block_bytes)} + 1, {int(block_bytes)})").alias("block"))
        .withColumn("h", block_key("block"))
    )
    named = _sorted_names(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")).drop("one"), "block")
    # one row for each distinct block; plain, so that the rows of a frequent block can be split
    by_key = checkpoint(named.groupBy("h").agg(F.count("*").alias("blocks"), F.min("name").alias("name")))
    held = checkpoint(blocks.select("key", "n", "i", "h"))
    seq = held.join(by_key, "h").select("key", "n", "i", "name", "blocks")
    clashing = by_key.where("blocks > 1").select("h")
    if not clashing.isEmpty():
        exact = (
            blocks.join(clashing, "h", "left_semi")
            .join(named, ["h", "block"])
            .select("key", "n", "i", "name")
        )
        seq = seq.where("blocks = 1").drop("blocks").unionByName(exact)
    else:
        seq = seq.drop("blocks")
    done, level = None, 0
    while True:
        ended = seq.where("n = 1").select("key", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        rest = seq.where("n > 1")
        # adjacent numbers meet in one row; an odd last one is paired with -1, which is no name
        pairs = checkpoint(
            rest.groupBy("key", "n", F.expr("i div 2").alias("i")).agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        if pairs.isEmpty():
            return done
        names = _sorted_names(pairs.select("a", "b").distinct(), "a", "b")
        seq = pairs.join(names, ["a", "b"]).select("key", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.col("i").cast("int").alias("i"), "name")
        level += 1


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, block_key=None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts (null counts as empty, nothing is normalised) the row with the largest
    ``id_col`` stays; a null id is less than any other; among repeated rows with that same
    id and text exactly one stays. Other columns are not read. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = stable(docs.select(id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    facts = checkpoint(rows.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    names = block_names(rows, F.col("text"), F.col("row"), block_bytes, block_key).withColumnRenamed("key", "row")
    named = checkpoint(facts.join(names, "row"))
    groups = named.groupBy("level", "name").agg(
        F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("keep")
    )
    # with both sides plain, adaptive execution can split the rows of a large group
    groups = checkpoint(groups)
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("keep.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )
