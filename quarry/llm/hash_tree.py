"""Sharding by a weighted hash tree: region, then rack, then shard.

At every inner node each child draws ``-ln(u) / weight`` where ``u`` is a hash
of the key and the child's path; the smallest draw wins, so a child receives a
share of keys in proportion to its weight.  A draw depends only on the key,
the child's path and the child's weight: a changed weight moves keys only
between the changed subtree and its siblings, and a new child takes keys only
into itself.  Everything is a column expression; keys are never shuffled to be
placed.

Cases: a null key is a key of its own; rows that repeat a key go to one shard;
a null text counts 1 byte and has the checksum of the empty text; an empty
table gives no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


@dataclass(frozen=True)
class HashTree:
    """``regions[r][k]`` holds the weights of the shards of rack ``k`` in region ``r``.

    Shards are numbered in order of (region, rack, position).
    """

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def regular(cls, regions: int, racks: int, shards: int) -> HashTree:
        return cls((((1.0,) * shards,) * racks,) * regions)

    def with_region(self, *racks: tuple[float, ...]) -> HashTree:
        """The tree with one region more; the new shards take the next numbers."""
        return HashTree((*self.regions, tuple(racks)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def place(self, key: Column) -> Column:
        """Shard number of a key."""
        placed, first = [], 0
        for r, region in enumerate(self.regions):
            racks = []
            for k, rack in enumerate(region):
                racks.append(_descend(key, f"{r}/{k}", rack, [F.lit(first + i) for i in range(len(rack))]))
                first += len(rack)
            placed.append(_descend(key, f"{r}", [sum(rack) for rack in region], racks))
        return _descend(key, "", [sum(map(sum, region)) for region in self.regions], placed)


def _descend(key: Column, path: str, weights, below: list[Column]) -> Column:
    """The child with the least draw; children without weight never win."""
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        return F.lit(None).cast("int")
    draws = [F.struct((-F.log(_unit(key, f"{path}/{i}")) / F.lit(w)).alias("draw"), F.lit(i).alias("child"))
             for i, w in live]
    if len(draws) == 1:
        return below[live[0][0]]
    winner = F.array_min(F.array(*draws))["child"]
    picked = F.when(winner == live[0][0], below[live[0][0]])
    for i, _ in live[1:-1]:
        picked = picked.when(winner == i, below[i])
    return picked.otherwise(below[live[-1][0]])


def _unit(key: Column, path: str) -> Column:
    """Uniform in (0, 1), from 52 bits of the hash of key and path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_documents(df: DataFrame, tree: HashTree, grown: HashTree | None = None, *, key_col: str = "doc_id",
                    text_col: str = "text", blocks: int = 1024) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of every row.

    ``slot`` numbers the rows of a shard from 0 without gaps: rows are dealt to
    ``blocks`` hash blocks per shard, a table of n_shards x blocks counts gives
    each block's first slot, and rows are numbered inside their block only.  At
    larger inputs ``blocks`` is raised so that a block stays a task's work.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(key_col).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"),
                     F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", tree.place(F.col("key")).alias("shard"),
                       (grown.place(F.col("key")) if grown else F.lit(None).cast("int")).alias("grown_shard"),
                       F.pmod(F.xxhash64(F.lit("block"), "key", "text_crc32", "size"), F.lit(blocks)).alias("block"))
    rows = checkpointed(rows)  # some 40 bytes a row; the texts are read once
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside))
    # the table of block starts has n_shards x blocks rows at most, a bound that the caller sets
    return (numbered.join(F.broadcast(starts), ["shard", "block"])
            .select(F.col("key").alias(key_col), "size", "text_crc32", "shard", "grown_shard",
                    (F.col("first") + F.col("at") - 1).cast("long").alias("slot")))
