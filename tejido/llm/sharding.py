"""Minimax contiguous sharding.

Rows with equal texts form one atomic group. Groups are ordered by size, largest first (ties: by digest), and the
smallest shard capacity for which a greedy left-to-right filling needs no more than the given number of shards is found by
binary search; the first shard is cut there, and the search is repeated over what is left, so that a group larger than
the mean does not leave later shards uneven or empty.

In this order the sequence of sizes is fully given by how many groups there are of each size. Distinct sizes number at
most sqrt(2 x total bytes), so the driver holds a short histogram, never the groups; a feasibility check costs one binary
search per shard. The rows themselves are sorted once by (group size, digest, doc_id) in range partitions, which splits
a hot group over many tasks, and a row's place in that order gives shard and slot.

Null text: size 16, grouped with empty texts. Repeated rows and repeated ids are kept, each with its own slot. An empty
table gives no rows. Groups too few for the shards leave the last shards empty. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROW_BYTES = 16


class Histogram:
    """Group sizes in descending order as runs (size, how many), with prefix sums at the run ends."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        self.sizes, self.counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
        self.bytes_to = np.concatenate([[0], np.cumsum(self.sizes * self.counts)])
        self.groups_to = np.concatenate([[0], np.cumsum(self.counts)])
        self.groups, self.total = int(self.groups_to[-1]), int(self.bytes_to[-1])

    def upto(self, group: int) -> int:
        """Bytes of the first `group` groups."""
        run = min(int(np.searchsorted(self.groups_to, group, "right")) - 1, len(self.sizes) - 1)
        return int(self.bytes_to[run] + (group - self.groups_to[run]) * self.sizes[run])

    def reach(self, limit: int) -> int:
        """The most leading groups whose bytes do not exceed limit."""
        run = int(np.searchsorted(self.bytes_to, limit, "right")) - 1
        if run >= len(self.sizes):
            return self.groups
        return int(self.groups_to[run] + (limit - self.bytes_to[run]) // self.sizes[run])

    def feasible(self, start: int, shards: int, capacity: int) -> bool:
        for _ in range(shards):
            start = self.reach(self.upto(start) + capacity)
            if start == self.groups:
                return True
        return False

    def capacity(self, start: int, shards: int) -> int:
        """The smallest capacity by which the groups from start on fit into so many shards."""
        rest = self.total - self.upto(start)
        largest = self.upto(start + 1) - self.upto(start)
        low = max(largest, -(-rest // shards))
        high = low + largest
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(start, shards, mid) else (mid + 1, high)
        return low

    def cuts(self, shards: int) -> tuple[list[int], int]:
        """The first group of each shard, with the number of groups at the end; and the minimax capacity."""
        starts, most = [0], 0
        for k in range(shards):
            at = starts[-1]
            if at < self.groups:
                c = self.capacity(at, shards - k)
                most = max(most, c)
                at = self.reach(self.upto(at) + c)
            starts.append(at)
        return starts, most


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, group_rows, group_bytes, shard, slot, capacity: one row per row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.count("*").alias("group_rows"), F.sum("size").alias("group_bytes"))
    # Only groups of several rows take part in the join; a hot one is split there by adaptive execution.
    several = groups.where("group_rows > 1")
    sized = (
        rows.join(several, "digest", "left")
        .withColumn("group_rows", F.coalesce("group_rows", F.lit(1)))
        .withColumn("group_bytes", F.coalesce("group_bytes", "size"))
    )
    ordered = written(
        sized.orderBy(F.desc("group_bytes"), "digest", "doc_id").withColumn("place", F.monotonically_increasing_id()),
        "shard-order",
    )
    part = F.shiftright("place", 33)
    histogram = groups.groupBy("group_bytes").agg(F.count("*").alias("n")).toPandas()
    if histogram.empty:
        return ordered.select(
            "doc_id", "size", "text_crc32", "group_rows", "group_bytes",
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("capacity"),
        )
    h = Histogram(histogram["group_bytes"].to_numpy(), histogram["n"].to_numpy())
    starts, most = h.cuts(shards)
    # Bytes before a row's group are known from its place in the order; the cuts are given in bytes too.
    edges = [h.upto(g) for g in starts[1:-1]]
    per_part = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("part").toPandas()
    per_part["rows_before"] = per_part["n"].cumsum() - per_part["n"]
    per_part["bytes_before"] = per_part["b"].cumsum() - per_part["b"]
    before = spark.createDataFrame(per_part[["part", "rows_before", "bytes_before"]])
    # Running bytes within each range partition; a partition is one file and one task's work here already.
    from pyspark.sql import Window

    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ordered.withColumn("part", part)
        .withColumn("own_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(F.broadcast(before), "part")
        .select(
            "doc_id", "size", "text_crc32", "group_rows", "group_bytes",
            (F.col("rows_before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("at"),
            (F.col("bytes_before") + F.col("own_before")).alias("bytes_at"),
        )
    )
    # A cut lies between groups, so the first row of a shard starts exactly at the cut's byte.
    which = sum((F.when(F.col("bytes_at") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    placed = written(placed.withColumn("shard", which), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "group_rows", "group_bytes", "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(most).cast("long").alias("capacity"),
    )
