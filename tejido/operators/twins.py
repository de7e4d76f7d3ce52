"""Stores that are one catalogue behind several domains: an exact similarity join of their sets of product keys by parts that agree.

Keys are dealt by hash into parts, as many for all sets of about one size. Each key that only one of two sets has changes one part,
so of two sets that are as similar all parts but a known number agree; stores meet by the digest of a part. Sets with unusually many
empty parts meet by these too. What meets often enough is compared exactly. Keys of a store are rows throughout, streamed and
sorted in the task of their store; none is sent on but of stores that met.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts beyond those that may differ, as half the share of a set's keys: more let fewer empty parts count, fewer are larger.
MARGIN = 0.03
#: Ranges of sizes are no narrower than this, and go up to more keys than any store has.
NARROWEST, MOST = 1.05, 1 << 40


def size_levels(percent: int, margin: float) -> list[tuple[int, int, int, int]]:
    """(first size, parts, parts to be filled, least parts that agree) of each range of sizes.

    Two similar sets lie in one range or in neighbours, and meet by the range of the smaller one. `differ` of its parts may differ, so
    `spare` agree; if one of the sets fills as many parts as told here, `least` of those hold a key. Where sets as dissimilar may
    be similar that they could not fill as many, each key is a part of its own.
    """
    out, start = [], 1
    while start < MOST:
        following = max(100 * start // percent, math.floor(start * NARROWEST)) + 1
        differ = (following - 1) * (100 - percent) // percent
        spare = 3 + math.ceil(2 * margin * (following - 1)) if differ else 1
        least = 1 + spare // 4
        expected = (differ + spare) * (1 - math.exp(-start / (differ + spare)))
        out.append((start, differ + spare, differ + least, least) if not differ or expected >= differ + least else (start, 1 << 62, 0, math.ceil(start * percent / 100)))
        start = following
    return out


def twins(items: DataFrame, percent: int = 80, store: str = "store", key: str = "key", margin: float = MARGIN) -> DataFrame:
    """store_a < store_b, shared, n_a, n_b of stores whose sets of keys have a Jaccard similarity of `percent` or more.

    Null stores and keys are left out; repeated rows count once.
    """
    starts, parts, full, least = (F.array(*(F.lit(x).cast("long") for x in column)) for column in zip(*size_levels(percent, margin)))
    rows = items.select(F.col(store).alias("store"), F.col(key).alias("key")).where("store is not null and key is not null").repartition("store").distinct()
    sized = rows.select("store", F.xxhash64("key").alias("h"), F.count("*").over(Window.partitionBy("store")).alias("n"))
    # Each set stands in its own range, at the odd place, and in the one below, where it may be the larger of two.
    own = 2 * (F.size(starts) - F.size(F.filter(starts, lambda s: s > F.col("n")))) - 1
    placed = sized.withColumn("own", own).select("store", "h", F.explode(F.when(F.col("own") > 1, F.array(F.col("own"), F.col("own") - 3)).otherwise(F.array("own"))).alias("place"))
    level = F.floor(F.col("place") / 2).cast("int")
    digests = placed.groupBy("store", "place", F.pmod("h", F.get(parts, level)).alias("part")).agg(F.bit_xor("h").alias("digest"))
    of_set = Window.partitionBy("store", "place")
    in_order = of_set.orderBy("part")
    seen = digests.select("*", F.count("*").over(of_set).alias("filled"), F.lag("part", 1, -1).over(in_order).alias("before"), F.lead("part").over(in_order).alias("next"))
    empty = lambda first, end: F.when(first < end, F.transform(F.sequence(first, end - 1), lambda i: F.struct(i.alias("part"), F.lit(0).cast("long").alias("digest")))).otherwise(F.array().cast("array<struct<part:bigint,digest:bigint>>"))
    itself = F.array(F.struct("part", "digest"))
    around = F.concat(empty(F.col("before") + 1, F.col("part")), itself, F.when(F.col("next").isNull(), empty(F.col("part") + 1, F.get(parts, level))).otherwise(F.array().cast("array<struct<part:bigint,digest:bigint>>")))
    signs = seen.select("store", "place", F.explode(F.when(F.col("filled") < F.get(full, level), around).otherwise(itself)).alias("s")).select("store", level.alias("level"), (F.col("place") % 2 == 1).alias("own"), F.hash("s.part", "s.digest").alias("sign"))
    side = lambda end: signs.select("level", "sign", F.col("store").alias(f"store{end}"), F.col("own").alias(f"own{end}"))
    both = side("_a").join(side("_b"), ["level", "sign"]).where("store_a < store_b and (own_a or own_b)")
    meet = both.groupBy("store_a", "store_b", "level").agg(F.count("*").alias("agree")).where(F.col("agree") >= F.get(least, F.col("level"))).select("store_a", "store_b")
    keys = lambda end: meet.join(rows.withColumnRenamed("store", f"store{end}"), f"store{end}").select("store_a", "store_b", "key", F.lit(end == "_a").alias("of_a"))
    # Both sides come together where the first store's keys are.
    met = keys("_a").unionByName(keys("_b").repartition("store_a")).groupBy("store_a", "store_b", "key").agg(F.bool_or("of_a").alias("a"), F.bool_or(~F.col("of_a")).alias("b"))
    counted = met.groupBy("store_a", "store_b").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"))
    return counted.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))
