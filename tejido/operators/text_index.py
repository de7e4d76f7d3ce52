"""An inverted index of the trigrams of titles, for exact top rows by trigram similarity under any filter.

Each different title stands once under each of its trigrams, beside the number of its trigrams. A title that shares c of the
m trigrams asked for, and has n, is c / (m + n - c) similar. Trigrams are read from the rarest on: a title that comes first with the
j-th shares m - j + 1 at most, so its similarity is (m - j + 1) / m at most, which is the bound by which reading stops
(best_first.py). What is found is measured by its own text, so common trigrams needn't be read for titles that are known
already. Titles that share nothing come last, all at distance 1.

Entries are stored by buckets of trigrams, sorted, so that reading some trigrams is partition pruning and a pushed filter; a
trigram that very many titles have is spread over files of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import trigram_similarity, trigrams
from . import search as S
from .best_first import Found, best_first

BUCKETS = 64
ENTRIES = "title string, n int, gram string, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    path: str
    text: str

    def rarest_first(self, spark: SparkSession, asked: str) -> list[tuple[str, int]]:
        """The trigrams asked for and in how many titles each is; those that no title has are left out."""
        held = spark.read.parquet(f"{self.path}/counts")
        own = spark.range(1).select(F.explode(trigrams(F.lit(asked))).alias("gram"))
        return [(r["gram"], r["n"]) for r in held.join(F.broadcast(own), "gram").orderBy("n", "gram").collect()]

    def nearest(self, spark: SparkSession, asked: str, k: int, tie: str, filtered: Callable[[DataFrame], DataFrame] = lambda rows: rows, keys=(), dedupe=None) -> Found:
        """The k rows most similar to the text (see best_first). Found.opened counts trigrams; one more if rows that share none were needed."""
        m = spark.range(1).select(F.size(trigrams(F.lit(asked)))).first()[0]
        grams = self.rarest_first(spark, asked)
        bounds = [1 - (len(grams) - j) / m for j in range(len(grams))] + [1.0]
        entries, rows = spark.read.schema(ENTRIES).parquet(f"{self.path}/entries"), spark.read.parquet(f"{self.path}/rows")
        distance = 1 - trigram_similarity(F.col(self.text), F.lit(asked))

        def read(parts: list[int]) -> DataFrame:
            if parts[-1] == len(grams):
                return filtered(rows).withColumn("distance", distance)
            own = [grams[p][0] for p in parts]
            place = spark.createDataFrame([(g,) for g in own], "gram string").select(_bucket(F.col("gram"))).collect()
            titles = entries.where(F.col("bucket").isin(sorted({r[0] for r in place})) & F.col("gram").isin(own)).select(F.col("title").alias(self.text)).distinct()
            return filtered(rows.join(titles, self.text, "left_semi")).withColumn("distance", distance)

        return best_first(bounds, read, k, tie, keys, dedupe)


def build(rows: DataFrame, path: str, text: str = "title_normalized") -> TextIndex:
    """Writes the index of rows to a folder. Rows whose text is null share nothing with any text."""
    rows.hint("rebalance", text).sortWithinPartitions(text).write.mode("overwrite").parquet(f"{path}/rows")
    titles = rows.select(F.col(text).alias("title")).where(F.col("title").isNotNull()).distinct().withColumn("grams", trigrams(F.col("title")))
    entries = titles.select("title", F.size("grams").alias("n"), F.explode("grams").alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    entries.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "n").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/entries")
    counts = rows.sparkSession.read.schema(ENTRIES).parquet(f"{path}/entries").groupBy("gram").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    return TextIndex(path, text)


def search(index: TextIndex, stores: DataFrame, filters: S.Filters, text: str, limit: int = 12, offset: int = 0) -> DataFrame:
    """What search.search() gives for words, by the index."""
    S._checked(limit, offset)
    conditions = S._all([*S.hard_conditions(filters), *S.soft_conditions(filters).values()])
    found = index.nearest(stores.sparkSession, text, limit + offset, "product_uid", lambda rows: S.with_store(rows, stores).where(conditions), ("title_normalized", "brand"), S.best_per_title)
    return S.shaped(S.page(found.rows, limit, offset))
