"""Every catalogue query against its DuckDB text at the smallest scale."""

import math
import os

import duckdb
import pytest

from tejido.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    else:
        assert rows


def test_quality_findings_where_names_repeat(spark, tmp_path):
    """As in larger tables: many parts, few names."""
    from pyspark.sql import functions as F

    many = spark.range(3).crossJoin(spark.read.parquet(f"{SF}/part.parquet")).withColumns({"p_partkey": F.col("p_partkey") + 420 * F.col("id"), "p_name": F.lit("name")}).drop("id")
    many.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    result = con.execute(ORACLE_SQL["quality_findings"])
    names = [d[0] for d in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in QUERIES["quality_findings"](spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("name", ["map_shopify", "map_generic_pages", "map_tiendanube", "map_zara", "map_vtex", "map_magento", "map_marketplace"])
def test_mappers_deal_parts_out_before_the_work(spark, tmp_path, name):
    """One small file, whose rows are mapped by several tasks; nothing is parsed before they are dealt out."""
    from pyspark.sql import functions as F

    part = spark.range(60).crossJoin(spark.read.parquet(f"{SF}/part.parquet")).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("id")).drop("id")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = part.count() // 5000 + 1
    lines = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    assert tasks > 2 and dealt and all(f", {tasks})" in lines[i] for i in dealt)
    for i in dealt:
        scan = next(j for j in range(i, len(lines)) if "FileScan" in lines[j])
        assert not any("json" in x or "Generate" in x for x in lines[i + 1 : scan])
    assert len(dealt) == sum("FileScan" in x for x in lines)
