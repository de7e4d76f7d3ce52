"""The data-quality gate: all checks of a batch from two aggregations, and a refusal to write on a blocking finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.size import suspicious_color_set

#: Least coverage by field with its severity, and the other bounds.
COVERAGE = {"title": (0.99, "block"), "price": (0.95, "block"), "url": (1.0, "block"), "images": (0.80, "warn"), "category": (0.50, "warn"), "description": (0.40, "info")}
NUMERIC_COLORS, ROUND_PRICES, OUTLIER, TITLES = 0.05, 0.60, 500, 0.30
COUNT_DRIFT, PRICE_DRIFT, COVERAGE_DRIFT = 0.30, 3.0, 0.20
COMPLETE_WARN, COMPLETE_BLOCK = 0.95, 0.80
SEVERITIES = ("block", "warn", "info")
SCHEMA = "severity string, check string, ratio double, detail string, samples array<string>"


def present() -> dict[str, Column]:
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return {
        "title": some("title"), "price": F.coalesce(F.col("price_min_cents") > 0, F.lit(False)), "url": some("url"), "images": F.coalesce(F.size("images") > 0, F.lit(False)),
        "category": F.col("category").isNotNull(), "description": some("description"),
    }


def coverage(products: DataFrame) -> DataFrame:
    """One row: the share of products that have each field."""
    return products.agg(*(F.avg(c.cast("int")).alias(name) for name, c in present().items()))


def undecoded(text: Column) -> Column:
    """Control characters, or more than one replacement character."""
    return F.coalesce(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit(""))) > 1), F.lit(False))


def measures(products: DataFrame) -> DataFrame:
    """One row with what all checks need; products: the canonical columns."""
    price = F.when(F.col("price_min_cents") > 0, F.col("price_min_cents"))
    colors = F.array_distinct(F.filter(F.transform("variants", lambda v: v["color"]["raw"]), lambda c: c.isNotNull()))
    odd = suspicious_color_set(colors)
    two = products.withColumn("_odd", odd).withColumn("_two", F.size(colors) >= 2).withColumn("_bad", undecoded(F.col("title")) | undecoded(F.coalesce("description", F.lit(""))))
    return two.agg(
        F.count("*").alias("n"),
        *(F.avg(c.cast("int")).alias(f"cov_{name}") for name, c in present().items()),
        F.count_if("_two").alias("two_colors"),
        F.count_if("_odd").alias("odd_colors"),
        F.count(price).alias("priced"),
        F.avg((price % 100000 == 0).cast("int")).alias("round_share"),
        F.count_if(F.col("compare_at_cents") <= F.col("price_min_cents")).alias("inverted"),
        F.percentile(price, F.lit(0.5)).alias("median_cents"),
        F.count_distinct("product_uid").alias("uids"),
        F.count_distinct("title_normalized").alias("titles"),
        F.count_if("_bad").alias("undecoded"),
    )


def samples(products: DataFrame, conditions: dict[str, Column], n: int = 5) -> dict[str, list[str]]:
    """Of the rows of each condition the n smallest ids, in one job; no more than n of each leave their partition."""
    names = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items())), lambda x: x.isNotNull())
    first = Window.partitionBy("_check").orderBy("product_uid")
    rows = products.select("product_uid", F.explode(names).alias("_check")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    out: dict[str, list[str]] = {k: [] for k in conditions}
    for r in sorted(rows.collect(), key=lambda r: r["_n"]):
        out[r["_check"]].append(r["product_uid"])
    return out


def validate(products: DataFrame, baseline: dict | None = None, expected: int | None = None) -> DataFrame:
    """Findings, blocking ones first, in the order of the checks. baseline: n_products, median_price_cents, coverage."""
    spark = products.sparkSession
    m = measures(products).first()
    found: list[tuple] = []

    def add(severity: str, check: str, ratio: float, detail: str, shown: list[str] | None = None) -> None:
        found.append((severity, check, float(ratio), detail, shown or []))

    n = m["n"]
    if n == 0:
        add("block", "vacio", 0, "no products")
        return spark.createDataFrame(found, SCHEMA)
    for name, (least, severity) in COVERAGE.items():
        if m[f"cov_{name}"] < least:
            add(severity, f"cobertura:{name}", m[f"cov_{name}"], f"{name} in {m[f'cov_{name}']:.1%}, at least {least:.0%} expected")
    colors = F.array_distinct(F.filter(F.transform("variants", lambda v: v["color"]["raw"]), lambda c: c.isNotNull()))
    price, many = F.col("price_min_cents"), m["priced"] > 20
    far = (price > m["median_cents"] * OUTLIER) | ((price > 0) & (price < m["median_cents"] / OUTLIER)) if many else F.lit(False)
    rows = {"far": (far, many), "odd": (suspicious_color_set(colors), m["odd_colors"]), "inverted": (F.col("compare_at_cents") <= price, m["inverted"]), "undecoded": (undecoded(F.col("title")) | undecoded(F.coalesce("description", F.lit(""))), m["undecoded"])}
    wanted = {k: c for k, (c, needed) in rows.items() if needed}
    shown = samples(products, wanted) if wanted else {}
    if m["odd_colors"]:
        share = m["odd_colors"] / n
        add("block" if share > NUMERIC_COLORS else "warn", "semantica:color-numerico", share, "colors that look like numbers", shown["odd"])
    if not m["priced"]:
        add("block", "precio:vacio", 0, "no positive price")
    else:
        if m["round_share"] > ROUND_PRICES:
            add("warn", "precio:demasiado-redondo", m["round_share"], "prices that are whole thousands")
        if m["inverted"]:
            add("warn", "precio:descuento-invertido", m["inverted"] / n, "list price not above the price", shown["inverted"])
        if shown.get("far"):
            add("warn", "precio:outlier", products.where(far).count() / m["priced"], "prices far from the median", shown["far"])
    if n - m["uids"]:
        add("block", "identidad:duplicados", (n - m["uids"]) / n, "repeated product ids")
    if m["titles"] / n < TITLES:
        add("block", "identidad:titulos-repetidos", m["titles"] / n, "too few distinct titles")
    if m["undecoded"]:
        add("block", "contenido:no-decodificado", m["undecoded"] / n, "texts that were not decoded", shown["undecoded"])
    if baseline:
        before = baseline.get("n_products") or 0
        if before and abs(n - before) / before > COUNT_DRIFT:
            add("warn", "deriva:cantidad", (n - before) / before, f"{before} products before, {n} now")
        old = baseline.get("median_price_cents") or 0
        if old and m["median_cents"]:
            ratio = m["median_cents"] / old
            if ratio > PRICE_DRIFT or ratio < 1 / PRICE_DRIFT:
                add("block", "deriva:precio", ratio, "median price against the baseline")
        for name, was in (baseline.get("coverage") or {}).items():
            if name in COVERAGE and was - m[f"cov_{name}"] > COVERAGE_DRIFT:
                add("warn", f"deriva:cobertura:{name}", m[f"cov_{name}"] - was, "coverage fell")
    if expected:
        got = n / expected
        if got < COMPLETE_WARN:
            add("block" if got < COMPLETE_BLOCK else "warn", "completitud", got, f"{n} of {expected} expected")
    found.sort(key=lambda f: SEVERITIES.index(f[0]))
    return spark.createDataFrame(found, SCHEMA)


class Refused(RuntimeError):
    """A batch with blocking findings."""


def gate(findings: DataFrame, force: bool = False) -> None:
    blocks = [r["check"] for r in findings.where("severity = 'block'").select("check").collect()]
    if blocks and not force:
        raise Refused(", ".join(blocks))


def baseline(products: DataFrame) -> DataFrame:
    """The row that the next batch is compared with: n_products, median_price_cents (truncated), coverage."""
    m = measures(products)
    return m.select(F.col("n").alias("n_products"), F.col("median_cents").cast("long").alias("median_price_cents"), F.struct(*(F.col(f"cov_{c}").alias(c) for c in COVERAGE)).alias("coverage"))
