"""Exact-size, repeatable samples and splits.

A row's place in the sample is the md5 of its key and the seed, so the same rows come out
whatever the number of partitions or executors. The cut is found from a histogram over the
first hex digits (at most 65,536 counts per stratum) plus the exact order inside the single
boundary bucket; no task ever sorts or collects the whole table.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.session import settle

_HEX_DIGITS = 4
MAX_STRATA = 200


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """Hex md5 of ``key|key|...|seed``; the keys must identify a row."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def _cuts(
    df: DataFrame, keys: Sequence[str], seed: int, quota: Column, strata: Sequence[str]
) -> DataFrame:
    """Per stratum the last hash that is still inside the quota (no row when the quota is 0).

    ``quota`` is an expression over ``stratum_rows`` and, for shares, the stratum columns.
    """
    hashed = df.select(*strata, row_hash(keys, seed).alias("h"))
    bucketed = hashed.withColumn("bucket", F.substring("h", 1, _HEX_DIGITS))
    counts = bucketed.groupBy(*strata, "bucket").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(*strata).orderBy("bucket")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = counts.select(
        *strata,
        "bucket",
        "n",
        F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(Window.partitionBy(*strata)).alias("stratum_rows"),
    ).withColumn("quota", F.least(quota.cast("bigint"), F.col("stratum_rows")))
    boundary = marked.where(
        (F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota"))
    ).select(*strata, "bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("need"))
    inside = bucketed.join(F.broadcast(boundary), [*strata, "bucket"])
    place = F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy("h"))
    return (
        inside.withColumn("place", place)
        .where(F.col("place") == F.col("need"))
        .select(*strata, F.col("h").alias("cut"))
    )


def mark_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    quota: Column,
    strata: Sequence[str] = (),
    name: str = "taken",
) -> DataFrame:
    """Add a boolean that is true for exactly the quota of rows in every stratum.

    Up to ``MAX_STRATA`` cuts become a CASE expression and no row is moved; beyond, the table of
    cuts is joined. Rows with a null stratum are not taken.
    """
    cuts = _cuts(df, keys, seed, quota, strata)
    h = row_hash(keys, seed)
    if not strata:
        return df.withColumn(name, F.coalesce(h <= cuts.scalar(), F.lit(False)))
    cuts = settle(cuts)
    rows = cuts.limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        marked = df.join(cuts.withColumnRenamed("cut", "_cut"), list(strata), "left")
        taken = F.coalesce(h <= F.col("_cut"), F.lit(False))
        return marked.select(*[F.col(f"`{c}`") for c in df.columns], taken.alias(name))
    inside = F.lit(False)
    for row in rows:
        same = reduce(lambda a, b: a & b, [F.col(s) == F.lit(row[s]) for s in strata])
        inside = F.when(same, h <= F.lit(row["cut"])).otherwise(inside)
    return df.withColumn(name, inside)


def take_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run.

    Two scans: a histogram over the hash prefixes, which reads the keys only, and one filter up
    to the boundary bucket. Those rows (n and a 65,536th of the table) are settled, and the exact
    cut inside the boundary bucket is made on them.
    """
    if n <= 0:
        raise ValueError(f"sample size must be positive (got {n})")
    hashed = df.withColumn("_h", row_hash(keys, seed))
    prefix = F.substring("_h", 1, _HEX_DIGITS)
    counts = hashed.groupBy(prefix.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    boundary = counts.withColumn("upto", upto).where(F.col("upto") >= n).orderBy("bucket").first()
    if boundary is None:
        return df
    need = n - (boundary["upto"] - boundary["n"])
    near = settle(hashed.where(prefix <= boundary["bucket"]))
    edge = near.where(prefix == boundary["bucket"]).select("_h").orderBy("_h").limit(need)
    return near.where(F.col("_h") <= edge.agg(F.max("_h")).scalar()).drop("_h")


def cap_rows(df: DataFrame, max_rows: int | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The frame itself when it is small enough, else a sample of ``max_rows`` rows."""
    return df if max_rows is None else take_rows(df, max_rows, keys, seed)


def split_rows(
    df: DataFrame,
    keys: Sequence[str],
    valid_fraction: float = 0.2,
    seed: int = 42,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Add ``is_valid``: the hash-first ceil(fraction x rows) rows of every stratum."""
    if not 0 < valid_fraction < 1:
        raise ValueError(f"valid_fraction must be in (0, 1) (got {valid_fraction})")
    quota = F.ceil(F.col("stratum_rows") * F.lit(float(valid_fraction)))
    return mark_by_hash(df, keys, seed, quota, strata, "is_valid")


def stratified_quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Whole-number quotas that add up to ``total``, by largest remainder."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()
    exact = F.lit(float(total)) * F.col("rows") / F.sum("rows").over(everything)
    parts = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    order = Window.orderBy((F.col("base") - F.col("exact")).asc(), F.col(stratum).asc())
    spare = F.lit(total) - F.sum("base").over(everything)
    bonus = (F.row_number().over(order) <= spare).cast("bigint")
    return parts.select(stratum, F.least(F.col("base") + bonus, F.col("rows")).alias("quota"))


def cap_stratified(
    df: DataFrame, max_rows: int | None, keys: Sequence[str], stratum: str, seed: int = 42
) -> DataFrame:
    """At most ``max_rows`` rows with the class shares of the input."""
    if max_rows is None:
        return df
    # A handful of classes: their quotas become one CASE expression.
    quota = F.lit(None).cast("bigint")
    for row in stratified_quotas(df, stratum, max_rows).collect():
        quota = F.when(F.col(stratum) == row[stratum], row["quota"]).otherwise(quota)
    marked = mark_by_hash(df, keys, seed, quota, [stratum])
    return marked.where("taken").drop("taken")
