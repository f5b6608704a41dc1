"""Samples and splits that do not depend on how rows are dealt: rows are ordered by a digest of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(key: str | Column, seed: int = 0) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))))


def reservoir_sample(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows, each as likely as any other (all rows, if fewer)."""
    return df.orderBy(digest(key, seed), key).limit(k)


#: Rows beside the sample that a class's ranking may see.
MORE_ROWS = 1000


def stratified_sample(df: DataFrame, per_class: dict, label: str, key: str, seed: int = 0) -> DataFrame:
    """min(k, n) rows of each class y, of which it has n, for per_class[y] = k; rows of other classes are dropped.

    Those with the smallest digests of their keys; among rows of one key any. Counts by the digests' first digits, and
    within the range that holds the k-th row by more of them, say how far each class has to be read, so that the ranking
    sees little more than the sample, even if a class holds most of the table or one key most of a class.
    """
    if not per_class:
        return df.limit(0)
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    classes = spark.createDataFrame([(str(y), int(k)) for y, k in per_class.items()], "y string, k long").select(F.col("y").cast(kind).alias("__class"), F.col("k").alias("__wanted"))
    own = df.join(F.broadcast(classes), F.col(label) == F.col("__class")).withColumn("__digest", digest(key, seed))
    open_ = {r["__class"]: (r["__wanted"], "") for r in classes.collect()}  # rows still wanted, and the range they begin in
    ends: dict[object, tuple[str, float]] = {}  # of each class: the last range, and the share of it that is read
    while open_:
        size = len(next(iter(open_.values()))[1]) + 4
        inside = F.lit(False)
        for y, (_, start) in open_.items():
            inside = inside | ((F.col("__class") == F.lit(y)) & F.col("__digest").startswith(start))
        counts: dict[object, list] = {}
        for r in own.where(inside).groupBy("__class", F.substring("__digest", 1, size).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # at most 16 ** 4 rows a class
            counts.setdefault(r["__class"], []).append((r["d"], r["n"]))
        now, open_ = open_, {}
        for y, (k, _) in now.items():
            for d, n in counts.get(y, ()):
                if n >= k:
                    if n <= k + MORE_ROWS:
                        ends[y] = d, 1.0
                    elif size == 32:  # rows of one key: more of them than are wanted, by twelve standard deviations
                        ends[y] = d, min(1.0, (k + 12 * (k + 1) ** 0.5 + 50) / n)
                    else:
                        open_[y] = k, d
                    break
                k -= n
    near = F.lit(True)  # a class with fewer rows than wanted is read whole
    for y, (d, share) in ends.items():
        first = F.substring("__digest", 1, len(d))
        within = first <= d if share == 1.0 else (first < d) | ((first == d) & (F.rand(seed) < share))
        near = F.when(F.col("__class") == F.lit(y), within).otherwise(near)
    rank = F.row_number().over(Window.partitionBy("__class").orderBy("__digest", key))
    return own.where(near).withColumn("__rank", rank).where(F.col("__rank") <= F.col("__wanted")).select(*df.columns)


def split_bucket(key: str | Column, seed: int = 0) -> Column:
    """0 to 99, from the digest."""
    return (F.conv(F.substring(digest(key, seed), 1, 7), 16, 10).cast("long") % 100).cast("int")


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """df with `split`, train or test; a row's side depends on its key alone."""
    return df.withColumn("split", F.when(split_bucket(key, seed) < round(100 * test_size), F.lit("test")).otherwise(F.lit("train")))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null or NaN in columns (all of them by default); vectors must have no such element either."""
    for c in columns or df.columns:
        kind = df.schema[c].dataType.simpleString()
        ok = F.col(c).isNotNull()
        if kind in ("double", "float"):
            ok = ok & ~F.isnan(c)
        elif kind in ("array<double>", "array<float>"):
            ok = ok & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
        df = df.where(ok)
    return df
