"""Reading and writing tables of texts: delimited files, JSON lines, Parquet; labelled and unlabelled rows as one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, paths: str | Iterable[str], *, schema: str | None = None, **options) -> DataFrame:
    """Delimited files (compressed or not, path patterns too), in the order of paths' names; options as Spark's csv reader has them.

    Fields may hold line ends if quoted. Without a header columns are _c0, _c1 ...
    """
    reader = spark.read.options(**{"multiLine": True} | options)
    if schema:
        reader = reader.schema(schema)
    return reader.csv([paths] if isinstance(paths, str) else list(paths))


def read_json_lines(spark: SparkSession, paths: str | Iterable[str], field: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines; with field, that field alone (the scan reads no other)."""
    reader = spark.read.schema(schema) if schema else spark.read
    out = reader.json([paths] if isinstance(paths, str) else list(paths))
    return out.select(field) if field else out


def write_json_lines(df: DataFrame, path: str, compression: str | None = "gzip") -> None:
    df.write.mode("overwrite").option("compression", compression or "none").json(path)


def read_rows(df: DataFrame, field: str | None = None) -> Iterator:
    """Rows as dictionaries, or one field's values, partition by partition."""
    for row in (df.select(field) if field else df).toLocalIterator():
        yield row[0] if field else row.asDict(recursive=True)


def project_fields(df: DataFrame, fields: dict[str, str | int]) -> DataFrame:
    """The canonical columns X and Y; fields: their names in df, or their places."""
    name = lambda f: df.columns[f] if isinstance(f, int) else f
    out = [F.col(name(fields["X"])).cast("string").alias("X")]
    out.append(F.col(name(fields["Y"])).cast("int").alias("Y") if "Y" in fields else F.lit(None).cast("int").alias("Y"))
    return df.select(*out)


def union_labeled(labeled: DataFrame | None, unlabeled: DataFrame | None, config: dict) -> DataFrame:
    """Labelled rows, then unlabelled ones with a null Y."""
    data = config["data"]
    parts = [project_fields(d, data[k]) for d, k in ((labeled, "labeled"), (unlabeled, "unlabeled")) if d is not None and data[k]]
    if not parts:
        raise ValueError("no input")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_split(df: DataFrame, path: str) -> None:
    """Rows with a `split` column, a folder for each side."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(path)
    return tuple(df.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def limit_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by order; all without n."""
    return df.orderBy(*order).limit(n) if n is not None else df
