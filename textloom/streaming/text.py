"""Text functions on streams. All Columns of functions/ work on streaming DataFrames; these are the usual shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexer
from ..functions.normalize import clean_text


def token_stream(rows: DataFrame, text_col: str, settings: dict, out: str = "tokens") -> DataFrame:
    """rows with `out`, the tokens of the cleaned text."""
    return rows.withColumn(out, lexer.tokens(clean_text(text_col, settings), settings["features"]))


def term_counts(tokens: DataFrame, time_col: str, column: str = "tokens", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, term, n: counts per time window; rows later than `late` are left out."""
    terms = tokens.withWatermark(time_col, late).select(time_col, F.explode(column).alias("term"))
    return terms.groupBy(F.window(time_col, window).alias("window"), "term").agg(F.count("*").alias("n"))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What is there now, appended to path; started again, only what is new."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
