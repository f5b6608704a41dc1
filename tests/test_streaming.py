from datetime import datetime

from pyspark.sql import functions as F

from textloom.config import preset
from textloom.functions import lexer, normalize
from textloom.streaming import text as S


def test_a_stream_has_the_batch_tokens(spark, tmp_path):
    schema = "id long, at timestamp, t string"
    rows = [(i, datetime(2024, 1, 1, i % 24), f"It is {i % 11} out of 10!!!!! see http://a.com/x") for i in range(60)]
    batch = spark.createDataFrame(rows, schema)
    batch.where("id < 30").write.parquet(f"{tmp_path}/in")
    settings = preset("reviews")["tokenizer"]

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        S.write_parquet(S.token_stream(stream, "t", settings), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    run()
    batch.where("id >= 30").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    want = batch.select("id", lexer.tokens(normalize.clean_text("t", settings), "reviews").alias("tokens"))
    got = spark.read.parquet(f"{tmp_path}/out").select("id", "tokens")
    assert sorted(got.collect()) == sorted(want.collect())
    counts = S.term_counts(S.token_stream(batch, "t", settings), "at")
    assert counts.where("term = 'out'").count() == 0 and counts.agg(F.sum("n")).first()[0] == sum(len(r["tokens"]) for r in want.collect())
