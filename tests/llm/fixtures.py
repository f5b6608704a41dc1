"""Rows that the operators of llm must bear: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Ids that a double can't hold, beside rows without an id.
LARGE_IDS = [(2**53 + 1, "one text"), (None, "another"), (2**53 + 3, "a third text"), (None, None)]


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    base, other = words(120, 1), words(90, 2)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), other, None, "", "one", "one two three", base[:200] + words(40, 3), words(8000, 4), "Ünï çødé 😀 " * 30, "   \t\n", base.upper(), "x" * 3000, other + " tail words here"]
    out = [(i, t, ["en", "de", None][i % 3], [f"src{i % 2}", None, "src0"][i % 3], len(t) if t else None) for i, t in enumerate(texts)]
    out.append(out[3])  # a repeated row
    out.append((None, base, None, None, None))
    return out


def docs(spark, extra: bool = False):
    df = spark.createDataFrame(rows(), DOCS)
    if extra:
        for c in ("id", "h", "sid", "node", "first", "m", "u", "x0", "block", "position", "start", "end", "spans", "part", "rank", "list", "digest", "stored", "caption", "length", "score", "__rank2"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
    return df


def none(spark):
    return spark.createDataFrame([], DOCS)
