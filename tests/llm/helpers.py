"""Small tables for the tests of the training-data operators."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """With extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["h", "s", "t", "n", "rows", "rank", "place", "tokens", "bucket", "piece", "ids", "kept", "group_size", "score", "copies", "key", "size", "label"]
    return df.select("*", *[F.lit("x").alias(c) for c in names if c not in df.columns])


#: Texts that an operator must survive.
ODD = [None, "", " ", "\n\n", "\t", "one", "a\x00b", "é́   x", "日本語 テスト", "😀 " * 30, "x" * 5000, "word " * 3000]
