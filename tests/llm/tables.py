"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list[str | None], extra: bool = False) -> DataFrame:
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    if extra:
        for name in ("piece", "length", "n_words", "kept", "spans", "class_id", "item_id", "chunk", "conv_id", "rank"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
