"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("size", T.LongType())])

ODD = [
    (1, "one two three four", "en", "a"), (2, "one  two\tthree\nfour", "en", "a"), (3, None, None, None), (4, "", "de", "b"),
    (5, " ", "de", "b"), (None, "one two three four", "en", "a"), (7, "word " * 5000, "en", "c"), (7, "word " * 5000, "en", "c"),
    (8, "x" * 20000, "fr", "c"), (9, "Éa ñ 😀   z", "fr", None), (10, "one two three five", "en", "b"),
]


def odd_docs(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "clash", 0.25, 3) for r in rows], DOCS)


def write_tables(spark, path, docs, **others):
    docs.write.parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
