"""Inputs that the tests of this folder share."""


def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


LONG = "the quick brown fox jumps over a lazy dog while many others look on. " * 4000


def edge_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rows = [
        (1, None, "en", "a", 0, 1.0, "x", 1, "k"),
        (2, "", None, "a", 0, None, "x", 2, None),
        (3, LONG, "en", None, None, 1.0, None, None, "k"),
        (None, "a text without an id that says little of use", "en", "b", 5, 1.0, "x", 3, "k"),
        (4, "twice the same row", "en", "b", 5, 1.0, "x", 3, "k"),
        (4, "twice the same row", "en", "b", 5, 1.0, "x", 3, "k"),
        (4, "the same id with another text é 日本語", "en", "b", 5, 1.0, "x", 3, "k"),
        (5, " \t\n\v\f\r ", "en", "b", 5, 1.0, "x", 3, "k"),
        (6, "!!! ... ???", "en", "b", 5, 1.0, "x", 3, "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, fp long, row string")
