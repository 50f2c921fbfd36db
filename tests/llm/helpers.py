from __future__ import annotations

SMALL = "/root/testdata/sf0.001"

ODD_TEXTS = [None, "", " ", "\n\n", "a", "a b c d", "word " * 5_000, "é" * 3_000, "x@y.z " * 50, "0" * 5_000, "= : =\n:", "\x00\x01", "password=" + "a1" * 4_000, "🙂 ́ 　 z"]


def odd_documents(spark, texts=ODD_TEXTS):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    rows = [(i, t, None if i % 3 == 0 else "src", i, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "some text of a row without an id and more words here now", None, None, 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, host string")


def extra(df):
    """Columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    return df.withColumns({"slot": F.lit(1), "row": F.lit("r"), "key": F.lit(2), "comp": F.lit(3), "_host": F.lit("h"), "ids": F.lit(None).cast("binary")})


def tuples(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)
