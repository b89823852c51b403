"""Rows with every awkward case: nulls, empty and long texts, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int, row string"


def documents(spark, rows, parts=3):
    """Documents from ``(doc_id, text, source)``, with extra columns whose names the operators use themselves."""
    full = [(d, t, None, s, None if t is None else len(t), 7, 3, "x") for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
