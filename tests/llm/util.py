"""Small tables for the operators' tests."""

from __future__ import annotations

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns carry nulls and clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, DOC)
    for c in ("h", "k", "fp", "key", "n", "ids", "length", "body", "hits", "score", "_g", "_gone", "_gone_id", "_other", "_again", "_leaked", "_blank", "gone", "left", "row", "first", "place", "of"):
        df = df.withColumn(c, df["source"])
    return df


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
