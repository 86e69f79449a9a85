import re

import pandas as pd

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, s string, rule string, h int, size int, spans string, cut long"


def docs_frame(spark, rows):
    """Documents with extra columns whose names the operators use inside; rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", "r", 2, 3, "z", 4) for i, t, s in rows], DOC_SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    near = [f"t{i}" for i in range(200)]
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "one", "b"), (6, "ONE two", None), (7, long, "a"), (8, long + " end", "c"),
        (9, " ".join(near), "a"), (10, " ".join([*near[:-1], "other"]), "b"), (10, " ".join([*near[:-1], "other"]), "b"), (11, " ".join(near[:100]), "b"), (12, "a b c d e", "c"), (13, "A b C d e", "c"), (None, "no key", "a"),
    ]


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
