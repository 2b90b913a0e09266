"""Rows with every awkward case, and shared checks."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, fp string, rn long, bucket long, row string, shard string, h long, lang_pred string, rejected boolean, _spans string"


def awkward(spark, more=()):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows, ties, and columns with clashing names."""
    random.seed(4)
    word = lambda: "".join(random.choice("aeioubcdrst") for _ in range(random.randint(1, 9)))
    prose = " ".join(word() for _ in range(300))
    texts = [None, "", " \n\t ", "a", "one two", prose, prose, prose[:900] + " changed " + prose[900:], "x" * 40_000, "é" * 500, "Is it. " * 300, " ".join(word() for _ in range(20_000)), "1234 5678", "İß ﬁ 日本語 👩‍👧 é"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose, None, None, 1), (None, None, None, None, None), (3, "other text of a repeated id", "de", "s1", 2)]
    rows += list(more)
    clash = ("c", "c", 1, 2, "c", "c", 3, "c", True, "c")
    return spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
