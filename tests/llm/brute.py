"""Plain single-machine versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(ids, pairs):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


#: Columns whose names the operators might use inside.
CLASH = ("rank", "weight", "size", "words", "spans", "bits", "cell", "copies", "score", "fingerprint", "component_id", "__stocktide_words")


def edge_documents(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    plain = "The quick brown fox reads twenty plain words in one long line so that no rule rejects it by its length alone today."
    rows = [(1, plain, "en", "a", 115), (1, plain, "en", "a", 115), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "fr", "b", 4),
            (None, plain, "en", None, 115), (5, "many words and more " * 50_000, "en", "b", 1_000_000), (6, "x" * 300_000, "en", "b", 300_000),
            (7, "One two.", "en", "c", 8), (8, "one TWO.", "en", "c", 8), (9, "é 𝄞 日本語 mail a@b.org or +1 234 555 0000", "ja", "c", 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in CLASH})


def edge_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 0), (7, None, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
