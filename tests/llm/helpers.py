"""Small tables that every operator has to take, and brute-force rules."""

import re

LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [None, "", "\n", " \t ", "a", "A a\nA a", "é ê 中文 😀", "\x00\x1f", LONG, "x" * 50_000, "word\r\nword", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]


def documents(spark, texts, **more):
    """doc_id from 0, text, lang, source and columns whose names clash with operators' own."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", i, "mine", -1, False) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_words int, kept boolean")


def odd_documents(spark):
    """Odd texts, a row that is there twice, and a null doc_id."""
    docs = documents(spark, ODD)
    null = docs.where("doc_id = 4").selectExpr("cast(null as long) as doc_id", *docs.columns[1:])
    return docs.unionByName(docs.where("doc_id = 5")).unionByName(null)


N_ODD = len(ODD) + 2


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
