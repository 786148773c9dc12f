"""Small awkward tables shared by the operator tests."""

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, _text string, _g int, count int"


def docs(spark, rows):
    """Documents from (doc_id, text[, lang, source]) with extra, clashing columns."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src0")), None if r[1] is None else len(r[1]), "x", "y", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


def awkward():
    """Nulls, empties, ties, repeated rows and one very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"),
            (6, "word " * 40_000), (7, "ÀÉ ſ K ß 日本語 😀 " * 7), (8, "a\x00b\x0bc\x85d e", None, None),
            (9, None, None, "src1")]
