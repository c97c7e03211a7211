"""Small tables with the cases that every operator must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, chunk string, p double"

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def odd_docs(spark):
    """Null ids, texts and sources, blank and long texts, repeated rows, clashing extra columns."""
    texts = [(0, "one two three four five six"), (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "a"), (5, LONG),
             (6, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"),
             (None, None), (7, "Ünïcödé 北京 😀 x y"), (8, LONG + " end")]
    rows = [(i, t, "en", None if n % 3 == 0 else "s" if n % 3 == 1 else "", None if t is None else len(t), n, "c", 0.5)
            for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()
