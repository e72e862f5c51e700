"""Small awkward tables that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG_TEXT = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 3000

ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),
    (2, "one  two three four\tfive six seven eight nine ten", "en", "a", 11),
    (3, "", "en", "a", 0),
    (4, None, None, None, None),
    (5, " \n\t ", "fr", None, 4),
    (6, LONG_TEXT, "en", "b", None),
    (7, LONG_TEXT, "en", "b", None),
    (8, "x" * 5000, "de", "b", 5000),
    (9, "Größe ñandú 漢字 \U0001f600 naïve", "de", "c", 1),
    (None, "no id here", "en", "c", 1),
    (10, "repeated row", "en", "c", 1),
    (10, "repeated row", "en", "c", 1),
    (11, "repeated row", "en", "c", 1),
]


def table(spark, rows=ROWS, extra=True):
    """The rows as documents; with ``extra``, with more columns whose names clash with results."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        clash = ("size", "kept", "keep_id", "score", "taken", "owner", "digest", "key", "n_words", "component_id", "target", "ids", "_salt", "_text")
        df = df.selectExpr("*", *[f"'clash' AS {c}" for c in clash])
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
