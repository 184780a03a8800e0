"""Small tables that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end."


def alike(steps):
    """Two words of 2**steps letters that sums of powers of an odd number, modulo a power of two, can't tell apart."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def documents(spark, rows=None):
    if rows is None:
        rows = [
            (1, "One two three four five six.", "en", "a", 28),
            (2, "One two  three four\nfive six.", "en", "b", 29),
            (2, "One two  three four\nfive six.", "en", "b", 29),
            (3, None, None, None, None),
            (4, "", "en", "a", 0),
            (5, " \n\t", None, "a", 3),
            (6, LONG, "fr", "b", len(LONG)),
            (7, LONG, "fr", None, len(LONG)),
            (None, "Nobody's text, with \U0001f600 and ß and |<>.", "de", "b", 40),
            (None, None, None, None, None),
            (8, "{{ javascript }} <|endoftext|> </turn> \\ \x00", "de", "", 10),
        ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark, [])


def clashing(spark):
    """documents with more columns, named as operators might name theirs."""
    from pyspark.sql import functions as F

    return documents(spark).withColumns({c: F.lit(1) for c in ("row", "id", "h", "name", "size", "copies", "doc", "kept", "norm", "rate", "pos", "key", "src", "ids")})
