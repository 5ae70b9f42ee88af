"""Small tables with every odd case: nulls in any column, empty and long texts, repeated rows, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", shard int, kept boolean, _row string, score string, n_words string, ids string, fp string, copy string"


def prose(n: int, seed: int = 1) -> str:
    """Words that don't repeat windows."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


def odd_rows() -> list[tuple]:
    long_text = "\n".join(prose(100, s) for s in range(60))
    rows = [
        (1, prose(80, 1), "en", "a", 10),
        (2, prose(80, 2), "en", None, 20),
        (3, None, None, "a", None),
        (4, "", "de", "b", 0),
        (None, prose(70, 3), "en", "a", 5),
        (5, long_text, "fr", "b", len(long_text)),
        (6, " \n\t\n ", "fr", "b", -4),
        (7, prose(80, 1), "en", "a", 10),
        (7, prose(80, 1), "en", "a", 10),
        (8, "é ß 日本 <|endoftext|> x", "en", "c", 7),
        (None, None, None, None, None),
    ]
    return rows


def odd_docs(spark, extra: bool = False):
    rows = odd_rows()
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, 1, True, "r", "s", "n", "i", "f", "c") for r in rows], EXTRA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
