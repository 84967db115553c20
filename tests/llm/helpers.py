"""Rows that every operator must bear."""

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, one very long text."""
    base = sentence(1, 60)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " more", None, None, None), (4, None, "en", "a", 0), (5, "", "de", "b", 0), (6, "  \n\t ", "de", "b", 0),
        (None, base + " more", "en", "a", 1), (None, sentence(2, 30), None, None, None), (7, "one", "en", "a", 3), (8, "one", "en", "a", 3), (9, "One two three four", "en", "a", 1),
        (10, "x" * 120_000, "en", "c", 1), (11, sentence(3, 20_000), "en", "c", 1), (12, "É ß 中文 🙂 " + chr(0x3000) + "ok", "fr", "b", 9), (12, sentence(4, 40), "fr", "b", 9), (13, sentence(4, 39) + " end", "fr", "b", 9),
    ]


def awkward(spark: SparkSession):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)
