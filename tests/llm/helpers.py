"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéo") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, extra=()):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(20, 200)).replace(" e", "\n"), rng.choice(["en", "fr"]), rng.choice(["a", "b"]), 1) for i in range(60)]
    rows += [(60, None, "en", "a", None), (61, "", None, None, 0), (62, " \n\t ", "en", "a", 3), (63, "one two", "en", "b", 7), (64, words(rng, 6000), "fr", "b", 1)]
    rows += [(65, rows[0][1], "en", "a", 1), (66, rows[0][1] + " tail", "en", "a", 1), rows[3], (None, "no id here", "en", "a", 1)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
