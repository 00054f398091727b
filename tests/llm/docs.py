"""Small tables with the awkward rows that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, s int, row string, key string"


def awkward(spark, texts=()):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names clash with working ones."""
    rng = random.Random(5)
    vocabulary = ["al", "bo", "ceta", "dun", "elf", "fi", "gor", "hum", "il", "jot"]
    long = "\n".join(" ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(12)) for _ in range(400))
    rows = [(i, t, "en", f"src{i % 2}", len(t), i, "r", "k") for i, t in enumerate(texts)]
    rows += [(9100, None, "en", "src0", None, 1, "r", None), (9101, "", None, None, 0, None, None, "k"), (9102, " \t\n ", "fr", "src1", 4, 2, "r", "k")]
    rows += [(9103, long, "en", "src0", len(long), 3, "x", "y"), (9104, long, "en", "src1", len(long), 3, "x", "y"), (None, "one two three", "de", "src1", 13, 4, "r", "k")]
    rows += [(9105, "naïve café ▁x  \U0001f600 done", "fr", None, 20, 5, "r", "k")] * 2
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
