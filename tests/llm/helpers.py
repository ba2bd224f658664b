"""Small document tables with awkward rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators also use for their results
    T.StructField("score", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("_id", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("n", T.IntegerType()),
])


def frame(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", 1, "y", "z", 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(seed, n, size=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return [rng.choice(vocabulary) for _ in range(n)]


def prose(seed, n):
    """n words in sentences of 4 to 12."""
    rng = random.Random(seed)
    out, sentence = [], []
    for w in words(seed, n, 4000):
        sentence.append(w)
        if len(sentence) >= rng.randint(4, 12):
            out.append(" ".join(sentence).capitalize() + ".")
            sentence = []
    if sentence:
        out.append(" ".join(sentence).capitalize() + ".")
    return " ".join(out)


AWKWARD = [
    (1, "The cat sat on the mat. It was a good mat."), (2, "THE CAT sat on the mat. It was a good mat."),
    (3, None), (4, ""), (5, "   \n\t "), (None, "No id here at all."), (None, None), (7, "É é ÉÉ"), (8, "é é éé"),
    (9, "Same id twice."), (9, "Same id twice."), (9, "Same id, other text."), (10, "word " * 30_000),
    (11, "x" * 50_000), (12, "日本語 한국어 Привет"), (13, "\x00 null char"), (14, "<|endoftext|> special"),
]
