"""Small frames with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

#: Extra columns named like the operators' own.
CLASH = ["key", "size", "kept", "component_id", "keep_id", "path", "rep", "word", "family", "piece", "item", "h", "part"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 4, 5, 6, 30, 60, 200, 200)]
    long_text = words(rng, 9000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, long_text), (24, long_text.upper()), (25, base[4].upper()), (26, base[4]),
             (27, base[6] + " tail"), (28, "x " + base[6]), (29, base[7].replace(" ", "\n")), (30, "É É é"), (31, "é É é"),
             (32, "\x1ca\xa0b \x85"), (33, "The idiot and the moron are scum, idiot."), (34, base[0]), (34, base[0]), (None, base[1])]
    return [(i, t, "en", None if n % 9 == 4 else f"s{n % 4}", len(t or ""), *["z"] * len(CLASH)) for n, (i, t) in enumerate(rows)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
