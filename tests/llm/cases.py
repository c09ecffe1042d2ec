"""Small tables with what operators must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

_WORDS = ["alpha", "beta", "Gamma", "delta", "été", "straße", "ñandú", "x", "word,", "END.", "42", "日本"]


def texts(seed: int = 7) -> list[str | None]:
    """Random texts with copies, near copies, shared lines and passages, and odd ones."""
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(_WORDS) + str(rng.randrange(400)) for _ in range(n))
    line, passage, base = "Copyright (c) all rights reserved here", make(50), make(120)
    out: list[str | None] = [make(rng.randrange(1, 90)) for _ in range(25)]
    out += [base, base, base.upper(), base.replace("alpha", "beta", 1)]
    for _ in range(5):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [f"{make(20)}\n{line}\n{make(9)}", f"  {line.upper()}\t\n{make(12)}", f"{line}\n{line}\n{make(5)}", f"{make(8)}\n {line}"]
    out += [f"{make(10)} {passage} {make(30)}", f"{passage} {make(3)}", make(5) + "  " + passage.replace(" ", "\n", 3)]
    out += [None, None, "", "", " \t\r\n\x0b\x0c ", "one", "one two three", "ONE two three", "a" * 30_000, "b " * 20_000, "\n" * 50, "z\x00\x1c\x85y", "é" * 25, "𝒳👍 👍"]
    return out


def documents(spark, seed: int = 7, shuffle: bool = True):
    """The texts with distinct ids; sources include null and a hot one."""
    rng = random.Random(seed)
    rows = [(i * 3 - 5, t, rng.choice(["en", None]), None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 5}"), None if t is None else len(t)) for i, t in enumerate(texts(seed))]
    if shuffle:
        rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_documents(spark):
    """Null ids, repeated rows and ids."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, "other text"), (None, text), (None, None), (None, "a line that is long enough"), (2, "a line that is long enough"), (3, "a line that is long enough"), (4, ""), (4, None)]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """The same table with columns named as operators name their own."""
    from pyspark.sql import functions as F

    for name in ("key", "digest", "row", "size", "place", "src", "class", "keys", "kept", "cls", "words", "label", "copies", "x", "y", "target", "n.dotted"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs
