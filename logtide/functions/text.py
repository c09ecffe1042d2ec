"""Text helpers of the store: tokens, printable checks, previews, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNPRINTABLE = r"[^\x20-\x7e\n\r\t]"


def tokens(text: Column, delimiters: str) -> Column:
    """Pieces between delimiter characters; empty pieces are dropped."""
    pattern = "[" + "".join("\\" + c for c in delimiters) + "]+"
    return F.filter(F.split(text, pattern), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    return tokens(path, "/\\")


def printable_share(text: Column) -> Column:
    """Share of characters from blank to tilde, line feed, return and tab; null for an empty text."""
    return F.length(F.regexp_replace(text, _UNPRINTABLE, "")) / F.nullif(F.length(text), F.lit(0))


def is_printable(text: Column) -> Column:
    """More than four fifths printable; an empty text is not."""
    return F.coalesce(printable_share(text) > 0.8, F.lit(False))


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def is_printable_bytes(data: bytes) -> bool:
    """More than four fifths of the bytes printable; no bytes are not."""
    return bool(data) and len(data) - len(data.translate(None, _PRINTABLE)) > 0.8 * len(data)


def is_hex(text: Column) -> Column:
    """Pairs of hexadecimal digits only; the empty text qualifies."""
    return text.rlike("^([0-9a-fA-F]{2})*$")


def preview(text: Column, length: int = 40) -> Column:
    """The first ``length`` characters, with dots behind if any are cut off."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def object_path(key: Column, prefix: str) -> Column:
    """Where an object store keeps a key."""
    return F.concat_ws("/", F.lit(prefix), key)


def trie(words: DataFrame, column: str) -> DataFrame:
    """A row for each node of the trie over distinct words: prefix, depth, words below or at it, and whether it is a word."""
    word = F.col(column)
    nodes = words.where(word.isNotNull() & (word != "")).select(word.alias("word")).distinct()
    nodes = nodes.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth"))
    nodes = nodes.select("word", "depth", F.expr("substring(word, 1, depth)").alias("prefix"))
    return nodes.groupBy("prefix").agg(
        F.max("depth").cast("long").alias("depth"), F.count("*").alias("n_words"), F.max(F.col("prefix") == F.col("word")).alias("is_word")
    )


def trie_values(pairs: DataFrame, column: str, value: str, order: str) -> DataFrame:
    """A row for each node of the trie over the words of ``column``: prefix, depth, is_word, and the word's value, the last by ``order``; null on the way."""
    word = F.col(column)
    last = pairs.where(word.isNotNull() & (word != "")).groupBy(word.alias("word")).agg(F.max_by(F.struct(F.col(value).alias("value")), order).alias("set"))
    nodes = last.select("word", "set", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("depth"))
    nodes = nodes.select("depth", F.expr("substring(word, 1, depth)").alias("prefix"), F.when(F.length("word") == F.col("depth"), F.col("set")).alias("set"))
    found = nodes.groupBy("prefix").agg(F.max("depth").cast("long").alias("depth"), F.max(F.col("set").isNotNull()).alias("is_word"), F.first("set", ignorenulls=True).alias("set"))
    return found.select("prefix", "depth", "is_word", "set.value")


def trie_search(trie: DataFrame, probes: DataFrame, column: str) -> DataFrame:
    """Each distinct probe with whether it is a word of a trie."""
    words = trie.where("is_word").select(F.col("prefix").alias("_word"))
    asked = probes.select(column).distinct()
    return asked.join(words, F.col(column) == F.col("_word"), "left").select(column, F.col("_word").isNotNull().alias("found"))
