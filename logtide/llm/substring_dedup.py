"""Passages repeated anywhere, by level-wise doubling of word windows.

A window of ``min_words`` words is repeated when its words also start anywhere else. Levels look at windows of
rising length, each at most twice as long as the last, up to ``min_words``: 18 and 35 words by default. A level
needs only the sampled windows: of those that one full window covers, that with the smallest hash. All places of a
repeated window sample the same one, so a full window whose sample occurs once can't be repeated. Full windows that survive a level
go on to the next, and the loop ends when none survives or when the level is the full window itself. What is left is repeated.

With ``longest`` the levels go on, doubling ``min_words``, until no candidate survives; a window of a further level is a candidate where the
full windows at its start and end were repeated one level before. The result then tells, for each document, the longest level at which a window of it is repeated.

A level is one aggregation by hash. Its result is the windows that occur once, which carry
their own place, so nothing is joined back by hash and a passage that all documents share
costs one row a task. Places are grouped by row, whose own length bounds them.

Windows have 64-bit hashes; a window is removed by mistake only if all levels collide. Rows are told apart by a 64-bit
hash of id and text; a second hash finds two rows under one number, and another pair of hashes is taken then.

Nulls and odd rows: a null or empty text has no words; texts shorter than a window lose
nothing; repeated rows are repeats of each other and both lose their windows; a null doc_id
is kept; a window that overlaps its own repeat is a repeat; texts of any length are read whole and memory follows the longest;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import words as W
from logtide.llm.scratch import Scratch

_U = np.uint64
_PLACES = "key long, place int, hash long"


def levels(min_words: int, shortest: int = 18) -> list[int]:
    """Rising window lengths that end with ``min_words``, each at most twice the one before."""
    found = [min_words]
    while found[0] > shortest:
        found.insert(0, -(-found[0] // 2))
    return found


def candidates(words: W.Words, min_words: int, struck: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of full windows that no level has struck out; ``struck`` holds by length the starts (indexes over all words) of windows that occur once."""
    alive = W.fits(words, min_words)
    for length, at in struck.items():
        if length > min_words:
            continue
        hashes = W.windows(words.hashes, length)
        width = min_words - length + 1
        left = hashes.copy()
        left[at] = np.iinfo(_U).max
        alive = alive & (W.sliding(left, width, np.minimum) == W.sliding(hashes, width, np.minimum))
    return alive


def sampled(words: W.Words, min_words: int, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``length`` words, and which starts a full window that is ``alive`` samples."""
    hashes = W.windows(words.hashes, length)
    width = min_words - length + 1
    lowest = W.sliding(hashes, width, np.minimum)
    if not len(lowest):
        return hashes, np.zeros(len(hashes), bool)
    lowest = np.where(alive, lowest, _U(0))
    pad = np.zeros(width - 1, _U)
    return hashes, W.sliding(np.concatenate([pad, lowest, pad]), width, np.maximum) == hashes


def extended(words: W.Words, min_words: int, length: int, struck: dict[int, np.ndarray]) -> np.ndarray:
    """Starts of windows of ``length`` words, longer than ``min_words``, whose two ends were repeated at every level before."""
    alive, before = candidates(words, min_words, struck), min_words
    while before < length:
        after = 2 * before
        gap = after - before
        alive = (alive[: len(alive) - gap] & alive[gap:] if len(alive) > gap else alive[:0]) & W.fits(words, after)
        if after in struck:
            alive[struck[after]] = False
        before = after
    return alive


def _local(words: W.Words, at: np.ndarray) -> np.ndarray:
    """Indexes over all words as places within their texts."""
    text = np.searchsorted(words.first, at, "right") - 1
    return at - words.first[text], text


def _rows(keys: pa.Array, words: W.Words, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    place, text = _local(words, at)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(text)), pa.array(place, pa.int32()), W.signed(hashes[at])], ["key", "place", "hash"])


def _struck(places: pa.Array, lo: int, hi: int, words: W.Words) -> dict[int, np.ndarray]:
    """A column of lists of (length, places) as starts over all words by length."""
    lists = places.slice(lo, hi - lo)
    rows = np.repeat(np.arange(hi - lo), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    entries = lists.flatten()
    lengths = entries.field("length").to_numpy(zero_copy_only=False)
    starts = entries.field("places")
    found = {}
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        chosen = starts.take(pa.array(own)).cast(pa.large_list(pa.int32()))
        count = chosen.value_lengths().to_numpy(zero_copy_only=False)
        found[length] = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[rows[own]], count)
    return found


def _level_windows(min_words: int, length: int):
    """(key, text, struck) to the windows that the level looks at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                words = W.split(offsets, raw)
                struck = _struck(batch.column(2), lo, hi, words) if batch.num_columns > 2 else {}
                if length <= min_words:
                    hashes, chosen = sampled(words, min_words, length, candidates(words, min_words, struck))
                else:
                    hashes, chosen = W.windows(words.hashes, length), extended(words, min_words, length, struck)
                yield _rows(batch.column(0).slice(lo, hi - lo), words, np.flatnonzero(chosen), hashes)

    return run


def _once(scratch: Scratch, places: DataFrame, length: int) -> tuple[DataFrame, bool]:
    """(key, length, places) of windows whose hash occurs once, and whether any occurs more often; those meet under a null key."""
    grouped = places.groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("place").alias("place"))
    alone = grouped.select(*(F.when(F.col("n") == 1, F.col(c)).alias(c) for c in ("key", "place")))
    found = scratch.keep(alone.groupBy("key").agg(F.lit(length).alias("length"), F.collect_list("place").alias("places")), f"once{length}")
    return found.where("key is not null"), not found.where("key is null").isEmpty()


def _kept(min_words: int, levels_done: list[int], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                words = W.split(offsets, raw)
                struck = _struck(batch.column(2), lo, hi, words)
                if min_words in levels_done:
                    gone = candidates(words, min_words, struck)
                else:  # no window survived a shorter level
                    gone = np.zeros(len(W.fits(words, min_words)), bool)
                longest = np.zeros(hi - lo, np.int64)
                for length in (x for x in levels_done if x >= min_words):
                    at = np.flatnonzero(gone if length == min_words else extended(words, min_words, length, struck))
                    longest[np.searchsorted(words.first, at, "right") - 1] = length
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                at = np.flatnonzero(gone)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + min_words, -1)
                covered = np.cumsum(cover[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
                whole, out = raw.tobytes(), []
                for i, lost in enumerate(removed.tolist()):
                    if lost:
                        own = np.arange(words.first[i], words.first[i + 1])[~covered[words.first[i] : words.first[i + 1]]]
                        body = b" ".join([whole[a:b] for a, b in zip(words.starts[own].tolist(), words.ends[own].tolist(), strict=True)])
                    else:
                        body = b" ".join(whole[offsets[i] : offsets[i + 1]].split())
                    out.append(hashlib.sha256(body).hexdigest() if digest else body)
                text = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), text, pa.array(longest)],
                    ["doc_id", "n_words", "n_removed", "kept", "longest"],
                )

    return run


def _identified(rows: DataFrame) -> DataFrame:
    """With ``key``, a number that tells rows of different id or text apart, which is checked by a second hash."""
    for seed in range(20):
        hashes = [F.xxhash64(F.lit(2 * seed + i), "doc_id", "text") for i in (0, 1)]
        both = rows.select(hashes[0].alias("key"), hashes[1].alias("other")).groupBy("key").agg((F.min("other") != F.max("other")).alias("clash"))
        if both.where("clash").isEmpty():
            return rows.withColumn("key", hashes[0])
    raise RuntimeError("two rows under one number with every seed")


def without_repeats(docs: DataFrame, *, min_words: int = 35, shortest: int = 18, digest: bool = False, longest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay with single spaces, or the SHA-256 of that in hex).

    With ``longest`` also the longest level, ``min_words`` times a power of two, at which a window of the document is repeated; 0 if none is.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    keyed = _identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    todo, done, struck = levels(min_words, shortest), [], None
    while todo:
        length = todo.pop(0)
        rows = keyed.select("key", "text")
        if struck is not None:
            rows = rows.join(struck, "key", "left").select("key", "text", "struck")
        alone, survive = _once(scratch, rows.mapInArrow(_level_windows(min_words, length), _PLACES), length)
        done.append(length)
        found = alone if len(done) == 1 else found.unionByName(alone)
        struck = found.groupBy("key").agg(F.collect_list(F.struct("length", "places")).alias("struck"))
        if not survive:
            break
        if longest and not todo:
            todo.append(2 * length)
    both = keyed.join(struck, "key", "left").select("doc_id", "text", "struck")
    kept = both.mapInArrow(_kept(min_words, done, digest), "doc_id long, n_words long, n_removed long, kept string, longest long")
    return kept if longest else kept.drop("longest")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS e
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY e) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, 35)) AS j FROM repeated)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS body
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, (len(s.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
