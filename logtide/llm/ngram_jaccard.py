"""Similarity join of word-shingle sets by parity sketches.

A document's set holds the hashes of its distinct shingles. Sets that reach the similarity
num/den have sizes a <= b with den * a >= num * b, and differ in at most
(den - num) / (den + num) * (a + b) elements.

Sketch. On a size band, every element flips one bit of one of P 64-bit words, P one more
than the largest difference that a linked pair of this band can have. Common elements cancel,
so the Hamming distance of two sketches is at most the symmetric difference. A document has
sketches on its own band, for partners of its band or the one below, and on the band above.

Keys. By the ring form of the pigeonhole principle (P boxes in a circle that hold fewer than P
errors) a linked pair has a place from which on any n words in a row hold fewer than n errors: the
first word is equal, and of the n - 1 words after it, cut into halves, at least n - 1 halves are. A word with few
set bits says little: one in twenty to several hundred is empty. So a key takes in equal halves until its
content is rare enough among unrelated sets. The first word alone is a key if it is; else it is joined with either
half of the next word; a key that is still too common is joined with any of the three halves then
unused among the next two words, and so on, up to four halves. Both documents of a pair have equal bits in what they share, so they take
the same steps. The rarity asked for grows with the number of documents, so that
about as many unrelated documents meet under a key at any size, for a few more keys.

Candidates. Equal keys meet in hash joins; nothing else is a candidate, and the n words after the first, for n
up to four, must differ in at most n bits. The member of a bucket with the most shared keys is its pivot and is paired
with the others. Verified links are contracted to components; pivots, which met every other
member, leave, and so do buckets that lie within one component. The pairs of a bucket that
are left between different components, by the same test, come from one more join. No
linked pair in different components is ever left out, so components are exact, while
copies of one text cost a pair each. What a bucket holds is told by partial aggregates and
joined back, so a bucket of any size is spread over tasks.

Verification. Pairs are struck out by the Hamming distance of short sketches first; the rest
have their whole shingle sets intersected.

Documents with equal sets form a class, and only classes are compared. Class numbers are 64-bit hashes
of sets; a second hash detects two sets under one number, and the join then starts again
with other hashes.

Nulls and odd rows: a null or empty text, or one without words, has an empty set, links with
nothing and is its own component; a null doc_id takes part, and a component_id is the
smallest doc_id that isn't null; repeated rows are members of one class; an empty table gives
an empty result; a text of any length is one set, and memory follows the longest text; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import words as W
from logtide.llm.components import components
from logtide.llm.joins import counted, keep_listed
from logtide.llm.scratch import Scratch

_U = np.uint64
_BITS = 64
#: Words of the short sketch of a set of up to so many elements; it doubles with the size.
_SHORT_WORDS, _SHORT_SIZE = 16, 400
_LOW = 0xFFFF
#: Words after the first that a candidate's are compared with, 16 bits of each.
_FOLLOWING = 4
#: Most halves that a key takes in, words of sketches turned into keys at a time, and classes that a task remembers.
_MOST_HALVES, _RUN_WORDS, _SEEN = 4, 1 << 16, 200_000
#: Rounds in which keys are matched, each with its share of the keys; more rounds need less disk at once and work keys out more often.
ROUNDS = 3


def band_limits(num: int, den: int, largest: int = 1 << 40) -> list[int]:
    """Smallest size of each band; sizes two bands apart can't reach the similarity."""
    limits = [1]
    while limits[-1] < largest:
        limits.append(max(limits[-1] + 1, den * (limits[-1] - 1) // num + 1))
    return limits


def band_parts(num: int, den: int, limits: list[int]) -> list[int]:
    """Words of a sketch on each band: one more than the largest difference of a linked pair whose larger set is in it."""
    return [1 + (den - num) * 2 * (above - 1) // (den + num) for above in limits[1:]]


def shingle_sets(words: W.Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and where each text's begin.

    A text with fewer words than a shingle has its whole sequence as its only element.
    """
    counts, n_texts = words.counts, len(words.counts)
    full = W.windows(words.hashes, size)
    inside = W.fits(words, size)
    text = words.text_of()
    parts, owners = [full[inside]], [text[: len(full)][inside]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = words.first[short][:, None] + np.arange(n)
            value = np.zeros(len(short), _U)
            for column in at.T:
                value = W.mix(value * _U(0x9E3779B97F4A7C15) + words.hashes[column] + _U(n))
            parts.append(value)
            owners.append(short)
    values = W.mix(np.concatenate(parts) + _U(seed * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    owner = np.concatenate(owners)
    order = np.argsort(values)
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n_texts + 1))


def set_number(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each text's set: mixed elements added up, with the size."""
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(W.mix(values + _U(k)), out=sums[1:])
    return W.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U))


def sketches(values: np.ndarray, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity words of each text with ``parts`` words for it, and where each text's begin."""
    begin = np.concatenate([[0], np.cumsum(parts)])
    count = np.diff(first)
    part = ((values >> _U(32)) * np.repeat(parts, count).astype(_U)) >> _U(32)
    word = np.repeat(begin[:-1], count) + part.astype(np.int64)
    out = np.zeros(int(begin[-1]), _U)
    np.bitwise_xor.at(out, word, _U(1) << (values & _U(_BITS - 1)))
    return out.view("<i8"), begin


def bits_needed(documents: int, num: int, den: int) -> np.ndarray:
    """Set bits that a key needs, by band and by how many halves it has taken in.

    A key's information, from how likely words of unrelated sets have its content, is to reach about the logarithm
    of the number of documents on a band, so few of them meet by chance however many there are. Numbers aren't whole: places
    round them differently, so that keys grow evenly with the documents.
    """
    limits = np.array(band_limits(num, den))
    per_word = limits[:-1] / np.array(band_parts(num, den, limits.tolist()))  # elements a word, the same for both documents of a pair
    of_set, of_clear = np.log2(_BITS / per_word), per_word / _BITS * np.log2(np.e)
    width = _BITS + _BITS // 2 * np.arange(_MOST_HALVES + 1)
    wanted = max(math.log2(max(documents, 2)) - 1, 6)
    return (wanted - np.outer(of_clear, width)) / (of_set - of_clear)[:, None]


def key_rows(flat: np.ndarray, begin: np.ndarray, band: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sketches (words, where each text's begin, its band): text, key, and the next four words.

    The next words are folded to 16 bits each by XOR, which keeps them parity sketches; the first is in
    the low bits. In a sketch of fewer words they come round again. A sketch of one word has no keys: its linked sets are equal.
    """
    words, parts = flat.view(_U), np.diff(begin)
    text = np.repeat(np.arange(len(parts)), parts)
    text = text[parts[text] > 1] if len(text) else text
    start = np.flatnonzero(np.repeat(parts > 1, parts))
    place = start - begin[text]

    def after(rows: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        own = text[rows]
        return words[begin[own] + (place[rows] + n) % parts[own]]

    def folded(x: np.ndarray) -> np.ndarray:
        for half in (32, 16):
            x = x ^ (x >> _U(half))
        return x & _U(_LOW)

    rows = np.arange(len(start))
    follow = np.zeros(len(start), _U)
    for n in range(_FOLLOWING):
        follow |= folded(after(rows, n + 1)) << _U(16 * n)
    follow = follow.view(np.int64)
    key = W.mix(words[start] + W.mix(place.astype(_U) * _U(0x9E3779B97F4A7C15) + band[text].astype(_U)))
    bits, used = np.bitwise_count(words[start]).astype(np.int64), np.zeros(len(start), np.int64)
    less = place * 0.6180339887498949 % 1
    out = []
    for taken in range(1, _MOST_HALVES + 2):
        own = text[rows]
        ready = (bits >= needed[band[own], taken - 1] - less[rows]) | (parts[own] <= taken) | (taken > _MOST_HALVES)
        out.append((rows[ready], key[ready]))
        rows, key, bits, used = (x[~ready] for x in (rows, key, bits, used))
        if not len(rows):
            break
        branches = []
        for half in range(2 * taken):
            free = np.flatnonzero(used >> half & 1 == 0)
            value = (after(rows[free], 1 + half // 2) >> _U(32 * (half % 2))) & _U(0xFFFFFFFF)
            # Sums of mixed halves, so that the order in which they were taken doesn't matter.
            branches.append((rows[free], key[free] + W.mix(value + _U((half + 1) << 32)), bits[free] + np.bitwise_count(value), used[free] | 1 << half))
        rows, key, bits, used = (np.concatenate(c) for c in zip(*branches, strict=True))
        _, once = np.unique(rows << 2 * _MOST_HALVES | used, return_index=True)  # the same halves, taken in another order
        rows, key, bits, used = (x[once] for x in (rows, key, bits, used))
    rows, key = (np.concatenate(c) for c in zip(*out, strict=True))
    return text[rows], W.mix(key), follow[rows]


def short_words(size: np.ndarray) -> np.ndarray:
    """Words of each set's short sketch, a power of two. Neighbouring words add up (XOR) to a sketch of half the length."""
    return _SHORT_WORDS << np.ceil(np.log2(np.maximum(size / _SHORT_SIZE, 1))).astype(np.int64)


def _sketch(shingle: int, num: int, den: int, seed: int):
    limits = np.array(band_limits(num, den))
    per_band = np.array(band_parts(num, den, band_limits(num, den)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release_memory()
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                values, first = shingle_sets(W.split(offsets, raw, fold=True), shingle, seed)
                size = np.diff(first)
                band = np.searchsorted(limits, size, "right") - 1
                cls, check = (set_number(values, first, k) for k in (1, 2))
                lists = []
                for up in (0, 1):
                    flat, begin = sketches(values, first, np.where(size > 0, per_band[np.maximum(band, 0) + up], 0))
                    lists.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat)))
                flat, begin = sketches(values, first, short_words(size))
                lists.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), W.signed(cls), W.signed(check), pa.array(band, pa.int32()), *lists, *(c.slice(lo, hi - lo) for c in batch.columns[2:])],
                    ["doc_id", "n_shingles", "cls", "check", "band", "own", "above", "short", *batch.schema.names[2:]],
                )

    return run


def _sets(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.release_memory()
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                values, first = shingle_sets(W.split(offsets, raw, fold=True), shingle, seed)
                cls = set_number(values, first, 1)
                yield pa.RecordBatch.from_arrays([W.signed(cls), pa.ListArray.from_arrays(pa.array(first, pa.int32()), W.signed(values))], ["cls", "elements"])

    return run


def _keyed(needed: np.ndarray, nth: int, with_next: bool):
    """Stored sketches to (word, cls) or (word, cls, next): the nth round's keys of both sketches. A task gives a class's keys once, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        W.release_memory()
        for batch in batches:
            cls = batch.column(0).to_numpy()
            new = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                new[i] = c not in seen
                if len(seen) < _SEEN:
                    seen.add(c)
            batch, cls = batch.filter(pa.array(new)), cls[new]
            band = batch.column(1).to_numpy()
            for up in (0, 1):
                lists = batch.column(2 + up).cast(pa.large_list(pa.int64()))
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                lo = 0
                while lo < len(cls):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _RUN_WORDS, "right")) - 1)
                    text, key, follow = key_rows(flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], band[lo:hi] + up, needed)
                    own = key % _U(ROUNDS) == nth
                    text, key, follow = text[own], key[own], follow[own]
                    columns = [W.signed(key), pa.array(cls[lo:hi][text])] + [pa.array(follow)] * with_next
                    yield pa.RecordBatch.from_arrays(columns, ["word", "cls", "next"][: len(columns)])
                    lo = hi

    return run


def _shared_keys(scratch: Scratch, table: DataFrame, needed: np.ndarray) -> list[DataFrame]:
    """(word, cls, next): the keys that two classes or more have, in two passes over the sketches for each round.

    The first aggregates each key's smallest and largest class, so a key of any number of classes costs a row
    a task; the second joins all keys to those of the first. Hot keys are skewed join partitions, which Spark splits.
    """
    rows = table.where("n_shingles > 0").select("cls", "band", "own", "above")
    found = []
    for nth in range(ROUNDS):
        met = rows.mapInArrow(_keyed(needed, nth, False), "word long, cls long").groupBy("word").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
        met = scratch.keep(met.where("lo < hi").select("word"), "met")
        keys = rows.mapInArrow(_keyed(needed, nth, True), "word long, cls long, next long")
        found.append(scratch.keep(keys.join(met.hint("merge"), "word", "left_semi"), "shared"))
        scratch.drop(met)
    return found


def _follows(a: str, b: str) -> Column:
    """Whether the n words after the first differ in n bits at most, for n from 1 to 4."""
    apart, near = F.col(a).bitwiseXOR(F.col(b)), F.lit(True)
    for n in range(1, _FOLLOWING + 1):
        near = near & (F.bit_count(apart.bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < _FOLLOWING else apart) <= n)
    return near


def _shortened(x: str, length: Column) -> Column:
    """A sketch at its own length or, if ``length`` is less, at that."""
    times = (F.size(x) / length).cast("int")
    total = lambda i: F.aggregate(F.slice(x, i * times + 1, times), F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))
    return F.when(times > 1, F.transform(F.sequence(F.lit(0), length - 1), total)).otherwise(F.col(x))


class _Verifier:
    """Candidate pairs of classes to links: short sketches first, then whole shingle sets."""

    def __init__(self, scratch: Scratch, rows: DataFrame, table: DataFrame, classes: DataFrame, options: tuple[int, int, int, int]) -> None:
        self.scratch, self.rows, self.classes = scratch, rows, classes
        self.shingle, self.num, self.den, self.seed = options
        short = table.where("n_shingles > 0").select("cls", "n_shingles", "short").dropDuplicates(["cls"])
        self.short = scratch.keep(short, "short")

    def close(self, a: str, b: str) -> Column:
        """Whether columns named with the suffixes ``a`` and ``b`` (n and short) may be of linked sets."""
        size_a, size_b = F.col(f"n{a}"), F.col(f"n{b}")
        sized = self.den * F.least(size_a, size_b) >= self.num * F.greatest(size_a, size_b)
        one, other = (_shortened(f"short{x}", F.size(f"short{y}")) for x, y in ((a, b), (b, a)))
        apart = F.aggregate(F.zip_with(one, other, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
        return sized & ((self.den + self.num) * apart <= (self.den - self.num) * (size_a + size_b))

    def sketched(self, cls: str, suffix: str) -> DataFrame:
        return self.short.select(F.col("cls").alias(cls), F.col("n_shingles").alias(f"n{suffix}"), F.col("short").alias(f"short{suffix}"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose short sketches are no further apart than linked sets can be."""
        joined = pairs.join(self.sketched("b", "_b"), "b").join(self.sketched("a", "_a"), "a")
        return joined.where(self.close("_a", "_b")).select("a", "b")

    def between(self, open_: DataFrame) -> DataFrame:
        """Near pairs of classes under different labels that share a word, with all tests inside the join."""
        side = {}
        for x in "ab":
            rows = open_.select(F.col("word").alias(f"word_{x}"), F.col("cls").alias(x), F.col("next").alias(f"next_{x}"), F.col("label").alias(f"label_{x}"))
            side[x] = rows.join(self.sketched(x, f"_{x}").withColumn(f"short_{x}", _shortened(f"short_{x}", F.lit(_SHORT_WORDS))), x)
        tests = (F.col("word_a") == F.col("word_b")) & (F.col("label_a") < F.col("label_b")) & _follows("next_a", "next_b") & self.close("_a", "_b")
        return side["a"].join(side["b"], tests).select("a", "b")

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """(cls, elements) of the classes of ``pairs``, from one document of each."""
        listed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        own = self.scratch.keep(self.classes.join(listed, "cls").select("any_id"), "listed")
        named = self.scratch.keep(own.where("any_id is not null").select(F.col("any_id").alias("doc_id")).distinct(), "ids")
        chosen = keep_listed(self.rows.where("doc_id is not null"), named, ["doc_id"]).select("doc_id", "text")
        if not own.where("any_id is null").isEmpty():
            chosen = chosen.unionByName(self.rows.where("doc_id is null").select("doc_id", "text"))
        return self.scratch.keep(chosen.mapInArrow(_sets(self.shingle, self.seed), "cls long, elements array<bigint>").dropDuplicates(["cls"]), "sets")

    def links(self, near: DataFrame) -> DataFrame:
        """Those pairs of classes (a, b) whose whole sets reach the similarity."""
        near = self.scratch.keep(near, "near")
        sets = self._sets(near)
        side = {x: sets.select(F.col("cls").alias(x), F.col("elements").alias(f"set_{x}")) for x in "ab"}
        joined = near.join(side["b"], "b").join(side["a"], "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        found = joined.where(self.den * common >= self.num * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")
        found = self.scratch.keep(found, "links")
        self.scratch.drop(sets, near)
        return found


def near_duplicates(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, count_links: bool = False, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, class (an equal set has an equal one), verified_links of its class (those that decide the components), component_id.

    With ``count_links`` every candidate pair is verified, not only those that decide the components: verified_links
    are then all linked classes, and n_links counts the other documents that a document is linked to. The pairs of a
    family of unlike texts that are all linked grow with the square of its size.

    With ``keyed``, text_key = xxhash64(text) tells rows of one doc_id apart, and label is the number of the component,
    null for an empty set; a component_id may be null or shared where ids are.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    keys = ["text_key"] if keyed else []
    rows = docs.select(F.col("doc_id").cast("long"), "text", *(F.xxhash64("text").alias(c) for c in keys))
    for seed in range(20):
        kind = "doc_id long, n_shingles long, cls long, check long, band int, own array<bigint>, above array<bigint>, short array<bigint>" + ", text_key long" * keyed
        table = scratch.keep(rows.mapInArrow(_sketch(shingle, num, den, seed), kind), "sketches")
        classes = table.where("n_shingles > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.max("doc_id").alias("any_id"), F.count("*").alias("members"), (F.min("check") != F.max("check")).alias("mixed")
        )
        classes = scratch.keep(classes, "classes")
        if classes.where("mixed").isEmpty():
            break
        scratch.drop(table, classes)
    else:
        raise RuntimeError("two sets under one number with every seed")

    members = scratch.keep(table.select("doc_id", "n_shingles", "cls", *keys), "members")
    verifier = _Verifier(scratch, rows, table, classes, (shingle, num, den, seed))
    on_band = table.where("n_shingles > 0").groupBy("band").count().agg(F.max("count")).first()[0] or 0
    stored = _shared_keys(scratch, table, bits_needed(on_band, num, den))
    shared = stored[0]
    for more in stored[1:]:
        shared = shared.unionByName(more)
    scratch.drop(table)
    if count_links:
        links = verifier.links(verifier.near(verifier.between(shared.distinct().withColumn("label", F.col("cls"))).distinct()))
        labels = components(scratch, links)
    else:
        links, labels = _deciding(scratch, verifier, shared)
    scratch.drop(*stored)

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    sized = both.join(classes.select(F.col("cls").alias("b"), "members"), "b") if count_links else both.withColumn("members", F.lit(0).cast("long"))
    linked = sized.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("verified_links"), F.sum("members").alias("others"))
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("smallest"))
    n_links = F.coalesce("others", F.lit(0)) + F.col("members") - 1
    named = named.join(smallest, "label").join(linked, "cls", "left").select("cls", F.coalesce("verified_links", F.lit(0)).alias("verified_links"), n_links.alias("n_links"), "smallest", *(["label"] if keyed else []))
    named = scratch.keep(named, "named")
    scratch.drop_all_but(members, named)
    return members.join(named, "cls", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("cls")).alias("class"),
        F.coalesce("verified_links", F.lit(0)).alias("verified_links"),
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []),
        *(["text_key", "label"] if keyed else []),
    )


def _deciding(scratch: Scratch, verifier: _Verifier, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that decide the components, and the components (node, label)."""
    degree = scratch.keep(shared.groupBy("cls").agg(F.count("*").alias("degree")), "degree")

    # First every bucket's pivot against its other members, then what is left between components.
    best = shared.join(counted(degree), "cls").groupBy("word").agg(F.max(F.struct("degree", "cls", "next")).alias("p"))
    best = best.select("word", F.col("p.cls").alias("pivot"), F.col("p.next").alias("pivot_next"))
    starred = scratch.keep(shared.join(best.hint("merge"), "word").where("cls <> pivot"), "starred")
    stars = starred.where(_follows("next", "pivot_next")).select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    links = verifier.links(verifier.near(stars.distinct()))
    labels = components(scratch, links)
    rest = starred.select("word", "cls", "next")
    named = rest.join(counted(labels).withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = scratch.keep(named.distinct(), "named")
    scratch.drop(starred)
    open_words = named.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("word")
    open_ = scratch.keep(named.join(open_words.hint("merge"), "word", "left_semi"), "open")
    scratch.drop(named)
    if not open_.isEmpty():
        more = verifier.links(verifier.near(verifier.between(open_).distinct()))
        links = links.unionByName(more)
        labels = components(scratch, links)
    return links, labels


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
elements AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS e
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common c JOIN sizes s ON s.doc_id = c.x JOIN sizes t ON t.doc_id = c.y WHERE 100 * c.n >= 85 * (s.n + t.n - c.n)),
twoway AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN twoway b ON r.y = b.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
