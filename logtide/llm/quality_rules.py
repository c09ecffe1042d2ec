"""Content and boilerplate lines by a linear-chain conditional random field.

Every line with a word has features of its whole text, such as shares of letters, capitals
and symbols, its length and ending, phrases common in boilerplate, and whether it repeats an earlier line. A chain scores the two labels by
these features and by how labels follow each other; Viterbi decoding marks each line, and a
document is kept when lines marked as content hold at least ``min_content`` of its word
characters. Fixed base rules come first.

Training. Only documents have labels, so lines' labels are hidden and bound to their document's
through the content share alone: content holds at least ``min_content`` of a document of quality 1, and less of one of
quality 0. They start as their document's label, lines with a boilerplate phrase as boilerplate. Weights without
pairs are fitted, lines are decoded, and where a document's share contradicts its label the least certain lines are
turned over; then the whole chain is fitted to these labels, and both steps are done again. A line of prose in a bad document
thus becomes content, and a menu in a good one boilerplate, and the chain sees labels change within documents.

Each fit is gradient ascent on the regularised log likelihood, until steps are small. The sample is bounded: at most
``sample_docs`` labelled documents with at most ``sample_lines`` lines each, smallest hash of the doc_id first, one row of a
repeated doc_id, none of them held out. Without labels of both kinds every line is content.

Nulls and odd rows: a null or empty text has no words and fails the base rules; a null doc_id
is kept as it is; repeated rows are judged alike; of two label sequences of the same score the one ending in content is
taken, and a share of exactly ``min_content`` is kept; an empty table gives an empty result;
texts are read whole, whatever their length; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import words as W
from logtide.llm.quality_classifier import held_out, segment_counts

SAMPLE_DOCS, SAMPLE_LINES = 1500, 400
#: Lines of one training sequence; longer documents are trained in pieces, so that steps are few and cheap.
PIECE_LINES = 32
#: Share of word characters that must lie in content lines.
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8

_TABLES = {
    name: np.isin(np.arange(256), list(chars))
    for name, chars in {
        "upper": bytes(range(65, 91)),
        "lower": bytes(range(97, 123)),
        "digits": b"0123456789",
        "pipes": b"|",
        "marks": b"#*$%&<>",
        "exclaims": b"!",
        "stops": b".,;:",
    }.items()
}
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LATER = np.arange(256) & 0xC0 == 0x80  # bytes that continue a code point
#: Phrases that mark boilerplate, in lower case.
PHRASES = (b"copyright", b"all rights reserved", b"licensed under", b"license", b"cookie", b"privacy policy", b"terms of", b"subscribe", b"sign up", b"log in", b"click here", b"powered by")
LINE_FEATURES = 13
PHRASE = LINE_FEATURES - 1


@dataclass
class Lines:
    """Lines with a word of a run of texts: features, word characters, and each text's first line."""

    x: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    repeats: np.ndarray


def _with_phrases(whole: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which lines hold a boilerplate phrase, A-Z taken as a-z."""
    low, found = whole.lower(), np.zeros(len(starts), bool)
    for phrase in PHRASES:
        at, places = low.find(phrase), []
        while at >= 0:
            places.append(at)
            at = low.find(phrase, at + 1)
        if places:
            at = np.array(places)
            line = np.searchsorted(starts, at, "right") - 1
            found[line[at + len(phrase) <= ends[line]]] = True
    return found


def lines_of(offsets: np.ndarray, raw: np.ndarray, words: W.Words) -> Lines:
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    edges = np.append(starts, len(raw))
    n_words = np.diff(np.searchsorted(words.starts, edges))
    whole = raw.tobytes()
    text = np.searchsorted(offsets, starts, "right") - 1
    seen: set[bytes] = set()
    repeat, owner = np.zeros(len(starts), bool), -1
    for i, (a, b, t, n) in enumerate(zip(starts.tolist(), edges[1:].tolist(), text.tolist(), n_words.tolist(), strict=True)):
        if t != owner:
            owner, seen = t, set()
        if n:
            line = whole[a : b - 1] if whole[b - 1] == 10 else whole[a:b]
            repeat[i] = line in seen
            seen.add(line)
    has = n_words > 0
    count = {k: segment_counts(v, raw, edges).astype(float) for k, v in _TABLES.items()}
    inside = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~W.SPACE[raw] & ~_LATER[raw], out=inside[1:])
    chars = np.diff(inside[edges]).astype(float)
    n, c = np.maximum(n_words, 1).astype(float), np.maximum(chars, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    last = np.zeros(len(starts))
    if len(words.ends):
        at = np.searchsorted(words.starts, edges[1:]) - 1
        last = np.isin(raw[words.ends[np.maximum(at, 0)] - 1], list(b".?!\"')")).astype(float)
    x = np.stack(
        [
            np.ones(len(starts)), np.log1p(n) / 4, np.minimum(chars / n, 20) / 10, count["upper"] / letters, count["digits"] / c,
            np.minimum(count["pipes"] / n, 2), np.minimum(count["marks"] / n, 3), np.minimum(count["exclaims"] / n, 2),
            np.minimum(count["stops"] / n, 2), last, repeat.astype(float), (n <= 3).astype(float),
            _with_phrases(whole, starts, edges[1:]).astype(float),
        ],
        axis=1,
    )[has]
    n_texts = len(offsets) - 1
    return Lines(x, chars[has], np.searchsorted(text[has], np.arange(n_texts + 1)), np.bincount(text[has & repeat], minlength=n_texts))


@dataclass
class Chain:
    """Weights (2, features) of the labels boilerplate (0) and content (1), and of label pairs (2, 2)."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most probable labels of each text's lines, by Viterbi."""
        state = (x @ self.weights.T).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        out = np.zeros(len(state), np.int8)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == b:
                continue
            s0, s1 = state[a]
            back = []
            for e0, e1 in state[a + 1 : b]:
                a0, b0, a1, b1 = s0 + p00, s1 + p10, s0 + p01, s1 + p11
                back.append((b0 > a0, b1 > a1))
                s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
            label = int(s1 >= s0)
            out[b - 1] = label
            for i in range(b - 2, a - 1, -1):
                label = int(back[i - a][label])
                out[i] = label
        return out


@dataclass
class Sample:
    """Training sequences, longest first, padded to the longest; ``gold`` is a label a line."""

    x: np.ndarray
    mask: np.ndarray
    gold: np.ndarray

    @staticmethod
    def of(sequences: list[np.ndarray], labels: list[np.ndarray]) -> Sample:
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        n, longest = len(sequences), max(map(len, sequences))
        x, mask, gold = np.zeros((n, longest, LINE_FEATURES)), np.zeros((n, longest)), np.zeros((n, longest), np.int64)
        for row, i in enumerate(order):
            x[row, : len(sequences[i])], mask[row, : len(sequences[i])], gold[row, : len(sequences[i])] = sequences[i], 1, labels[i]
        return Sample(x, mask, gold)


def likelihood(sample: Sample, weights: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the gold labels, and its gradients, by the forward and backward sums."""
    x, mask, gold = sample.x, sample.mask, sample.gold
    n, longest = mask.shape
    active = (mask > 0).sum(0)  # sequences that reach each place, always the first ones
    raw = x @ weights.T
    top = raw.max(2, keepdims=True)
    e, t = np.exp(raw - top), np.exp(pairs)
    ahead, behind, scale = np.zeros((n, longest, 2)), np.ones((n, longest, 2)), np.ones((n, longest))
    for k in range(longest):
        a = active[k]
        ahead[:a, k] = (ahead[:a, k - 1] @ t if k else 1) * e[:a, k]
        scale[:a, k] = ahead[:a, k].sum(1)
        ahead[:a, k] /= scale[:a, k, None]
    expected = np.zeros((2, 2))
    for k in range(longest - 2, -1, -1):
        a = active[k + 1]
        inner = e[:a, k + 1] * behind[:a, k + 1] / scale[:a, k + 1, None]
        behind[:a, k] = inner @ t.T
        expected += t * (ahead[:a, k].T @ inner)
    both = mask[:, 1:] > 0
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    one = np.eye(2)[gold] * mask[:, :, None]
    value = float((one * raw).sum() + (seen_pairs * pairs).sum() - ((np.log(scale) + top[:, :, 0]) * mask).sum())
    change = one - ahead * behind * mask[:, :, None]
    return value, np.einsum("ntk,ntf->kf", change, x), seen_pairs - expected


def fit(sequences: list[np.ndarray], labels: list, *, steps: int = 150, rate: float = 0.5, penalty: float = 1e-3, with_pairs: bool = True, small: float = 2e-4) -> Chain:
    """A chain for sequences and their labels, one a line or one for all lines, by gradient ascent with steps scaled by past gradients."""
    labels = [np.broadcast_to(np.asarray(y), len(s)) for s, y in zip(sequences, labels, strict=True)]
    if len({int(v) for y in labels for v in np.unique(y)}) < 2:
        return Chain(np.array([np.zeros(LINE_FEATURES), np.eye(LINE_FEATURES)[0]]), np.zeros((2, 2)))
    cuts = [(i, lo) for i, s in enumerate(sequences) for lo in range(0, len(s), PIECE_LINES)]
    sample = Sample.of([sequences[i][lo : lo + PIECE_LINES] for i, lo in cuts], [labels[i][lo : lo + PIECE_LINES] for i, lo in cuts])
    n_lines = sample.mask.sum()
    weights, pairs = np.zeros((2, LINE_FEATURES)), np.zeros((2, 2))
    squares_w, squares_p = np.full_like(weights, 1e-8), np.full_like(pairs, 1e-8)
    for _ in range(steps):
        _, up_w, up_p = likelihood(sample, weights, pairs)
        step_w = up_w / n_lines - penalty * weights
        step_p = (up_p / n_lines - penalty * pairs) * with_pairs
        squares_w += step_w**2
        squares_p += step_p**2
        weights += rate * step_w / np.sqrt(squares_w)
        pairs += rate * step_p / np.sqrt(squares_p)
        if max(np.abs(step_w).max(), np.abs(step_p).max()) < small:
            break
    return Chain(weights, pairs)


def bound(content: np.ndarray, margin: np.ndarray, chars: np.ndarray, quality: int, min_content: float) -> np.ndarray:
    """Labels of a document's lines, turned over from the least certain on until the content share agrees with its label."""
    content, total = content.astype(np.int64).copy(), chars.sum()
    share = lambda: (chars * content).sum() / max(total, 1)
    for i in np.argsort(np.abs(margin), kind="stable"):
        if (share() >= min_content) == (quality == 1):
            break
        content[i] = quality
    return content


def learn(sequences: list[np.ndarray], chars: list[np.ndarray], qualities: list[int], *, rounds: int = 2, min_content: float = MIN_CONTENT) -> Chain:
    """A chain from documents' labels, with the labels of lines hidden."""
    if len(set(qualities)) < 2:
        return fit(sequences, qualities)
    lines = [np.where(x[:, PHRASE] > 0, 0, y) for x, y in zip(sequences, qualities, strict=True)]
    lines = [bound(v, -x[:, PHRASE] - 1, c, y, min_content) for v, x, c, y in zip(lines, sequences, chars, qualities, strict=True)]
    chain = fit(sequences, lines, with_pairs=False)
    for _ in range(rounds):
        lines = []
        for x, c, y in zip(sequences, chars, qualities, strict=True):
            margin = x @ (chain.weights[1] - chain.weights[0])
            lines.append(bound(chain.decode(x, np.array([0, len(x)])), margin, c, y, min_content))
        chain = fit(sequences, lines)
    return chain


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, offsets, raw in W.chunks(batch.column(1)):
            lines = lines_of(offsets, raw, W.split(offsets, raw))
            flat = pa.ListArray.from_arrays(pa.array(lines.first * LINE_FEATURES, pa.int32()), pa.array(lines.x.ravel()))
            chars = pa.ListArray.from_arrays(pa.array(lines.first, pa.int32()), pa.array(lines.chars))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat, chars], ["y", "x", "chars"])


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, min_content: float = MIN_CONTENT) -> Chain:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    half = [known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2) for y in (0, 1)]
    sample = half[0].unionByName(half[1]).select("doc_id", F.col("quality").alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_docs rows are broadcast
    chosen = chosen.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = chosen.select("y", "text").mapInArrow(_line_rows, "y int, x array<double>, chars array<double>")
    rows = rows.where(F.size("chars").between(1, sample_lines)).select("y", F.col("x").cast("array<float>").alias("x"), "chars")
    found = sorted(((r["y"], r["x"], r["chars"]) for r in rows.toLocalIterator()), key=lambda r: (r[0], len(r[1]), r[1]))
    return learn([np.array(x, np.float64).reshape(-1, LINE_FEATURES) for _, x, _ in found], [np.array(c) for _, _, c in found], [y for y, _, _ in found], min_content=min_content)


def repeated_words(words: W.Words, length: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in windows found twice or more in it."""
    hashes = W.windows(words.hashes, length)
    at = np.flatnonzero(W.fits(words, length))
    text = words.text_of()[at]
    order = np.argsort(hashes[at])
    order = order[np.argsort(text[order].astype(np.uint32), kind="stable")]
    at, text = at[order], text[order]
    same = (hashes[at[1:]] == hashes[at[:-1]]) & (text[1:] == text[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + length, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return np.diff(covered[words.first])


def _judged(chain: Chain, min_content: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, raw in W.chunks(batch.column(1)):
                words = W.split(offsets, raw)
                lines = lines_of(offsets, raw, words)
                content = chain.decode(lines.x, lines.first) > 0
                total, good = (np.diff(np.concatenate([[0.0], np.cumsum(c)])[lines.first]) for c in (lines.chars, lines.chars * content))
                share = good / np.maximum(total, 1)
                n, repeated = words.counts, repeated_words(words)
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
                columns = [n, total.astype(np.int64), segment_counts(_SYMBOL, raw, offsets), lines.repeats, repeated]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    return run


def judge(docs: DataFrame, chain: Chain, *, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, base verdict, content share and verdict of every document."""
    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged(chain, min_content), kind)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
