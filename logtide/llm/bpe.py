"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word is encoded without replaying merges. An Aho-Corasick pass gives the longest token that
starts at each place. From the left, the longest token is taken that is compatible with the
token before it; where none fits, the place is marked dead and the token before is shortened.
Two tokens are compatible when BPE on their joined text leaves exactly these two, which the
merge tree decides; answers are kept in a pair table. A row of compatible pairs is exactly
what BPE makes, and no place is tried twice from the left, so the time is linear.

The vocabulary is that of a ``tokenizers`` file with byte-level BPE, with or without an end-of-word suffix,
given as a parameter; a file with settings that would change the ids is refused. If the file splits words as the lower-casing one does, texts of common letters
are normalised and split here; any other text and any other file
goes through the library's own normaliser and splitter, so both ways give the same words.
Words met before come from a bounded cache.

Nulls and odd rows: a null or empty text has no ids and decodes to the empty text; a null
doc_id is kept; very long words are encoded in linear time; repeated rows and ties each give
a row; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logtide.llm.words import register_cache

#: Words that one generation of a worker's cache holds.
CACHE_WORDS = 400_000
_END = "Ā"  # stands for the end-of-word suffix behind the bytes of a word

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_COMMON = re.compile(rf"[\t-\r -~{_LETTERS}]*")
_LOWER = "a-zß-öø-ÿ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\t-\r 0-9{_LOWER}]+")


# Fixed values of a vocabulary file: the normaliser and splitter that the patterns above stand for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _settings(path: str) -> dict:
    """The file's contents, if this encoder gives the library's ids for them."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, splitter = found["model"], found["pre_tokenizer"] or {}
    byte_level = "ByteLevel" in [splitter.get("type"), *(x["type"] for x in splitter.get("pretokenizers", []))]
    unlike = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or not byte_level or unlike or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in found["added_tokens"]):
        raise ValueError(f"{path} isn't plain byte-level BPE {unlike}")
    if (found["decoder"] or {"type": "ByteLevel"})["type"] != "ByteLevel":
        raise ValueError(f"{path} has a decoder other than by bytes")
    return found


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Generations(dict):
    """A cache of two generations: what the younger lacks is taken from the older or made anew."""

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE_WORDS) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        return self.store(word, self.make(word) if found is None else found)

    def store(self, word: str, value: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def looked_up(cache: Generations, words: list) -> bytes:
    """The ids of words one after another."""
    if len(words) > 1:
        return b"".join(itemgetter(*words)(cache))
    return cache[words[0]] if words else b""


class Splitter:
    """Text to words, each a string of byte characters; special tokens come out as ints."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        found = _settings(path)
        added = found["added_tokens"]
        self._known = found["normalizer"] == _NORMALIZER and found["pre_tokenizer"] == _SPLITTER
        self.special = {t["content"]: t["id"] for t in added}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self._bytes = {c: chr(b) for b, c in enumerate(_byte_alphabet())}
        self._bytes = str.maketrans(self._bytes)

    def plain(self, text: str) -> bool:
        return self._known and _COMMON.fullmatch(text) is not None and "<|" not in text

    def words(self, text: str) -> list[str | int]:
        """Words of any text; those of a ``plain`` text are lower-case strings not yet in bytes."""
        if self.plain(text):
            return _WORD.findall(text.lower())
        out: list[str | int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
                out += ["ā" + piece.translate(self._bytes) for piece, _ in pieces]
        return out


def _as_bytes(word: str) -> str:
    """A word of Splitter.words as one character a byte."""
    return word[1:] if word[0] == "ā" else word.encode("utf-8").decode("latin-1")


class Encoder:
    """Exact BPE over one vocabulary file."""

    def __init__(self, path: str) -> None:
        found = _settings(path)
        added, model = found["added_tokens"], found["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.end = _END if suffix else ""
        chars = str.maketrans({c: chr(b) for b, c in enumerate(_byte_alphabet())})
        vocab = model["vocab"]

        def text(token: str) -> str:
            ended = suffix and token.endswith(suffix)
            return (token[: -len(suffix)] if ended else token).translate(chars) + (_END if ended else "")

        size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        self.texts: list[str] = [""] * size
        shown = [""] * size
        for token, i in vocab.items():
            self.texts[i], shown[i] = text(token), token
        for t in added:
            shown[t["id"]] = t["content"]
        self.rank = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a_id, b_id, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[a_id, b_id] = rank
            self.rank[made], self.left[made], self.right[made] = rank, a_id, b_id
        ids = {t: i for i, t in enumerate(self.texts) if t}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1) for t in self.texts]
        self.lengths = [len(t) for t in self.texts]
        self.pairs: dict[tuple[int, int], bool] = {}
        # Decoding: in one block with offsets, every token's bytes, or without a decoder its text and a space behind it.
        if found["decoder"]:
            special = {t["id"]: t["content"].encode() for t in added}
            pieces = [special.get(i, s.encode("latin-1", "ignore")) for i, s in enumerate(self.texts)]
        else:
            pieces = [s.encode("utf-8") + b" " for s in shown]
        self.between = 0 if found["decoder"] else 1
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.block = np.frombuffer(b"".join(pieces), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        """Undo both tokens' merges from the last back; a merge over the seam that comes before the undone one breaks it.

        Of equal merges the left one goes first, hence the + 1 on the right side.
        """
        rank, until = self.rank, len(self.rank) + 1
        while True:
            if self.merges.get((a, b), until) < until:
                return False
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            elif rank[b]:
                until, b = rank[b] + 1, self.left[b]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as one character a byte."""
        text = word + self.end
        n, lengths = len(text), self.lengths
        longest = [-1] * n
        for end, token in self.automaton.iter(text):
            at = end + 1 - lengths[token]
            if longest[at] < 0 or lengths[token] > lengths[longest[at]]:
                longest[at] = token
        out: list[int] = []
        dead, at, token = set(), 0, longest[0]
        while at < n:
            while token >= 0 and (at + lengths[token] in dead or (out and not self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0 and (at + lengths[token] == n or longest[at + lengths[token]] >= 0):
                out.append(token)
                at += lengths[token]
                token = longest[at] if at < n else -1
            elif token >= 0:  # nothing starts behind it, as before an end mark
                dead.add(at + lengths[token])
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, or where the file names no decoder their texts with a space between them."""
        if not len(ids):
            return b""
        first = self.offsets[ids]
        length = self.offsets[np.asarray(ids, np.int64) + 1] - first
        end = np.cumsum(length)
        return self.block[np.arange(end[-1]) + np.repeat(first - end + length, length)][: end[-1] - self.between].tobytes()


class Codec:
    """Whole texts to ids and back, with a cache of words."""

    def __init__(self, path: str) -> None:
        self.splitter, self.encoder = Splitter(path), Encoder(path)
        self.cache = Generations(self._make)

    def _make(self, word: str | int) -> bytes:
        ids = [word] if isinstance(word, int) else self.encoder.encode_word(_as_bytes(word))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return looked_up(self.cache, self.splitter.words(text))

    def decode(self, ids: bytes) -> bytes:
        return self.encoder.decode(np.frombuffer(ids, "<u4"))


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


register_cache(codec.cache_clear)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoded(vocabulary), "doc_id long, ids binary")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return run


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return ids.select("doc_id", "ids").mapInArrow(_decoded(vocabulary), "doc_id long, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = own.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
