"""Token ids in binary shards, with a minimal perfect hash index over document keys.

A store is a folder of two kinds of files and two Parquet tables that list them.

A shard holds documents of one range of doc_id in ascending order: the ids of all its
documents one after another (unsigned little-endian, 16 bits where the vocabulary allows it,
else 32), then the documents' offsets and keys, then a fixed-size tail that says where these
lie. An index file holds the keys of one hash bucket: the perfect hash, and by a key's number
its fingerprint and its entries (shard, first document, documents). A look-up reads the file
of the key's bucket, asks the hash for the number, compares the fingerprint, and reads that
document's bytes in the shard: the same few steps for any key in a store of any size.

Files are written by tasks through pyarrow's file systems under names of their own; the
listing Parquet table, committed by Spark, decides which of them count. So a repeated task
leaves at most a file that nothing lists.

Nulls and odd rows: a null text is encoded as an empty one and still gets its end id; a null
doc_id comes before all others and has an index entry of its own; repeated rows are stored
one after another under one key; an empty table gives an empty store; other columns of the
input are not read. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import functools
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm import scratch
from logtide.llm.bpe import Generations, Splitter, default_vocabulary, looked_up
from logtide.llm.joins import quantiles
from logtide.llm.mph import PerfectHash
from logtide.llm.words import mix, register_cache

_U = np.uint64
_TAIL = struct.Struct("<8sIIQQQ")  # magic, bytes an id, keyless documents, documents, ids, offset of the offsets
_MAGIC = b"LTSHARD1"
#: Documents of one shard, and keys of one index file, about; small stores use smaller shards so that all cores write.
SHARD_DOCS, INDEX_KEYS = 1 << 16, 1 << 18


class LibraryCodec:
    """Whole texts to ids as the tokenizers library encodes them; words met before come from a cache."""

    def __init__(self, path: str) -> None:
        self.splitter = Splitter(path)
        self.library = self.splitter.library
        self.cache = Generations(self._one)
        ends = [i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(1 + max(self.library.get_vocab().values()), bool)
        self.ends[ends] = True

    def _one(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode many new words in one call; a word's ids run up to a token with the end-of-word suffix."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            return  # the words are then encoded one by one as they are met
        first = np.concatenate([[0], last[:-1]])
        for word, a, b in zip(words, first.tolist(), last.tolist(), strict=True):
            self.cache.store(word, ids[a:b].tobytes())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.splitter.words(x) if self.splitter.plain(x) else None for x in texts]
        young, old = self.cache, self.cache.older
        new = [word for word in set().union(*(words for words in split if words)) if word not in young and word not in old]
        if new:
            self._learn(new)
        return [self._one(x) if words is None else looked_up(self.cache, words) for x, words in zip(texts, split, strict=True)]


@functools.lru_cache(maxsize=1)
def _codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


register_cache(_codec.cache_clear)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _encode(vocabulary: str, end_id: int, width: int, cuts: list[int]):
    end, kind, edges = np.array([end_id], f"<u{width}").tobytes(), f"<u{width}", np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = codec.encode_batch([x or "" for x in part.column(1).to_pylist()])
                ids = [(x if width == 4 else np.frombuffer(x, "<u4").astype(kind).tobytes()) + end for x in found]
                keys = part.column(0)
                shard = np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), "left")
                shard[keys.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays([keys, pa.array(shard, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "shard", "ids"])

    return run


def _tail(width: int, keyless: int, documents: int, ids: int) -> bytes:
    return _TAIL.pack(_MAGIC, width, keyless, documents, ids, ids * width)


def _write_shards(folder: str, width: int):
    """Stream sorted documents into one file a shard; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder_path = _filesystem(folder)
        files.create_dir(folder_path, recursive=True)
        shard, out, name, lengths, keys = None, None, "", [], []

        def close() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<i8")
            keyless = sum(k is None for k in keys)
            out.write(offsets.tobytes())
            out.write(np.array([0 if k is None else k for k in keys], "<i8").tobytes())
            out.write(_tail(width, keyless, len(keys), int(offsets[-1])))
            out.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
                ["shard", "file", "n_docs", "n_ids"],
            )

        for batch in batches:
            for key, number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if number != shard:
                    if out is not None:
                        yield close()
                    shard, name, lengths, keys = number, f"shard-{number:06d}-{uuid.uuid4().hex}.ids", [], []
                    out = files.open_output_stream(f"{folder_path}/{name}")
                raw = ids.as_buffer()
                out.write(raw)
                lengths.append(raw.size // width)
                keys.append(key)
        if out is not None:
            yield close()

    return run


class Shard:
    """Random access to one shard file; only the tail tables are held in memory."""

    def __init__(self, folder: str, name: str) -> None:
        files, path = _filesystem(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        magic, self.width, self.keyless, self.n_docs, self.n_ids, at = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not a shard")
        self.offsets = np.frombuffer(self.file.read_at(8 * (self.n_docs + 1), at), "<i8")
        self.keys = np.frombuffer(self.file.read_at(8 * self.n_docs, at + 8 * (self.n_docs + 1)), "<i8")

    def ids(self, document: int) -> np.ndarray:
        a, b = int(self.offsets[document]), int(self.offsets[document + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


def _list_keys(folder: str):
    """The runs of equal keys of each listed shard: key, shard, first document, documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = Shard(folder, name)
                new = np.ones(one.n_docs, bool)
                new[1:] = one.keys[1:] != one.keys[:-1]
                new[1 : one.keyless] = False
                if 0 < one.keyless < one.n_docs:
                    new[one.keyless] = True
                first = np.flatnonzero(new)
                keys = pa.array(one.keys[first], pa.int64(), mask=first < one.keyless)
                count = np.diff(np.append(first, one.n_docs))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(first), number), pa.int32()), pa.array(first, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "shard", "first", "docs"])

    return run


def _bucket(buckets: int):
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).cast("int")


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(_U) * _U(0x9FB21C651E98DF25)) >> _U(32)).astype("<u4")


def _write_index(folder: str):
    """One file a bucket. The entries of a bucket are bounded by its keys and the shards each key lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        for bucket in table.column("bucket").unique().to_pylist():
            own = table.filter(pa.compute.equal(table.column("bucket"), bucket))
            null = own.filter(own.column("doc_id").is_null())
            own = own.filter(own.column("doc_id").is_valid())
            keys = own.column("doc_id").to_numpy()
            distinct = np.unique(keys)
            hashed = PerfectHash.build(distinct.view(_U))
            number = hashed.numbers(keys.view(_U))
            order = np.lexsort((own.column("first").to_numpy(), own.column("shard").to_numpy(), number))
            starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(distinct)))]).astype("<i8")
            prints = np.zeros(len(distinct), "<u4")
            prints[number] = _fingerprints(keys)
            entries = pa.concat_tables([own.take(pa.array(order)), null.sort_by([("shard", "ascending"), ("first", "ascending")])])
            raw = hashed.to_bytes()
            head = struct.pack("<QQQ", len(raw), len(distinct), len(entries))
            name = f"index-{bucket:06d}-{uuid.uuid4().hex}.mph"
            with files.open_output_stream(f"{path}/{name}") as out:
                for piece in (head, raw, prints.tobytes(), starts.tobytes(), *(entries.column(c).to_numpy().astype("<i8").tobytes() for c in ("shard", "first", "docs"))):
                    out.write(piece)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name])], ["bucket", "file"])

    return run


class Index:
    """One index file in memory."""

    def __init__(self, folder: str, name: str) -> None:
        files, path = _filesystem(folder)
        with files.open_input_stream(f"{path}/{name}") as f:
            raw = io.BytesIO(f.read())
        size, n, entries = struct.unpack("<QQQ", raw.read(24))
        self.hash = PerfectHash.from_bytes(raw.read(size))
        self.prints = np.frombuffer(raw.read(4 * n), "<u4")
        self.starts = np.frombuffer(raw.read(8 * (n + 1)), "<i8")
        self.shard, self.first, self.docs = (np.frombuffer(raw.read(8 * entries), "<i8") for _ in range(3))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For int64 keys, the range of entries of each; empty for a key that isn't stored."""
        number = self.hash.numbers(keys.view(_U))
        known = number >= 0
        known[known] = self.prints[number[known]] == _fingerprints(keys[known])
        number = np.where(known, number, 0)
        first = np.where(known, self.starts[number] if len(self.prints) else 0, 0)
        return first, np.where(known, self.starts[number + 1] if len(self.prints) else 0, 0)

    def null_entries(self) -> tuple[int, int]:
        return int(self.starts[-1]), len(self.shard)


def _probe(folder: str, names: dict[int, str] | None = None):
    """Keys with their bucket's index file to places: doc_id, shard, document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            for file in batch.column(1).unique().to_pylist():
                part = batch.filter(pa.compute.equal(batch.column(1), file)).column(0)
                if file != name:
                    name, index = file, Index(folder, file)
                keys = part.fill_null(0).to_numpy()
                a, b = index.entries(keys)
                null = part.is_null().to_numpy(zero_copy_only=False)
                a[null], b[null] = index.null_entries()
                n = b - a
                entry = np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)
                each = index.docs[entry]
                row = np.repeat(np.repeat(np.arange(len(keys)), n), each)
                document = np.arange(len(row)) + np.repeat(index.first[entry] - np.cumsum(each) + each, each)
                yield pa.RecordBatch.from_arrays([part.take(pa.array(row)), pa.array(np.repeat(index.shard[entry], each), pa.int32()), pa.array(document, pa.int64())], ["doc_id", "shard", "document"])

    return run


def _fetch(folder: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            starts, n, out = [], [], []
            for file, base, document in zip(*(batch.column(c).to_pylist() for c in ("file", "base", "document")), strict=True):
                if file != name:
                    name, shard = file, Shard(folder, file)
                ids = shard.ids(document).astype("<u4")
                starts.append(base + int(shard.offsets[document]))
                n.append(len(ids))
                out.append(zlib.crc32(ids.tobytes()) if digest else ids.tobytes())
            last = pa.array(out, pa.int64() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


class TokenStore:
    """A written store; ``documents`` looks keys up in it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        listed = spark.read.parquet(f"{folder}/shards.parquet")  # a row a shard
        self.shards = listed.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
        self.index = spark.read.parquet(f"{folder}/index.parquet")
        self.buckets = max(1, self.index.agg(F.max("buckets")).first()[0] or 1)

    def documents(self, keys: DataFrame, *, digest: bool = False) -> DataFrame:
        """For each stored document of distinct ``keys`` (doc_id): doc_id, start, n_tokens, and ids or their CRC-32."""
        probes = keys.select("doc_id", _bucket(self.buckets).alias("bucket")).join(self.index.select("bucket", "file"), "bucket")
        probes = probes.repartition("bucket").sortWithinPartitions("bucket").select("doc_id", "file")
        places = probes.mapInArrow(_probe(self.folder), "doc_id long, shard int, document long")
        found = places.join(self.shards.select("shard", "file", "base"), "shard").repartition("shard").sortWithinPartitions("shard", "document")
        kind = "ids_crc32 long" if digest else "ids binary"
        return found.mapInArrow(_fetch(self.folder, digest), f"doc_id long, start long, n_tokens long, {kind}")


def write_store(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 2) -> TokenStore:
    """Encode every text, append ``end_id``, and write shards and index below ``folder`` (a URI that all executors reach)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    total = rows.count()
    width = 2 if Splitter(vocabulary).library.get_vocab_size() <= 1 << 16 else 4
    n_shards = max(-(-total // SHARD_DOCS), min(-(-total // 4096), 4 * spark.sparkContext.defaultParallelism), 1)
    cuts = quantiles(rows, "doc_id", n_shards)
    encoded = rows.mapInArrow(_encode(vocabulary, end_id, width, cuts), "doc_id long, shard int, ids binary")
    sorted_rows = encoded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    with scratch.short_lived_shuffles(spark):
        sorted_rows.mapInArrow(_write_shards(folder, width), "shard int, file string, n_docs long, n_ids long").write.parquet(f"{folder}/shards.parquet")
        shards = spark.read.parquet(f"{folder}/shards.parquet")
        keys = shards.select("shard", "file").repartition(len(cuts) + 1, "shard").mapInArrow(_list_keys(folder), "doc_id long, shard int, first long, docs long")
        buckets = max(1, -(-total // INDEX_KEYS), min(-(-total // 8192), spark.sparkContext.defaultParallelism))
        entries = keys.select("*", _bucket(buckets).alias("bucket")).repartitionById(buckets, "bucket")
        index = entries.mapInArrow(_write_index(folder), "bucket int, file string")
        index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index.parquet")
    return TokenStore(spark, folder)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, scratch.new_path(spark, "tokens"), default_vocabulary())
    return store.documents(docs.select(F.col("doc_id").cast("long")).distinct(), digest=True)
