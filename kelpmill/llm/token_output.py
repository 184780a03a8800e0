"""Token ids in binary shards with an index: a minimal perfect hash takes a document's key to its place in the payload.

A shard is one row of a Parquet table: its place in the order, the number of its documents and ids, and one binary
value, laid out as below (little-endian). The payload is raw ids, two or four bytes each.

    magic 4 bytes | width u4 | documents u4 | keys u4 | buckets u4 | ids u8
    seed u4 for each bucket, or flag and slot of its only key | slot: fingerprint u4, document u4 | document: end u8 | key of a document: end u4, key bytes | payload

A key is a document's id as text. Its hash names a bucket and, with the bucket's seed, a slot that no other key of the
shard has; the slot holds 32 more bits of the hash and the first document of that key, whose stored key is compared too.
Documents of one id stand next to each other, in one shard or in several that follow each other.

Beside the shards is a directory, a small table of each shard's file, first and last id, so a lookup reads only the files
that may hold its keys.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, shuffle_partitions
from .vocabulary import RUN, piece_encoder, place, tokenizer
from .words import slices

MAGIC = b"TKS2"
HEAD = struct.Struct("<4sIIIIQ")
END_ID = 2
#: A shard is closed at so many ids; a longer document makes a longer shard.
SHARD_IDS = 500_000
PER_BUCKET = 4
#: Seeds tried at once, and the flag of a seed that is a slot itself.
TRIES = 64
DIRECT = np.uint32(1 << 31)
VOCABULARY = "byte_bpe_50k.json"


def _hashed(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 96


def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slots of keys under their seeds; a seed with the flag is a slot itself."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        found = ((x ^ (x >> np.uint64(29))) >> np.uint64(8)) % np.uint64(n)
    return np.where(seeds & DIRECT, seeds & (DIRECT - np.uint32(1)), found).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key).

    Buckets, the fullest first, try seeds until their keys fall on different free slots; those of one key come last and
    name one of the slots that are left.
    """
    n = len(hashes)
    buckets = -(-n // PER_BUCKET)
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    of = (hashes >> np.uint64(40)) % np.uint64(max(1, buckets))
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(ends)
    for b in np.argsort(-sizes, kind="stable"):
        own, first = order[ends[b] : ends[b + 1]], 0
        if len(own) < 2:
            break
        while True:
            tried = np.arange(first, first + TRIES, dtype=np.uint32)
            at = _slots(hashes[own][None, :], tried[:, None], n)
            row = np.sort(at, axis=1)
            good = np.flatnonzero(~taken[at].any(axis=1) & (row[:, 1:] != row[:, :-1]).all(axis=1))
            if len(good):
                seeds[b], slots[own] = tried[good[0]], at[good[0]]
                taken[at[good[0]]] = True
                break
            first += TRIES
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(~taken)
    seeds[single], slots[order[ends[single]]] = left.astype(np.uint32) | DIRECT, left
    return seeds, slots


def pack(keys: list[bytes], ids: list[bytes], width: int) -> bytes:
    firsts = [k for k, key in enumerate(keys) if not k or key != keys[k - 1]]
    hashed = [_hashed(keys[k]) for k in firsts]
    hashes = np.array([h for h, _ in hashed], np.uint64)
    seeds, slots = perfect_hash(hashes)
    index = np.zeros((len(firsts), 2), "<u4")
    index[slots, 0] = [f for _, f in hashed]
    index[slots, 1] = firsts
    ends = np.cumsum([len(i) // width for i in ids]).astype("<u8")
    key_ends = np.cumsum([len(k) for k in keys]).astype("<u4")
    head = HEAD.pack(MAGIC, width, len(keys), len(firsts), len(seeds), int(ends[-1]))
    return b"".join([head, seeds.astype("<u4").tobytes(), index.tobytes(), ends.tobytes(), key_ends.tobytes(), *keys, *ids])


class Shard:
    """A shard's index over its bytes, which are not copied."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.n_keys, buckets, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        view, at = memoryview(data), HEAD.size
        parts = []
        for kind, count in (("<u4", buckets), ("<u4", 2 * self.n_keys), ("<u8", self.n), ("<u4", self.n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += count * int(kind[2])
        self.seeds, self.index, self.ends, key_ends = parts
        self.key_ends, self.keys = [0, *key_ends.tolist()], view[at:]
        self.payload = view[at + self.key_ends[-1] :]

    def key(self, document: int) -> bytes:
        return bytes(self.keys[self.key_ends[document] : self.key_ends[document + 1]])

    def find(self, key: bytes) -> range:
        """The places of the documents of a key in the shard: the first one in constant time, the others stand behind it."""
        return self.find_at(int(self.find_all([key])[0]) if self.n else -1)

    def find_at(self, first: int) -> range:
        last = first
        while 0 <= last < self.n and self.key(last) == self.key(first):
            last += 1
        return range(first, last)

    def find_all(self, keys: list[bytes]) -> np.ndarray:
        """The first places of several keys; -1 where a key isn't there, by its fingerprint or by the key that is stored."""
        hashed = [_hashed(k) for k in keys]
        h = np.array([x for x, _ in hashed], np.uint64)
        seeds = self.seeds[((h >> np.uint64(40)) % np.uint64(len(self.seeds))).astype(np.int64)]
        index = self.index.reshape(-1, 2)[np.minimum(_slots(h, seeds, self.n_keys), self.n_keys - 1)]
        found = np.where(index[:, 0] == np.array([f for _, f in hashed], np.uint32), index[:, 1].astype(np.int64), -1)
        return np.array([d if d >= 0 and self.key(d) == k else -1 for d, k in zip(found.tolist(), keys, strict=True)], np.int64)

    def start(self, document: int) -> int:
        return int(self.ends[document - 1]) if document else 0

    def ids(self, document: int) -> np.ndarray:
        return np.frombuffer(self.payload, f"<u{self.width}", int(self.ends[document]) - self.start(document), self.width * self.start(document))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode the texts and write them as shards to path, in ascending order of id_col, a null id last.

    Rows with one id are in the order of the text's hash, then the text; they share its key, and a null id's key is `null`.
    Null texts count as empty. A range sort by id and hash deals out the rows, so rows of one id are several tasks' work, if
    there are many, and each task holds one shard at a time. The directory is written to path with `-directory` behind it.
    """
    from_file = place(vocabulary)
    width = 2 if max(tokenizer(from_file).get_vocab_size(), (end_id or 0) + 1) <= 65536 else 4
    end = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = max(shuffle_partitions(docs.sparkSession), docs.sparkSession.sparkContext.defaultParallelism)
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key"), "text", "id")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(from_file, width)
        keys, ids, held, before, nth, part, first, last = [], [], 0, 0, 0, 0, None, None

        def closed() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), first, last, pa.array([pack(keys, ids, width)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "nth", "before", "n_ids", "first", "last", "data"])

        for batch in slices(batches, 2, RUN):
            part = batch.column(0)[0].as_py()
            for k, (key, got) in enumerate(zip(batch.column(1).to_pylist(), encoder.encode(batch.column(2).to_pylist()), strict=True)):
                last = batch.column(3).slice(k, 1)
                first = last if not keys else first
                keys.append(key.encode())
                ids.append(got + end)
                held += len(ids[-1]) // width
                if held >= shard_ids:
                    yield closed()
                    keys, ids, before, nth, held = [], [], before + held, nth + 1, 0
        if keys:
            yield closed()

    made = rows.mapInArrow(shards, f"part int, nth int, before long, n_ids long, first {kind}, last {kind}, data binary")
    made.write.option("compression", "zstd").parquet(path)
    files = docs.sparkSession.read.parquet(path).select("part", "nth", "first", "last", F.input_file_name().alias("file"))
    files.write.parquet(f"{path}-directory")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """(part, start): ids before each partition's first shard; the driver adds one number for each partition that was written."""
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, before = [], 0
    for part, n in totals:
        rows.append((part, before))
        before += n
    return shards.sparkSession.createDataFrame(rows, "part int, start long")


def read_documents(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, each found by its key through the index."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_buffer())
                keys = [shard.key(d) for d in range(shard.n)]
                found = [d for at in shard.find_all(list(dict.fromkeys(keys))).tolist() for d in shard.find_at(at)]
                if found != list(range(shard.n)):
                    raise ValueError("a key isn't where the index says")
                ids = [shard.ids(d) for d in found]
                columns = [pa.array([k.decode() for k in keys]), pa.array([before + shard.start(d) for d in found], pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(_starts(shards)), "part").select((F.col("start") + F.col("before")).alias("at"), "data")
    return placed.mapInArrow(documents, "key string, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """(key, ids) of every document with one of the ids, None among them; the directory names the files, each shard there is asked through its index."""
    wanted = ["null".encode() if k is None else str(k).encode() for k in keys]
    directory = spark.read.parquet(f"{path}-directory")
    asked = spark.createDataFrame([(k,) for k in keys], f"asked {directory.schema['first'].dataType.simpleString()}")
    # Nulls are last: a shard with any ends with one.
    meets = F.when(F.col("asked").isNull(), F.col("last").isNull()).otherwise((F.col("first") <= F.col("asked")) & (F.col("last").isNull() | (F.col("last") >= F.col("asked"))))
    files = [r["file"] for r in directory.join(F.broadcast(asked), meets).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "key string, ids array<long>")
    shards = spark.read.parquet(*files)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_buffer())
                hits = [(k, d) for k in wanted for d in shard.find(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in hits], pa.string()), pa.array([shard.ids(d).tolist() for _, d in hits], pa.list_(pa.int64()))], ["key", "ids"])

    return shards.select("data").mapInArrow(found, "key string, ids array<long>")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share; whoever asks for it clears it away."""
    return f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    back = read_documents(read_shards(spark, path))
    return back.select(F.col("key").try_cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op9_token_output": (op9_token_output, None)}
