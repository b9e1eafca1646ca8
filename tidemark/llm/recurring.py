"""Which features (hashed word windows) of a corpus recur, found without moving a row for each feature.

Documents are first written as chunks of a few MB each, so that work on a chunk gives the same result whenever it is repeated. Each chunk sends its
distinct features once, as blobs of packed 32-bit fingerprints, to buckets by hash. A bucket adds up what all chunks sent and answers each chunk
with one byte per feature, in the order in which that chunk sent them; the chunk, read again, makes the same features and puts the answers to them. A
feature of a third of all rows is one entry for each chunk, so no bucket has more entries than chunks times its distinct features; the number of
buckets grows with the corpus.

Of large corpora a chunk sends a row for each group of buckets, groups and slabs of chunks meet in one task each, which merges what its chunks sent and passes it on, a row for each
bucket, and answers go the same way back. So there is no row for each chunk and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_bytes, written

#: Of a corpus of up to 1 GB: text of a chunk; fingerprints of a bucket, if every byte of text made half a byte of them.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: A chunk's number is its partition and its place in it, a document's that and its place in the chunk: 25 bits are left for partitions.
SEQUENCE_BITS, ROW_BITS = 18, 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words; starts anew when it holds 300,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray, odd: np.uint64 = _ODD2) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * odd
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, n: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """A hash of every n consecutive word hashes; len(words) - n + 1 of them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * odd + words[j : len(words) - n + 1 + j]
    return mixed(out)


@dataclass
class Chunk:
    ids: list[int | None]
    texts: list[bytes]


def pack_chunk(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = np.array([len(ids)], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def open_chunk(blob: bytes) -> Chunk:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    empty, ids, sizes = np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, "<i8", n, 8 + n), np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    at, texts = 8 + 17 * n, []
    for s in sizes.tolist():
        texts.append(raw[at : at + s])
        at += s
    return Chunk([None if e else i for e, i in zip(empty.tolist(), ids.tolist())], texts)


#: Rows of one exchange beyond which there are two; keys that a task of a group and a slab holds, about.
MOST_ROWS, SLAB_KEYS = 40_000_000, 16 << 20


@dataclass
class Layout:
    """Sizes of chunks, number of buckets, and for large corpora how many buckets make a group (width) and into how many slabs chunks are dealt.

    Were chunks and buckets both of a fixed size, the rows between them would grow with the square of the corpus; so from 1 GB on both grow with its square root, up to 32 times,
    which is as much as a task holds: rows grow in proportion. That ends at 1 TB with 4e7 rows. From there on chunks and buckets meet by way of groups and
    slabs: the rows of both exchanges together are about 2e9 at 100 TB, where one exchange would have 3e11; they grow with the power 1.5.
    """

    chunk_bytes: int
    buckets: int
    width: int = 1
    slabs: int = 0  # 0: one exchange

    @staticmethod
    def of(docs: DataFrame) -> Layout:
        return Layout.sized(text_bytes(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @staticmethod
    def sized(n: int, least_buckets: int = 1) -> Layout:
        grown = min(32.0, max(1.0, (n / 2**30) ** 0.5))
        chunk, buckets = int(CHUNK_BYTES * grown), max(least_buckets, math.ceil(n / 2 / int(BUCKET_BYTES * grown)))
        chunks = math.ceil(n / chunk)
        if chunks * buckets <= MOST_ROWS:
            return Layout(chunk, buckets)
        # a group has width of a chunk's buckets, a slab as many chunks: width * width * (keys of a chunk and bucket) in a task
        width = max(2, int((SLAB_KEYS / max(1.0, chunk / 2 / buckets)) ** 0.5))
        return Layout(chunk, buckets, min(width, buckets), max(1, math.ceil(chunks / width)))

    def rows(self, n: int) -> int:
        """Rows that the exchanges of a corpus of n bytes have, at most."""
        chunks = math.ceil(n / self.chunk_bytes)
        return chunks * self.buckets if not self.slabs else chunks * math.ceil(self.buckets / self.width) + self.slabs * self.buckets


def chunks_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, blob) of all documents (doc_id, text), written; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n, at = [], [], 0, (TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                b = (t.as_py() or "").encode()
                ids.append(i)
                texts.append(b)
                n += len(b) + 16
                if n >= chunk_bytes or len(ids) == 1 << ROW_BITS:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "blob": pa.array([pack_chunk(ids, texts)], pa.binary())})
                    ids, texts, n, at = [], [], 0, at + 1
                    if not at % (1 << SEQUENCE_BITS):
                        raise ValueError("more chunks in a partition than their numbers have room for: read documents in smaller partitions")
        if ids:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int64()), "blob": pa.array([pack_chunk(ids, texts)], pa.binary())})

    spark = docs.sparkSession
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, blob binary"), "chunks")


def squeeze(a: np.ndarray) -> bytes:
    """Numbers by their bytes' places, so that the zero bytes of small ones compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")


def unsqueeze(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


@dataclass
class Sent:
    """A chunk's distinct features as keys (bucket, then fingerprint) in the order in which they are sent, and where the keys of each group of buckets begin."""

    keys: np.ndarray
    start: np.ndarray


def _key(features: np.ndarray, buckets: int) -> np.ndarray:
    return (features >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | features & np.uint64(0xFFFFFFFF)


def _starts(keys: np.ndarray, first: int, last: int, width: int = 1) -> np.ndarray:
    """Where the keys of the buckets first, first + width, ... begin, and where those of the last end."""
    return np.searchsorted(keys >> np.uint64(32), np.append(np.arange(first, last, width), last).astype(np.uint64))


def distinct(features: np.ndarray, layout: Layout) -> tuple[Sent, np.ndarray, np.ndarray]:
    """What to send of these features, how many of them each stands for, and where each feature is among those sent."""
    keys, back, n = np.unique(_key(features, layout.buckets), return_inverse=True, return_counts=True)
    return Sent(keys, _starts(keys, 0, layout.buckets, layout.width)), n, back


def _packed(keys: np.ndarray) -> bytes:
    """Keys of a bucket or group, as differences."""
    return squeeze(np.diff(keys, prepend=keys[0] >> np.uint64(32) << np.uint64(32)) if len(keys) else keys)


def _unpacked(blob: bytes, bucket: int) -> np.ndarray:
    """The keys again; bucket: the one of the first key."""
    return np.cumsum(unsqueeze(blob, np.uint64), dtype=np.uint64) + (np.uint64(bucket) << np.uint64(32))


SENT = "bucket int, chunk long, fingers binary, extra binary"
ANSWER = "bucket int, chunk long, answer binary"
_SENT_TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _sent_rows(chunk: int, keys: np.ndarray, start: np.ndarray, extra: np.ndarray) -> list[tuple]:
    """A row for each group that has keys, under the number of the first bucket that has."""
    return [(int(keys[s] >> np.uint64(32)), chunk, _packed(keys[s:e]), squeeze(extra[s:e].astype(np.uint8))) for s, e in zip(start[:-1].tolist(), start[1:].tolist()) if e > s]


def _table(rows: list[tuple], types: tuple, schema: str) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * len(types), types)], [x.split()[0] for x in schema.split(", ")])


def send(chunk: int, sent: Sent, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group of buckets: the fingerprints as differences, and a byte for each."""
    yield from _table(_sent_rows(chunk, sent.keys, sent.start, extra), _SENT_TYPES, SENT).to_batches()


Decide = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def _decided(sent: DataFrame, decide: Decide) -> DataFrame:
    """ANSWER to rows of single buckets."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [_unpacked(x.as_py(), b) for x, b in zip(rows["fingers"], rows["bucket"].to_pylist())]
        extra = np.concatenate([unsqueeze(x.as_py(), np.uint8) for x in rows["extra"]])
        values, which = np.unique(np.concatenate(keys), return_inverse=True)
        out = decide(which, extra, len(values))[which]
        ends = np.cumsum([len(k) for k in keys])
        parts = [squeeze(out[e - len(k) : e]) for k, e in zip(keys, ends)]
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "answer": pa.array(parts, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def answers(sent: DataFrame, decide: Decide, merge: Decide, layout: Layout) -> DataFrame:
    """ANSWER to all rows of SENT. decide(which, extra, n): the byte for each of n distinct fingerprints, from all entries of a bucket, of which which says whose they are; merge: the
    byte that stands for several entries in another decision."""
    if not layout.slabs:
        return _decided(sent, decide)
    group, slab = F.floor(F.col("bucket") / layout.width).cast("int").alias("grp"), F.pmod(F.xxhash64("chunk"), F.lit(layout.slabs)).cast("long").alias("slab")
    dealt = written(sent.select(group, slab, "*"), "dealt")
    at = ["grp", "slab"]

    def union(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The keys of each chunk, all of them once, and the bytes and places of the entries."""
        keys = [_unpacked(x.as_py(), b) for x, b in zip(rows["fingers"], rows["bucket"].to_pylist())]
        values, which = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, values, which, np.concatenate([unsqueeze(x.as_py(), np.uint8) for x in rows["extra"]])

    def gather(rows: pa.Table) -> pa.Table:
        _, values, which, extra = union(rows)
        first = rows["grp"][0].as_py() * layout.width
        return _table(_sent_rows(rows["slab"][0].as_py(), values, _starts(values, first, first + layout.width), merge(which, extra, len(values))), _SENT_TYPES, SENT)

    told = _decided(dealt.groupBy(*at).applyInArrow(gather, SENT), decide)
    told = told.select(F.floor(F.col("bucket") / layout.width).cast("int").alias("grp"), F.col("chunk").alias("slab"), "bucket", "answer")

    def spread(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], (pa.int32(), pa.int64(), pa.binary()), ANSWER)
        keys, values, which, _ = union(rows)
        answer, ends = answer_array(back, values)[which], np.cumsum([len(k) for k in keys])
        return _table([(b, c, squeeze(answer[e - len(k) : e])) for b, c, k, e in zip(rows["bucket"].to_pylist(), rows["chunk"].to_pylist(), keys, ends)], (pa.int32(), pa.int64(), pa.binary()), ANSWER)

    return dealt.groupBy(*at).cogroup(told.groupBy(*at)).applyInArrow(spread, ANSWER)


def answer_array(rows: pa.Table, keys: np.ndarray) -> np.ndarray:
    """All answers to sorted keys, in their order. Rows go by the bucket of their first key."""
    if not rows.num_rows:
        return np.zeros(len(keys), np.uint8)
    out = [unsqueeze(blob.as_py(), np.uint8) for _, blob in sorted(zip(rows["bucket"].to_pylist(), rows["answer"]), key=lambda x: x[0])]
    return np.concatenate(out)
