"""Alignment of two tokenizers by segment deduplication: texts are cut where neither vocabulary can merge across, each distinct segment is tokenized and aligned once.

A cut is made before a run of white space whose first character no token of either vocabulary has behind another kind of character; that is read off both vocabularies when they are
loaded (``Pair.cuts``), so for another pair of files the cuts follow. Byte-pair merges make nothing but tokens of the vocabulary, so no merge crosses such a place, and the ids of a
text are those of its segments, one after the other.

Documents are gathered into chunks (a Parquet table): a chunk has a dictionary of its distinct segments and each document as numbers into it. The dictionaries of all chunks, a row for each
segment, are dealt by segment and sorted, so that equal ones meet and are aligned once; the alignments go back to their chunks, where documents are composed of them.
Each chunk tells once in how many of its documents an id pair is linked; the sums over the corpus go back to the chunks by the pairs that occur there. A frequent segment or pair
is a row for each chunk, not for each occurrence. The driver gets nothing.

Defined results: null and empty texts have no tokens (zeros, empty groups); so have texts that one of the two doesn't give back byte by byte; null ids and repeated rows are rows like any other, and count as
documents of their own; a text of any length is composed whole, in the chunk that it begins or ends; links of equal count are all best; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, parts_for, scratch_path, text_bytes, written

#: White space of Unicode, and the four separators that some libraries count as such.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "\u2581"
CHUNK_BYTES = 10 << 20
BATCH = 4096
#: Documents of a chunk that are composed at a time.
SPAN = 256


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Byte-level BPE (A) and sentencepiece (B), with the bytes of their tokens and the places where texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        import re

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        of, n = byte_alphabet(), self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = [bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_space = self.b.piece_to_id(SPACE)
        white, real = re.compile(f"[{WHITE}]"), [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        behind = {c for t in [*(x.decode(errors="replace") for x in self.a_bytes), *real] for before, c in zip(t, t[1:]) if white.match(c) and not white.match(before)}
        # before one that isn't a blank, B would put its own blank: no piece may hold both
        after_blank = {c for p in real for before, c in zip(p, p[1:]) if before == " " and c != " "}
        self.cuts = "".join(c for c in " \n\t\x0b\x0c\r" if c not in behind and c not in after_blank and (c != " " or self.b_space != self.b.unk_id()))
        w, c = WHITE + SPACE, self.cuts  # to B its sign for a blank is one in the text too
        self.segments = re.compile(f"[{c}][{w}]*[^{w}]*(?:(?![{c}])[{w}]+[^{w}]*)*", re.S).findall if " " in c else lambda text: [text]

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments that begin with white space: B puts a blank before each text, which is a segment's own blank or goes."""
        blank = [s[0] == " " for s in segments]
        out = self.b.encode([s[1:] if own else s for s, own in zip(segments, blank)], num_threads=1)
        return [ids or [self.b_space] if own else ids[1:] for ids, own in zip(out, blank)]

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each segment, codes of all tokens, in order): by groups, in a group A's tokens before B's. 0 tokens: the segment doesn't come back byte by byte."""
        a_ids, b_ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b_ids(segments)
        for k, s in enumerate(segments):
            raw = s.encode()
            if b"".join(map(self.b_bytes.__getitem__, b_ids[k])) != raw or b"".join(map(self.a_bytes.__getitem__, a_ids[k])) != raw:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter((i for ids in x for i in ids), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        # all segments together are one line of bytes, which the tokens of either kind tile
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        codes = np.concatenate([a << 2, b << 2 | 2 | np.isin(b_end, cuts, assume_unique=True)])
        groups = np.searchsorted(cuts, np.concatenate([a_end, b_end]), "left")
        return n_a + n_b, codes[np.argsort(groups, kind="stable")].astype(np.uint32)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of each A token, the links as a << 32 | b) of tokens that tile one line of bytes: what overlaps is linked."""
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        low, high = np.searchsorted(b_end, a_end - self.a_len[a], "right"), np.searchsorted(b_end, a_end, "left")
        many = high - low + 1
        return many, np.repeat(a, many) << 32 | b[_flat(low, many)]


def _flat(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many of each."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


@functools.cache
def tokenizer_pair(a_path: str | None = None, b_path: str | None = None) -> Pair:
    """Loaded once in a worker, for all its tasks."""
    if a_path and b_path:
        return Pair(a_path, b_path)
    import public_tokenizers

    return Pair(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**31, their bytes by significance: the higher ones are mostly alike."""
    import zstandard

    planes = np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _opened(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


CHUNKS = "chunk long, doc_ids array<long>, lengths array<int>, numbers binary, segments array<string>"


def _chunked(batches: Iterator[pa.RecordBatch], part: int, pair: Pair, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    from array import array

    made, size, ids, lengths, numbers, known = 0, 0, [], [], array("i"), {}

    def chunk() -> pa.RecordBatch:
        row = {"chunk": part << 16 | made, "doc_ids": ids, "lengths": lengths, "numbers": _squeezed(np.frombuffer(numbers, "i4")), "segments": list(known)}
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            found = pair.segments(f" {t}") if (t := text.as_py()) else []
            numbers.extend([known.setdefault(s, len(known)) for s in found])
            ids.append(doc_id)
            lengths.append(len(found))
            size += len(t or "")
            if size >= chunk_bytes:
                yield chunk()
                made, size, ids, lengths, numbers, known = made + 1, 0, [], [], array("i"), {}
    if ids:
        yield chunk()


ALIGNED = "chunk long, numbers binary, lengths binary, codes binary"
#: A chunk's number of a segment is that many bits of a place.
NUMBER_BITS = 24
#: Rows whose alignments go back to their chunks together.
SENT = 1 << 16


def _aligned(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment: each distinct one is aligned once, and one that goes on in the next batch isn't again. What goes to one chunk from SENT rows is one row."""
    text, last, held, n = None, (np.zeros(1, np.int64), np.zeros(0, np.uint32)), [], 0
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch[at : at + BATCH]
            seen = part["segment"]
            new = np.concatenate([[seen[0].as_py() != text], pc.not_equal(seen[1:], seen[:-1]).to_numpy(zero_copy_only=False)])
            fresh = seen.filter(pa.array(new)).to_pylist()
            lengths, codes = pair.align(fresh) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
            if not new[0]:
                lengths, codes = np.concatenate([last[0], lengths]), np.concatenate([last[1], codes])
            text, last = seen[-1].as_py(), (lengths[-1:], codes[len(codes) - lengths[-1] :])
            which = np.cumsum(new) - new[0]
            own = lengths[which]
            place = part["place"].to_numpy()
            held.append((place >> NUMBER_BITS, place & (1 << NUMBER_BITS) - 1, own, codes[_flat((np.cumsum(lengths) - lengths)[which], own)]))
            n += len(part)
            if n >= SENT:
                yield _sent(held)
                held, n = [], 0
    if held:
        yield _sent(held)


def _sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    chunk, number, lengths, codes = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(chunk, kind="stable")
    codes = codes[_flat((np.cumsum(lengths) - lengths)[order], lengths[order])]
    chunk, number, lengths = chunk[order], number[order].astype("<i4"), lengths[order].astype("<i4")
    cuts = np.append(np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)), len(chunk))
    ends = np.concatenate([[0], np.cumsum(lengths)])[cuts]
    blobs = [[x[p:q].tobytes() for p, q in zip(at[:-1].tolist(), at[1:].tolist())] for x, at in ((number, cuts), (lengths, cuts), (codes, ends))]
    return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], ["chunk", "numbers", "lengths", "codes"])


COMPOSED = "chunk long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, pair_docs array<int>, lengths binary, held binary, times binary"


def _doc_pairs(docs: np.ndarray, numbers: np.ndarray, start: np.ndarray, many: np.ndarray, links: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, how many times), by document and pair, from each document's segments."""
    both, times = np.unique(docs * len(start) + numbers, return_counts=True)
    doc, seg = np.divmod(both, max(1, len(start)))
    n = many[seg]
    at = _flat(start[seg], n)
    both, which = np.unique(np.repeat(doc, n) * n_pairs + links[at], return_inverse=True)
    return *np.divmod(both, max(1, n_pairs)), np.bincount(which, np.repeat(times, n), len(both)).astype(np.int64)


def _group_texts(kind: np.ndarray, last: np.ndarray, ids: np.ndarray, stops: np.ndarray, step: int = 1 << 15) -> list[str]:
    """The segments' groups, each with its sign behind it: `a1,a2|b1;`. So many segments at a time."""
    signs, out = np.where(last, 2, (kind == 0) & (np.append(kind[1:], 1) == 1)).astype(np.int8), []
    for k in range(0, len(stops), step):
        ends = stops[k : k + step]
        first = int(stops[k - 1]) if k else 0
        tokens = [f"{i}{',|;'[s]}" for i, s in zip(ids[first : ends[-1]].tolist(), signs[first : ends[-1]].tolist())]
        ends = (ends - first).tolist()
        out += ["".join(tokens[p:q]) for p, q in zip([0, *ends[:-1]], ends)]
    return out


def _compose(chunk: pa.Table, aligned: pa.Table, pair: Pair, with_groups: bool) -> pa.Table:
    joined = lambda c, kind: np.frombuffer(b"".join(x for part in aligned[c].chunks for x in part.to_pylist()), kind)
    order, sizes, codes = np.argsort(joined("numbers", "<i4")), joined("lengths", "<i4").astype(np.int64), joined("codes", "<u4")
    codes = codes[_flat((np.cumsum(sizes) - sizes)[order], sizes[order])]
    sizes = sizes[order]
    of, token = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    kind, last, tokens = codes >> 1 & 1, codes & 1, (codes >> 2).astype(np.int64)
    count = lambda which: np.bincount(token[which], minlength=len(sizes))
    ok, n_a, n_b, n_groups = (sizes > 0).astype(np.int64), count(kind == 0), count(kind == 1), count(last == 1)
    groups = _group_texts(kind, last, tokens, of)
    many, links = pair.links(tokens[kind == 0], tokens[kind == 1])
    many = np.bincount(token[kind == 0], many, len(sizes)).astype(np.int64)
    pairs, links = np.unique(links, return_inverse=True)
    start = np.cumsum(many) - many
    name, ids = chunk["chunk"][0].as_py(), chunk["doc_ids"][0].as_py()
    lengths, numbers = np.array(chunk["lengths"][0].as_py(), np.int64), _opened(chunk["numbers"][0].as_py())
    stops, parts, texts, shas = np.cumsum(lengths), [], [], []
    for first in range(0, len(ids), SPAN):
        own = lengths[first : first + SPAN]
        seen, ends = numbers[stops[first] - own[0] : stops[min(first + SPAN, len(ids)) - 1]], np.cumsum(own)
        total = lambda x, seen=seen, ends=ends: np.diff(np.concatenate([[0], np.cumsum(x[seen])])[np.concatenate([[0], ends])])
        whole = (total(1 - ok) == 0) & (own > 0)
        kept = np.repeat(whole, own)
        parts.append([*(np.where(whole, total(x), 0) for x in (n_a, n_b, n_groups, many)), *_doc_pairs(np.repeat(np.arange(first, first + len(own)), own)[kept], seen[kept], start, many, links, len(pairs))])
        for good, stop, n in zip(whole.tolist(), ends.tolist(), own.tolist()):
            text = "".join(map(groups.__getitem__, seen[stop - n : stop].tolist()))[:-1] if good else ""
            shas.append(hashlib.sha256(text.encode()).hexdigest() if good else "")
            if with_groups:
                texts.append(text)
    *sums, doc, held, times = (np.concatenate(x) for x in zip(*parts))
    sums = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums))
    n_docs = np.bincount(held, minlength=len(pairs))
    steps, n = np.diff(held, prepend=0), len(ids)
    empty = lambda kind: pa.nulls(n, kind)
    long, blob = pa.int64(), pa.binary()
    rows = {"chunk": pa.repeat(pa.scalar(name, long), n), "number": pa.array(np.arange(n), pa.int32()), "doc_id": pa.array(ids, long)} | {k: pa.array(v, long) for k, v in sums.items()}
    rows |= {"groups_sha256": pa.array(shas, pa.string()), "groups": pa.array(texts, pa.string()) if with_groups else empty(pa.string())}
    rows |= {"pairs": empty(pa.list_(long)), "pair_docs": empty(pa.list_(pa.int32())), "lengths": empty(blob), "held": empty(blob), "times": empty(blob)}
    blobs = (_squeezed(x) for x in (np.bincount(doc, minlength=n), steps, times))
    pa.default_memory_pool().release_unused()
    one = [pa.array([name], long), *(pa.nulls(1, c.type) for c in list(rows.values())[1:9]), pa.array([pairs], pa.list_(long)), pa.array([n_docs], pa.list_(pa.int32())), *(pa.array([b], blob) for b in blobs)]
    return pa.concat_tables([pa.table(rows), pa.table(one, list(rows))])


def _scored(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """(chunk, number, n_best, count_sum) from what a chunk's documents hold and the corpus-wide counts of its pairs."""
    order = np.argsort(counts["at"].to_numpy())
    n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
    lengths, pair, times = (_opened(chunk[c][0].as_py()).astype(np.int64) for c in ("lengths", "held", "times"))
    pair = np.cumsum(pair)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(lengths)])])
    return pa.table({"chunk": pa.repeat(chunk["chunk"][0], len(lengths)), "number": pa.array(np.arange(len(lengths)), pa.int32()), "n_best": total(times * best[pair]), "count_sum": total(times * n[pair])})


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, chunk_bytes: int = CHUNK_BYTES, with_groups: bool = True) -> DataFrame:
    """A row for each document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups)."""
    spark = docs.sparkSession

    def cut(batches):
        from pyspark import TaskContext

        return _chunked(batches, TaskContext.get().partitionId(), tokenizer_pair(a_path, b_path), chunk_bytes)

    def settle(batches):
        return _aligned(batches, tokenizer_pair(a_path, b_path))

    def compose(chunk: pa.Table, aligned: pa.Table) -> pa.Table:
        return _compose(chunk, aligned, tokenizer_pair(a_path, b_path), with_groups)

    n_parts = parts_for(spark, text_bytes(docs, text_col))
    chunks_at = scratch_path(spark, "chunks")
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, CHUNKS).write.option("compression", "zstd").parquet(chunks_at)
    chunks = spark.read.schema(CHUNKS).parquet(chunks_at)
    segments = chunks.select("chunk", F.posexplode("segments").alias("number", "segment")).select((F.shiftleft("chunk", NUMBER_BITS) + F.col("number")).alias("place"), "segment")
    aligned = segments.repartition(n_parts, "segment").sortWithinPartitions("segment").mapInArrow(settle, ALIGNED)
    composed = written(chunks.drop("segments").groupBy("chunk").cogroup(aligned.groupBy("chunk")).applyInArrow(compose, COMPOSED), "composed")
    discard(spark, chunks_at)
    told = composed.where("pairs is not null")
    sums = told.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("n"))
    counts = sums.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", 32))))
    asked = told.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select("of", "at", "n", "best")
    scored = told.select("chunk", "lengths", "held", "times").groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(_scored, "chunk long, number int, n_best long, count_sum long")
    rows = composed.where("pairs is null").join(scored, ["chunk", "number"], "left")
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256", *(["groups"] if with_groups else []))
