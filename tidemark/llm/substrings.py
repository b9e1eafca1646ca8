"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words, and every rolling window of ``block`` words probes them. A
repeat of ``window`` >= 2 * block - 1 words always holds a whole reference block of the place it repeats, so a window without a hit is no repeat. Where
probes hit, the hits are extended: all windows of ``window`` words around a hit are compared, by their place in the corpus, and overlapping repeats
merge into maximal exact ones. A word goes if it is in any window whose words also start earlier (at a smaller id, or earlier in the same document).

Blocks and probes travel as packed fingerprints (tidemark.llm.recurring); an anchor is a fingerprint that a reference block and another
place share. Of the windows around anchors every chunk sends the earliest place of each distinct one, with 96 bits of hash, and learns whether an earlier
place exists elsewhere. So a passage of a third of all documents is one entry for each chunk.

Words are runs of anything but ASCII white space, unchanged. Defined results: a null or empty text has no words; a null id comes after all others; rows that share
an id are places of one document and are compared by their start alone, so that a repeated row is not its own copy; texts of any length are taken whole, in a chunk of their own if need be; an empty table gives an empty
result; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import recurring as R
from tidemark.llm.shared import written

_LAST = np.iinfo(np.int64).max
_LOOK = np.uint64(0xA24BAED4963EE407)
PLACES = "bucket int, chunk long, hashes binary, checks binary, docs binary, starts binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<long>"


class Words:
    """The words of a chunk's documents, one after the other, with their hashes."""

    def __init__(self, blob: bytes, known: R.WordHashes):
        chunk = R.open_chunk(blob)
        self.ids = chunk.ids
        self.words = [t.split() for t in chunk.texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = np.fromiter((known[w] for ws in self.words for w in ws), np.uint64, int(self.first[-1]))
        self.start = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - self.start
        self.doc = np.repeat(np.array([_LAST if i is None else i for i in self.ids], np.int64), self.sizes)

    def places(self, n: int) -> np.ndarray:
        """Where windows of n words start that don't run over a document's end."""
        return np.flatnonzero(self.left >= n)

    def windows(self, n: int) -> np.ndarray:
        return R.rolling(self.hashes, n)


def _probes(words: Words, block: int, layout: R.Layout) -> tuple[np.ndarray, R.Sent, np.ndarray, np.ndarray]:
    """Places of the rolling windows, what is sent of them, a byte for each (bit 0: more than one place, bit 1: a reference block), and the way back."""
    at = words.places(block)
    sent, n, back = R.distinct(words.windows(block)[at], layout)
    reference = np.bincount(back, words.start[at] % block == 0, len(n)) > 0
    return at, sent, (n > 1) + 2 * reference, back


def _anchors(which: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    """1 where a reference block's fingerprint has another place too."""
    several = (np.bincount(which, minlength=n) > 1) | (np.bincount(which, extra & 1, n) > 0)
    return (several & (np.bincount(which, extra >> 1, n) > 0)).astype(np.uint8)


def _merged(which: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    """The byte of _probes for several entries of one fingerprint."""
    several = (np.bincount(which, minlength=n) > 1) | (np.bincount(which, extra & 1, n) > 0)
    return (several + 2 * (np.bincount(which, extra >> 1, n) > 0)).astype(np.uint8)


def _candidates(words: Words, answer: pa.Table, block: int, window: int, layout: R.Layout) -> np.ndarray:
    """Where windows start that hold a hit."""
    at, sent, _, back = _probes(words, block, layout)
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    hit[at] = R.answer_array(answer, sent.keys)[back] if len(at) else 0
    before = np.concatenate([[0], np.cumsum(hit)])
    places = words.places(window)
    return places[before[places + window - block + 1] > before[places]]


def _earliest(words: Words, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows at these places: hash and check hash of each distinct one, its earliest place, and the way back from all places."""
    h = words.windows(window)[places]
    check = R.rolling(R.mixed(words.hashes, _LOOK), window, _LOOK)[places] >> np.uint64(32)
    order = np.lexsort((words.start[places], words.doc[places], check, h))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    first = order[new]
    return h[first], check[first].astype(np.uint32), first, back


@dataclass
class Entries:
    """Distinct windows with 96 bits of hash and a place each, in the order in which they are sent: by bucket, then as they came."""

    h: np.ndarray
    check: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    order: np.ndarray
    bucket: np.ndarray  # of each, in that order

    @staticmethod
    def of(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int) -> Entries:
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return Entries(h[order], check[order], doc[order], start[order].astype(np.uint32), order, bucket[order])

    def rows(self, chunk: int, first: int, last: int, width: int) -> list[tuple]:
        """A row for each group of buckets that has entries, under the first bucket that has."""
        cuts = np.searchsorted(self.bucket, np.append(np.arange(first, last, width), last))
        return [(int(self.bucket[s]), chunk, *(R.squeeze(a[s:e]) for a in (self.h, self.check, self.doc, self.start))) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if e > s]


_PLACE_TYPES = (pa.int32(), pa.int64(), *(pa.binary(),) * 4)


def _opened(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(h, check, doc, start) of all rows' entries, and where each row's end."""
    arrays = [[R.unsqueeze(x.as_py(), t) for x in rows[c]] for c, t in (("hashes", np.uint64), ("checks", np.uint32), ("docs", np.int64), ("starts", np.uint32))]
    return *(np.concatenate(a) for a in arrays), np.cumsum([len(x) for x in arrays[0]])


def _first_places(h: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry with the earliest place of each window, and for each entry which window it is."""
    order = np.lexsort((start, doc, check, h))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(check[order]) != 0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _compared(places: DataFrame) -> DataFrame:
    """R.ANSWER to rows of single buckets: 1 for each entry that has an earlier place elsewhere."""

    def run(rows: pa.Table) -> pa.Table:
        h, check, doc, start, ends = _opened(rows)
        first, which = _first_places(h, check, doc, start)
        later = ((doc != doc[first][which]) | (start != start[first][which])).astype(np.uint8)
        return pa.table({"bucket": rows["bucket"], "chunk": rows["chunk"], "answer": pa.array([R.squeeze(p) for p in np.split(later, ends[:-1])], pa.binary())})

    return places.groupBy("bucket").applyInArrow(run, R.ANSWER)


def _earlier_places(places: DataFrame, layout: R.Layout) -> DataFrame:
    """R.ANSWER to all rows of PLACES; of large corpora by groups and slabs, as in tidemark.llm.recurring."""
    if not layout.slabs:
        return _compared(places)
    group, slab = F.floor(F.col("bucket") / layout.width).cast("int").alias("grp"), F.pmod(F.xxhash64("chunk"), F.lit(layout.slabs)).cast("long").alias("slab")
    dealt, at = written(places.select(group, slab, "*"), "dealt-places"), ["grp", "slab"]

    def merged(rows: pa.Table) -> tuple:
        h, check, doc, start, ends = _opened(rows)
        first, which = _first_places(h, check, doc, start)
        return doc, start, ends, first, which, Entries.of(h[first], check[first], doc[first], start[first], layout.buckets)

    def gather(rows: pa.Table) -> pa.Table:
        begin = rows["grp"][0].as_py() * layout.width
        return R._table(merged(rows)[-1].rows(rows["slab"][0].as_py(), begin, begin + layout.width, 1), _PLACE_TYPES, PLACES)

    told = _compared(dealt.groupBy(*at).applyInArrow(gather, PLACES))
    told = told.select(F.floor(F.col("bucket") / layout.width).cast("int").alias("grp"), F.col("chunk").alias("slab"), "bucket", "answer")

    def spread(rows: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            doc, start, ends, first, which, entries = merged(rows)
            answer = np.empty(len(first), np.uint8)
            answer[entries.order] = R.answer_array(back, entries.h)
            # an entry has an earlier place if it isn't its slab's first, or if that one has
            later = (answer[which] > 0) | (doc != doc[first][which]) | (start != start[first][which])
            out = [(b, c, R.squeeze(p)) for b, c, p in zip(rows["bucket"].to_pylist(), rows["chunk"].to_pylist(), np.split(later.astype(np.uint8), ends[:-1]))]
        return R._table(out, (pa.int32(), pa.int64(), pa.binary()), R.ANSWER)

    return dealt.groupBy(*at).cogroup(told.groupBy(*at)).applyInArrow(spread, R.ANSWER)


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 10, with_text: bool = True, layout: R.Layout | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, removed): removed has start and end of each maximal repeat, in words."""
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("window must be at least 2 * block - 1: otherwise a repeat can miss every reference block")
    layout = layout or R.Layout.of(docs)
    chunks = R.chunks_of(docs, layout.chunk_bytes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = R.WordHashes()
        for batch in batches:
            for key, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                _, sent, extra, _ = _probes(Words(blob.as_py(), known), block, layout)
                yield from R.send(key, sent, extra)

    anchors = written(R.answers(chunks.mapInArrow(probe, R.SENT), _anchors, _merged, layout), "anchors")

    def entries(words: Words, places: np.ndarray) -> tuple[Entries, np.ndarray, np.ndarray]:
        h, check, first, back = _earliest(words, places, window)
        return Entries.of(h, check, words.doc[places[first]], words.start[places[first]], layout.buckets), first, back

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, known = [], R.WordHashes()
        for key, blob in zip(left["chunk"].to_pylist(), left["blob"]):
            words = Words(blob.as_py(), known)
            rows += entries(words, _candidates(words, right, block, window, layout))[0].rows(key, 0, layout.buckets, layout.width)
        return R._table(rows, _PLACE_TYPES, PLACES)

    places = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, PLACES)
    known_later = _earlier_places(places, layout)
    # Both answers go to a chunk together: the anchors say which windows it asked about, in the order of its question.
    both = anchors.selectExpr("chunk", "bucket", "answer", "0 as asked").union(known_later.selectExpr("chunk", "bucket", "answer", "1 as asked"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked = right["asked"].to_numpy(zero_copy_only=False) if len(right) else np.zeros(0, np.int64)
        told = [right.filter(pa.array(asked == k)) for k in (0, 1)]
        for blob in left["blob"]:
            words = Words(blob.as_py(), R.WordHashes())
            at = _candidates(words, told[0], block, window, layout)
            asked_of, first, back = entries(words, at)
            later = np.zeros(len(first), bool)
            later[asked_of.order] = R.answer_array(told[1], asked_of.h) > 0
            # the earliest place of the chunk is a repeat if the corpus has an earlier one; all other places of the chunk are repeats
            doc, start = words.doc[at], words.start[at]
            repeat = later[back] | (doc != doc[first][back]) | (start != start[first][back]) if len(at) else np.zeros(0, bool)
            covered = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(covered, at[repeat], 1)
            np.add.at(covered, at[repeat] + window, -1)
            gone = np.cumsum(covered[:-1]) > 0
            for k, doc_id in enumerate(words.ids):
                s, e = words.first[k], words.first[k + 1]
                out_of = gone[s:e]
                n = int(out_of.sum())
                kept = b" ".join(words.words[k] if not n else [w for w, g in zip(words.words[k], out_of.tolist()) if not g])
                runs = np.flatnonzero(np.diff(out_of, prepend=False, append=False)).tolist() if n else []
                out.append((doc_id, int(e - s), n, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, runs))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, types)], [x.split()[0] for x in KEPT.split(", ")])

    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, KEPT)
