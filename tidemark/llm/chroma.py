"""Chroma audio fingerprints for media columns: find recordings that hold the same audio, and how they align.

Audio (16-bit mono samples) becomes frames of energy by pitch class. Filters that compare rectangles of frames and pitch classes, by
an integral image, give two bits each; sixteen of them are one packed 32-bit number for each frame. Frames and image are made for many recordings at once; energies are
whole numbers, so that a fingerprint doesn't depend on what stands beside it. Recordings with equal fingerprints form a
class, named by the digest of the fingerprint. Two classes are compared at every offset at which a number of one is within two bits of a number of the other: numbers of the
queries are looked up with each of their bits flipped, and so are those of the classes. The share of differing bits over the whole overlap
decides: at most ``most_errors`` over a long one, and less the shorter it is, since a few numbers agree by chance. Of the offsets where it does, the one with most equal bits gives
the alignment. Queries go to the tasks in blocks, so that neither numbers nor pairs are shuffled.

Defined results: null, empty or too short audio has no fingerprint, is in no class and aligns with nothing; silence has a fingerprint like any other; a
null id is kept and never a query; repeated rows are recordings of one class; recordings of any length are taken whole; of offsets with equally many equal bits the one nearest to 0
counts, then the smaller; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.recurring import squeeze, unsqueeze
from tidemark.llm.shared import scratch_path, written

RATE, FRAME, HOP = 4000, 512, 128
LOW_HZ, HIGH_HZ, REFERENCE_HZ = 200.0, 1900.0, 440.0
WIDTH = 16  # frames that a number looks at
NOTE = 128  # samples of a note in rendered text
SCALE = 1 << 20  # what the energies of a frame add up to
ROUND = -(-(FRAME + WIDTH * HOP) // NOTE)  # notes that make two numbers


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames): kinds compare left with right, low with high, or opposite corners."""
    return [(k % 3, (5 * k) % (12 - h + 1), h, w) for k, (h, w) in enumerate((h, w) for h in (2, 4, 6, 8) for w in (2, 4, 8, 16))]


FILTERS = _filters()


def frame_starts(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the frames of recordings of these sizes, laid end to end, start, and how many each has."""
    frames = np.array([max(0, (n - FRAME) // HOP + 1) for n in sizes], np.int64)
    row, k = _spread(frames)
    return (np.cumsum([0, *sizes[:-1]]))[row] + k * HOP if len(row) else np.zeros(0, np.int64), frames


def chroma(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Energy by pitch class of the frames that start there, each frame scaled to about SCALE and rounded (silence: all equal)."""
    out = np.empty((len(starts), 12), np.int64)
    for at in range(0, len(starts), 4096):
        frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[starts[at : at + 4096]]
        energy = (np.abs(np.fft.rfft(frames * _HANN)) ** 2) @ _FOLD
        total = energy.sum(axis=1, keepdims=True)
        out[at : at + 4096] = np.rint(np.where(total > 1e-9, energy / np.maximum(total, 1e-9), 1 / 12) * SCALE)
    return out


def _fold() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), 12))
    for k, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            fold[k, round(12 * np.log2(f / REFERENCE_HZ)) % 12] = 1
    return fold


_FOLD, _HANN = _fold(), np.hanning(FRAME)


def fingerprints_of(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """For each recording a packed number for each frame that has WIDTH - 1 frames after it."""
    starts, sizes = frame_starts([len(r) for r in recordings])
    frames = chroma(np.concatenate(recordings) if recordings else np.zeros(0), starts)
    image = np.zeros((len(frames) + 1, 13), np.int64)
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    numbers = np.maximum(0, sizes - WIDTH + 1)
    row, k = _spread(numbers)
    at = (np.cumsum(sizes) - sizes)[row] + k

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        return image[at + x + w, y + h] - image[at + x, y + h] - image[at + x + w, y] + image[at + x, y]

    out = np.zeros(len(at), np.uint32)
    for kind, y, h, w in FILTERS:
        half, low = w // 2, h // 2
        if kind == 0:
            a, b = area(0, half, y, h), area(half, half, y, h)
        elif kind == 1:
            a, b = area(0, w, y, low), area(0, w, y + low, low)
        else:
            a, b = area(0, half, y, low) + area(half, half, y + low, low), area(half, half, y, low) + area(0, half, y + low, low)
        value = np.log((SCALE + 1000 * a) / (SCALE + 1000 * b))
        level = (value > -0.7).astype(np.uint32) + (a > b) + (value > 0.7)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)  # Gray code: neighbouring levels differ by one bit
    return np.split(out, np.cumsum(numbers)[:-1])


def fingerprint(samples: np.ndarray) -> np.ndarray:
    return fingerprints_of([samples])[0]


def render(text: str | None) -> bytes:
    """A text as audio: a note for each word, of a pitch that depends on the word alone."""
    words = (text or "").encode().split()
    notes = np.fromiter((zlib.crc32(w) % 36 for w in words), np.int64, len(words))
    return _NOTES[notes].tobytes()


def render_turn(text: str | None) -> bytes:
    """The same, but a text of too few words for two numbers is repeated, with a rest of one note after each time, until it has them."""
    words = len((text or "").encode().split())
    once = render(text)
    return once if not 0 < words < ROUND else (once + bytes(2 * NOTE)) * -(-ROUND // (words + 1))


def _notes() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    hz = REFERENCE_HZ / 2 * 2 ** (np.arange(36)[:, None] / 12)
    return (8000 * np.sin(2 * np.pi * hz * t) * np.hanning(NOTE)).astype("<i2")


_NOTES = _notes()


def fingerprints(table: DataFrame, keys: list[str], column: str, read: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """(keys, n_frames, prints, class): read gives the samples of a value of the column; None: the column holds them."""
    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = [(read(value.as_py()) if read else value.as_py()) or b"" for value in batch[column]]
            prints: list[np.ndarray] = []
            for part in _pieces(np.array([len(x) for x in sounds], np.int64), 1 << 22):
                prints += fingerprints_of([np.frombuffer(x[: len(x) & ~1], "<i2").astype(float) for x in sounds[part]])
            columns = [(len(p) + WIDTH - 1, squeeze(p), hashlib.sha256(p.tobytes()).hexdigest()) if len(p) else (0, None, None) for p in prints]
            made = [pa.array([c[k] for c in columns], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *made], [*keys, "n_frames", "prints", "class"])

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    return table.select(*keys, column).mapInArrow(run, f"{schema}, n_frames long, prints binary, class string")


#: A number as it is, and with each of its bits flipped.
_FLIPS = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32)])
_FILTER_BITS = 27


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) of every item, for rows of so many items."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(counts: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Runs of rows that have about most items together; a larger row is alone."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def allowed_errors(overlap: np.ndarray | int, most_errors: float) -> np.ndarray | float:
    """In how many of their bits so many numbers may differ: the share grows from nearly none to most_errors, half of it at WIDTH numbers."""
    return most_errors * 32 * overlap * overlap / (overlap + WIDTH)


class Probes:
    """The numbers of a block of queries, found by any number that differs in two bits or fewer."""

    def __init__(self, prints: list[np.ndarray]):
        self.numbers = np.concatenate(prints)
        self.size = np.array([len(p) for p in prints], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.distinct, where = np.unique(self.numbers, return_inverse=True)
        self.places = np.argsort(where, kind="stable")
        self.count = np.bincount(where, minlength=len(self.distinct))
        self.first = np.cumsum(self.count) - self.count
        self.of, self.at = _spread(self.size)
        keys = (self.distinct[:, None] ^ _FLIPS).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.number = keys[order], (order // len(_FLIPS)).astype(np.int32)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[self._slot(self.keys)] = True
        self.seen = np.packbits(seen, bitorder="little")

    @staticmethod
    def _slot(v: np.ndarray) -> np.ndarray:
        return v * np.uint32(0x9E3779B1) >> np.uint32(32 - _FILTER_BITS)

    def near(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in distinct, place in self.distinct) of every two numbers that differ in two bits or fewer."""
        found = [np.zeros(0, np.int64)]
        for flip in _FLIPS:
            v = distinct ^ flip
            slot = self._slot(v)
            at = np.flatnonzero(self.seen[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & np.uint8(1))
            low = np.searchsorted(self.keys, v[at])
            row, k = _spread(np.searchsorted(self.keys, v[at], "right") - low)
            found.append(at[row] * len(self.distinct) + self.number[low[row] + k])
        both = np.unique(np.concatenate(found))
        return both // len(self.distinct), both % len(self.distinct)

    def hits(self, prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, recording, offset) at which a number of each is near the other's, once each."""
        numbers, size = np.concatenate(prints), np.array([len(p) for p in prints], np.int64)
        of, at = _spread(size)
        distinct, where = np.unique(numbers, return_inverse=True)
        places, count = np.argsort(where, kind="stable"), np.bincount(where, minlength=len(distinct))
        first = np.cumsum(count) - count
        mine, asked = self.near(distinct)
        longest = int(max(size.max(), self.size.max()))
        found = [np.zeros(0, np.int64)]
        for part in _pieces(count[mine]):
            row, k = _spread(count[mine[part]])
            y, u = places[first[mine[part]][row] + k], asked[part][row]
            for some in _pieces(self.count[u]):
                row, k = _spread(self.count[u[some]])
                x, z = self.places[self.first[u[some]][row] + k], y[some][row]
                found.append(np.unique((self.of[x] * len(prints) + of[z]) * (2 * longest) + self.at[x] - at[z] + longest))
        code = np.unique(np.concatenate(found))
        both, offset = code // (2 * longest), code % (2 * longest) - longest
        return both // len(prints), both % len(prints), offset

    def aligned(self, prints: list[np.ndarray], same: Callable[[np.ndarray, np.ndarray], np.ndarray], most_errors: float, least_overlap: float) -> tuple[np.ndarray, ...]:
        """(query, recording, offset, overlap, errors) of the pairs that meet the limits, each at its offset with most equal bits."""
        q, c, offset = self.hits(prints)
        numbers, size = np.concatenate(prints), np.array([len(p) for p in prints], np.int64)
        begin = np.cumsum(size) - size
        start = np.maximum(0, offset)
        overlap = np.minimum(self.size[q], size[c] + offset) - start
        keep = (overlap >= least_overlap * np.minimum(self.size[q], size[c])) & ~same(q, c)
        q, c, offset, start, overlap = q[keep], c[keep], offset[keep], start[keep], overlap[keep]
        errors = np.zeros(len(q), np.int64)
        for part in _pieces(overlap):
            row, k = _spread(overlap[part])
            x = (self.begin[q[part]] + start[part])[row] + k
            y = (begin[c[part]] + start[part] - offset[part])[row] + k
            errors[part] = np.add.reduceat(np.bitwise_count(self.numbers[x] ^ numbers[y]).astype(np.int64), np.cumsum(overlap[part]) - overlap[part])
        good = np.flatnonzero(errors <= allowed_errors(overlap, most_errors))
        order = good[np.lexsort((offset[good], np.abs(offset[good]), 2 * errors[good] - 32 * overlap[good], c[good], q[good]))]
        best = np.ones(len(order), bool)
        best[1:] = (np.diff(q[order]) != 0) | (np.diff(c[order]) != 0)
        return tuple(a[order[best]] for a in (q, c, offset, overlap, errors))


MATCHES = "class string, other string, offset long, overlap long, bit_errors long"


def _matches(reps: DataFrame, asked: list[tuple[str, bytes]], most_errors: float, least_overlap: float, path: str) -> None:
    """Writes the MATCHES of a block of queries (class, squeezed prints) among all classes."""
    sent = reps.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, probes = np.array([i for i, _ in sent.value], object), None
        for batch in batches:
            if not batch.num_rows:
                continue
            probes = probes or Probes([unsqueeze(b, np.uint32) for _, b in sent.value])
            classes, prints = np.array(batch["class"].to_pylist(), object), [unsqueeze(b.as_py(), np.uint32) for b in batch["prints"]]
            for part in _pieces(np.array([len(p) for p in prints]), 1 << 19):
                own = classes[part]
                q, c, *rest = probes.aligned(prints[part], lambda q, c, own=own: ids[q] == own[c], most_errors, least_overlap)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.string()), pa.array(own[c], pa.string()), *(pa.array(a, pa.int64()) for a in rest)], [x.split()[0] for x in MATCHES.split(", ")])

    reps.select("class", "prints").mapInArrow(run, MATCHES).write.parquet(path)
    sent.unpersist()


def _blocks(reps: DataFrame, numbers: int) -> Iterator[list[tuple[str, bytes]]]:
    """The queries' (class, squeezed prints), in blocks of about so many numbers; the driver holds one block at a time."""
    block, n = [], 0
    for r in reps.where("asked").select("class", "prints", "n_frames").toLocalIterator():
        block.append((r["class"], bytes(r["prints"])))
        n += r["n_frames"]
        if n >= numbers:
            yield block
            block, n = [], 0
    if block:
        yield block


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Numbers that overlap when b is moved by offset against a, and the bits in which they differ."""
    start, end = max(0, offset), min(len(a), len(b) + offset)
    if end <= start:
        return 0, 0
    return end - start, int(np.bitwise_count(a[start:end] ^ b[start - offset : end - offset]).sum())


class Alignment(NamedTuple):
    recordings: DataFrame  # keys, n_frames, class, is_query: a row for each recording
    matches: DataFrame  # MATCHES: a row for each two classes that align, the first one a query's


def align(table: DataFrame, keys: list[str], column: str, query: Column, read: Callable[[object], bytes | None] | None = None, most_errors: float = 0.35, least_overlap: float = 0.25, block_numbers: int = 1 << 18) -> Alignment:
    """Which class each recording is of, and the classes that align with those of queries: other moved by offset frames agrees with class in all but bit_errors bits
    over overlap numbers: no more than allowed_errors, and at least least_overlap of the shorter one. No row is made for two recordings: a class stands for its copies.
    block_numbers: so many numbers of queries are looked for at a time."""
    spark = table.sparkSession
    rows = written(fingerprints(table, keys, column, read), "prints").withColumn("is_query", F.coalesce(query, F.lit(False)))
    heard = rows.where("class is not null")
    reps = written(heard.groupBy("class").agg(F.first("prints").alias("prints"), F.first("n_frames").alias("n_frames"), F.max("is_query").alias("asked")), "class-prints")
    path, matches = scratch_path(spark, "matches"), spark.createDataFrame([], MATCHES)
    for k, asked in enumerate(_blocks(reps, block_numbers)):
        _matches(reps, asked, most_errors, least_overlap, f"{path}/block={k}")
        matches = spark.read.schema(MATCHES).parquet(f"{path}/block=*")
    return Alignment(rows.select(*keys, "n_frames", "class", "is_query"), matches)
