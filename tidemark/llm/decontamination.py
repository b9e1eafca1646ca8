"""Benchmark decontamination by suffix arrays over shards of the training text.

Documents are taken in shards of about ``SHARD_CHARS`` characters. A shard's suffix array is sparse: it sorts the suffixes (by their first
``window`` words) that could match at all, namely those whose first two words stand together in some benchmark item and that go on with words of
the benchmark for as long as the shortest window. Every suffix of a benchmark item that is a window long (or the whole of a shorter item) is looked up in
it by binary search, which gives all places of the item's windows; windows that follow each other on one diagonal are one longer verbatim match. Shorter
suffixes are no contamination by themselves and are not looked up.

Benchmark items are sent to the executors in blocks of at most ``block_bytes``, cut by sums over cells of a hash of the id, so that a block is larger only if
one id's texts are; with more than one block each takes a pass of its own over the documents, and the hits are merged by row. All texts of an id are in one block.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z made lower case. A window is
``window`` consecutive words of an item, or the whole of an item that has fewer. A document is contaminated if any word is inside an
occurrence of a window and these are at least ``share`` of its words.

Defined results: a null or empty text has no words and is never contaminated; items without id or without words are not looked for, and items of
one id count once, with the longest match of any of their texts (of equally long ones: of the first text in order, then the one that starts earliest relative to
the item); repeated rows give a row each; documents of any length are taken whole, in a shard of their own if need be; an empty table gives an empty
result, an empty benchmark no hits; extra columns are not returned by find_contamination and kept by keep_uncontaminated, whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, written

SHARD_CHARS = 8 << 20
#: Text of benchmark items that is looked for at a time: its windows take about 20 times as much in each Python worker, and twice that for a moment while they are sorted.
BLOCK_BYTES = 8 << 20
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Block(NamedTuple):
    """Benchmark items as numbers of words, from 1: what is sent to the workers, a few bytes a word."""

    name: str
    item_ids: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    words: bytes  # in the order of their numbers


def block_of(items: Iterable[tuple[int, list[bytes]]]) -> Block:
    known: dict[bytes, int] = {}
    item_ids, lengths, ids = [], [], array("I")
    for item_id, words in items:
        item_ids.append(item_id)
        lengths.append(len(words))
        ids.extend([known.setdefault(w, len(known) + 1) for w in words])
    return Block(uuid.uuid4().hex, np.array(item_ids, np.int64), np.array(lengths, np.int64), np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), b" ".join(known))


class Windows:
    """The windows of a block of benchmark items, sorted, as arrays: about 80 bytes for each word of the block, and the distinct words."""

    def __init__(self, block: Block, window: int = 13):
        self.window, self.item_ids = window, block.item_ids
        self.vocabulary = {w: k for k, w in enumerate(block.words.split(), 1)}
        many = np.maximum(1, block.lengths - window + 1)
        item = np.repeat(np.arange(len(many), dtype=np.uint32), many)
        offset = _ranges(np.zeros(len(many), np.int64), many)
        first = np.cumsum(block.lengths) - block.lengths
        size = np.minimum(block.lengths, window)[item]
        rows = np.concatenate([block.ids, np.zeros(window, np.uint32)])[(first[item] + offset)[:, None] + np.arange(window)]
        short = np.flatnonzero(size < window)
        rows[short] *= np.arange(window) < size[short, None]
        strings = _as_strings(rows.astype(">u4"))
        del rows
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        begins = np.flatnonzero(np.append(True, strings[1:] != strings[:-1])) if len(strings) else np.zeros(0, np.int64)
        self.keys, self.size = strings[begins], size[order][begins]
        self.shortest = int(self.size.min()) if len(begins) else window
        self.place_item, self.place_offset, self.place_from = item[order], offset[order].astype(np.uint32), np.append(begins, len(strings))
        # a short window is found by the words that it has: up to the string that follows all that begin with them
        self.short = np.flatnonzero(self.size < window)
        ends = self.keys[self.short].view(">u4").reshape(-1, window).copy()
        ends[np.arange(len(ends)), self.size[self.short] - 1] += 1
        self.ends = _as_strings(ends)
        inside = np.append(np.diff(np.repeat(np.arange(len(many)), block.lengths)) == 0, False)
        at = np.flatnonzero(inside)
        self.pairs = np.unique(block.ids[at].astype(np.int64) * (len(self.vocabulary) + 1) + block.ids[np.minimum(at + 1, len(block.ids) - 1)]) if len(at) else np.zeros(0, np.int64)


_held: dict[tuple[str, int], Windows] = {}


def windows_of(block: Block, window: int) -> Windows:
    """Built once in a worker for all its tasks; the windows of the block before are let go."""
    key = block.name, window
    if key not in _held:
        _held.clear()
        _held[key] = Windows(block, window)
    return _held[key]


def _as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings: these compare as the rows do, word by word."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def suffix_array(tokens: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes that could match, sorted, and their first words as strings. Token 0 matches nothing and ends each document."""
    n, depth = len(tokens), windows.window
    stops = np.append(np.flatnonzero(tokens == 0), n)
    run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(run >= windows.shortest)
    if windows.shortest > 1 and len(at):
        pair = tokens[at].astype(np.int64) * (len(windows.vocabulary) + 1) + tokens[np.minimum(at + 1, n - 1)]
        spot = np.minimum(np.searchsorted(windows.pairs, pair), len(windows.pairs) - 1)
        at = at[windows.pairs[spot] == pair]
    padded = np.concatenate([tokens, np.zeros(depth, tokens.dtype)])
    strings = _as_strings(padded[at[:, None] + np.arange(depth)].astype(">u4"))
    order = np.argsort(strings, kind="stable")
    return at[order], strings[order]


def search(tokens: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place in tokens, window) of every occurrence of every window."""
    starts, strings = suffix_array(tokens, windows)
    low, high = np.searchsorted(strings, windows.keys), np.searchsorted(strings, windows.keys, "right")
    high[windows.short] = np.searchsorted(strings, windows.ends)
    n = high - low
    return starts[_ranges(low, n)], np.repeat(np.arange(len(n)), n)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for n[0] numbers, then the same for the next."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


@dataclass
class Found:
    n_words: int
    runs: list[int]  # start, end, start, end, ... of the words inside occurrences
    n_hit: int
    matches: list[tuple[int, int, int, int]]  # item id, start in the document, start in the item, words: the longest of each item


def look_through(texts: list[str | None], windows: Windows) -> list[Found]:
    """What of the benchmark occurs in each text of a shard."""
    known, out = windows.vocabulary, []
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.fromiter(itertools.chain.from_iterable(itertools.chain(map(known.get, w, itertools.repeat(0)), (0,)) for w in words), np.uint32, int(start[-1]))
    place, window = search(tokens, windows) if len(windows.keys) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, place, 1)
    np.add.at(covered, place + windows.size[window] if len(place) else place, -1)
    hit = np.concatenate([[0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]])
    begins, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    # one entry for each occurrence and each item that has the window; runs on one diagonal are one match
    n = windows.place_from[window + 1] - windows.place_from[window] if len(place) else np.zeros(0, np.int64)
    spot = _ranges(windows.place_from[window] if len(place) else n, n)
    item, offset, at, size = windows.place_item[spot].astype(np.int64), windows.place_offset[spot].astype(np.int64), np.repeat(place, n), np.repeat(windows.size[window] if len(place) else n, n)
    order = np.lexsort((at, at - offset, item))
    item, offset, at, size = item[order], offset[order], at[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(item) != 0) | (np.diff(at - offset) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    length = at[last] + size[last] - at[first] if len(first) else first
    doc = np.searchsorted(start, at[first], side="right") - 1
    longest: dict[int, dict[int, tuple[int, int, int, int]]] = {}
    for d, k, a, o, m in zip(doc.tolist(), item[first].tolist(), at[first].tolist(), offset[first].tolist(), length.tolist()):
        key, of = int(windows.item_ids[k]), longest.setdefault(d, {})
        if key not in of or of[key][3] < m:
            of[key] = (key, a - int(start[d]), o, m)
    run_doc = np.searchsorted(start, begins, side="right") - 1
    runs: dict[int, list[int]] = {}
    for d, a, b in zip(run_doc.tolist(), begins.tolist(), ends.tolist()):
        runs.setdefault(d, []).extend((a - int(start[d]), b - int(start[d])))
    for d in range(len(texts)):
        r = runs.get(d, [])
        out.append(Found(int(sizes[d]), r, sum(r[1::2]) - sum(r[::2]), sorted(longest.get(d, {}).values())))
    return out


def shards(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= SHARD_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of at most block_bytes of text (or of one cell of ids), each small enough to be sent whole."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = F.octet_length("text").cast("long") + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= block_bytes:
        return [items]
    # sixteen cells a block on average; the driver holds a number for each of at most 2 ** 20
    cells = min(1 << 20, 1 << (16 * total // block_bytes).bit_length())
    cell = F.pmod(F.xxhash64("item_id"), F.lit(cells))
    starts, held = [0], 0
    for r in sorted(items.groupBy(cell.alias("cell")).agg(F.sum(size).alias("n")).collect()):
        if held and held + r["n"] > block_bytes:
            starts, held = [*starts, r["cell"]], 0
        held += r["n"]
    return [items.where((cell >= a) & (cell < b)) for a, b in zip(starts, [*starts[1:], cells])]


def _send(items: DataFrame, window: int):
    rows = sorted({(r["item_id"], r["text"]) for r in items.collect()})
    return items.sparkSession.sparkContext.broadcast(block_of((i, w) for i, t in rows if (w := words_of(t))))


_FOUND = "n_words long, n_hit long, item_ids array<long>, match_starts array<long>, item_starts array<long>, match_words array<long>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float | Fraction = Fraction(1, 20), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, match_starts, item_starts, match_words, contaminated) of every document: the items
    that have an occurring window, with the longest verbatim match of each."""
    blocks, part = item_blocks(benchmark, block_bytes), Fraction(share).limit_denominator(10**6)
    if len(blocks) == 1:
        found = _pass(docs.select("doc_id", "text"), blocks[0], window).drop("runs")
    else:
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
        every = None
        for block in blocks:
            one = written(_pass(rows, block, window), "block-hits")
            every = one if every is None else every.unionByName(one)
        pairs = F.array_sort(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda k: F.array(F.get("runs", k), F.get("runs", k + 1)))).alias("p")))
        every = every.withColumn("runs", F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))))
        # an item is in one block only, so its longest match is known there
        lists = ("item_ids", "match_starts", "item_starts", "match_words")
        matches = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*lists))))
        merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), pairs.alias("pairs"), matches.alias("matches"))
        merged = merged.select("*", *(F.col("matches").getField(c).alias(c) for c in lists))
        n_hit = F.aggregate("pairs", F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), lambda a, p: F.array(F.get(a, 0) + F.greatest(F.lit(0).cast("long"), F.get(p, 1) - F.greatest(F.get(p, 0), F.get(a, 1))), F.greatest(F.get(a, 1), F.get(p, 1))))
        found = merged.withColumn("n_hit", F.get(n_hit, 0)).select("doc_id", *(x.split()[0] for x in _FOUND.split(", ")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * part.denominator >= F.col("n_words") * part.numerator))


def _pass(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    sent = _send(items, window)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(sent.value, window)
        for batch in batches:
            found = [f for part in shards(batch["text"].to_pylist()) for f in look_through(part, windows)]
            lists = [[[m[k] for m in f.matches] for f in found] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].cast(pa.int64()) for c in kept), pa.array([f.n_words for f in found], pa.int64()), pa.array([f.n_hit for f in found], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array([f.runs for f in found], pa.list_(pa.int64()))],
                [*kept, *(x.split()[0] for x in _FOUND.split(", ")), "runs"])

    return docs.mapInArrow(run, "".join(f"{c} long, " for c in kept) + _FOUND + ", runs array<long>")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float | Fraction = Fraction(1, 20), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same documents and columns without the contaminated ones, in one pass over them for each block of the benchmark.

    With several blocks the words hit are counted together, by a row number.
    """
    part = Fraction(share).limit_denominator(10**6)
    blocks = item_blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        row = free_name(docs, "row")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        bad = find_contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, window, share, block_bytes).where("contaminated").select(F.col("doc_id").alias(row))
        return rows.join(bad, row, "left_anti").drop(row).select(docs.columns)
    sent = _send(blocks[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(sent.value, window)
        for batch in batches:
            found = (f for texts in shards(batch["text"].to_pylist()) for f in look_through(texts, windows))
            yield batch.filter(pa.array([not f.n_hit or f.n_hit * part.denominator < f.n_words * part.numerator for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
