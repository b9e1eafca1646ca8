"""Best-fit packing of token pieces into sequences: minimum bin slack on the histogram of lengths.

Documents longer than a sequence are cut into full pieces, with the remainder as the first piece. Only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver. There, bin by bin, the largest length left is fixed
and a bitset subset-sum over the available lengths, held in one big integer, finds the fullest combination beside
it. The combination is removed as many times as the histogram allows at once, so the plan has about as many
combinations as there are lengths, however many pieces there are. Pieces are then numbered within their length, and the
number says which combination, which copy of it and which place a piece takes.

Defined results: a null or empty text is its end mark alone (one piece of length 1); null ids are kept; repeated rows are packed
each; texts of any length are tokenized whole; pieces of one length are told apart by id, piece and ids alone, and which of equal ones comes first changes nothing; of
combinations that fill a sequence equally the one of longer pieces is taken; an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import gapless_rank, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Beyond these characters the two tokenizer libraries might class a character differently, so the slower one decides.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")
_SPECIAL = "<|endoftext|>"


class ByteBPE:
    """Ids as by the tokenizers library without added special tokens. tiktoken, on the same vocabulary, is four
    times as fast and takes the texts in which only Latin characters occur; the rest go to tokenizers itself."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(json_path)

    def ids(self, text: str) -> np.ndarray:
        if _SPECIAL in text or _PLAIN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def byte_bpe(json_path: str | None = None, rank_path: str | None = None) -> ByteBPE:
    import public_tokenizers

    return ByteBPE(json_path or public_tokenizers.path("byte_bpe_50k.json"), rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: all are full but the first, which takes the remainder."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, s + capacity) for s in range(first, length, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """A row for each piece of each document's ids; the ids themselves are only summed up as a CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(json_path, rank_path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                out += [(doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(cut_pieces(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"]) if out else pa.RecordBatch.from_pylist([], _SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the available lengths (length: how many), the combination with the largest sum that fits into room.

    Bit s of ``reach`` is set if the sum s can be made of the lengths seen so far, the long ones first.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, without in reversed(steps):
        if not without >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, copies in a sequence, offset): pieces of that length from that number on go to
    that and the next sequences, so many in each, from that offset."""
    left, used, rows, sequence = {k: n for k, n in histogram.items() if n}, dict.fromkeys(histogram, 0), [], 0
    for largest in sorted(left, reverse=True):
        while left[largest]:
            left[largest] -= 1
            chosen = fullest(left, capacity - largest)
            left[largest] += 1
            chosen[largest] = chosen.get(largest, 0) + 1
            times, offset = min(left[k] // m for k, m in chosen.items()), 0
            for length in sorted(chosen, reverse=True):
                copies = chosen[length]
                rows.append((length, used[length], sequence, copies, offset))
                used[length] += copies * times
                left[length] -= copies * times
                offset += copies * length
            sequence += times
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length, ...)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    plan = slack_plan(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "doc_id", sum(histogram.values()) // 32 + 1, "number")
    firsts = {int(k): (int(a), int(b)) for k, a, b in zip(*_runs(plan[:, 0]))}

    def place(batches):
        for rows in batches:
            length, number = rows["length"].to_numpy(), rows["number"].to_numpy()
            at = np.empty(len(rows), np.int64)
            for k in np.unique(length):
                a, b = firsts[int(k)]
                of = length == k
                at[of] = a + np.searchsorted(plan[a:b, 1], number[of], side="right") - 1
            _, first, sequence, copies, offset = plan[at].T if len(rows) else np.empty((5, 0), np.int64)
            rows["sequence_id"] = sequence + (number - first) // copies
            rows["offset"] = offset + (number - first) % copies * length
            yield rows.drop(columns="number")

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return ranked.select(*pieces.columns, "number").mapInPandas(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, start = np.unique(sorted_values, return_index=True)
    return values, start, np.append(start[1:], len(sorted_values))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """All documents as pieces with their sequence and offset; documents are tokenized once."""
    return pack(written(token_pieces(docs, capacity, end_id, json_path, rank_path), "pieces"), capacity)
