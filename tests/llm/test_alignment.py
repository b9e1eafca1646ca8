"""Cross-tokenizer alignment: against both tokenizers on whole texts, and the counts by brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import alignment
from tidemark.llm.alignment import align_tokenizers, tokenizer_pair

PIECES = ["the", "quick", "Ünï", "漢字", "🙂", "don't", "x1;", ");", "▁", "<|endoftext|>", "</s>", "<s>", "é́", "a b", "aaaaaaaaaa", "1234567", "\x1c", "\x00", "==", "{", "ﬁ", "퟿"]
GAPS = [" ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", " \n ", "   ", "　", " \xa0", "\xa0 ", "", "\x0b", "\r", "\x1c ", " "]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(PIECES[:8] if rng.random() < 0.8 else PIECES) + rng.choice(GAPS) for _ in range(rng.randint(0, 30))]
        out.append(rng.choice(["", "", " ", "\n", "  "]) + "".join(words))
    return out


def by_force(rows):
    pair, found, held = tokenizer_pair(), [], Counter()
    for doc_id, text in rows:
        line = f" {text}".encode() if text else b""
        a = pair.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if b"".join(pair.a_bytes[i] for i in a) != line or b"".join(pair.b_bytes[i] for i in b) != line:
            a = b = []
        spans = []
        for ids, raw in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(raw[i]), i))
                at += len(raw[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(i) for _, e, i in own if low < e <= high) for own in spans) for low, high in zip([0, *ends], ends)]
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        held.update(set(links))
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(((d, na, nb, ng, len(k), sum(held[x] == top[x[0]] for x in k), sum(held[x] for x in k), hashlib.sha256(g.encode()).hexdigest() if na else "", g) for d, na, nb, ng, k, g in found), key=str)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 500])
def test_documents(spark, docs_of, chunk_bytes):
    rows = [(k, t) for k, t in enumerate(texts(250))] + [(None, "a null id"), (3, "again"), (3, "again"), (900, None), (901, ""), (902, " "), (903, "word " * 4000), (904, "長" * 2000)]
    got = align_tokenizers(docs_of(rows), chunk_bytes=chunk_bytes).collect()
    small = [r for r in got if r["doc_id"] != 903]
    want = by_force(rows)
    assert sorted((tuple(r) for r in small), key=str) == [w for w in want if w[0] != 903]
    assert [tuple(r) for r in got if r["doc_id"] == 903] == [w for w in want if w[0] == 903]
    assert {r["doc_id"]: r["n_a"] for r in small}[900] == 0


def test_segments_are_tokens_of_the_whole():
    pair = tokenizer_pair()
    assert " " in pair.cuts and "\n" in pair.cuts and "\r" not in pair.cuts
    for text in texts(3000, 7):
        if not text:
            continue
        parts = pair.segments(f" {text}")
        assert "".join(parts) == f" {text}"
        assert [i for p in parts for i in pair.a.encode(p, add_special_tokens=False).ids] == pair.a.encode(f" {text}", add_special_tokens=False).ids
        assert [i for ids in pair.b_ids(parts) for i in ids] == pair.b.encode(text)


def test_each_distinct_segment_once(spark, docs_of, tmp_path):
    """Of a thousand copies in many chunks the segments are aligned once: rows come sorted by segment, also over batches."""
    import pyarrow as pa

    pair, calls = tokenizer_pair(), []
    align = pair.align
    pair.align = lambda segments: calls.extend(segments) or align(segments)
    rows = pa.table({"place": pa.array([k << alignment.NUMBER_BITS for k in range(20_000)], pa.int64()), "segment": [" a"] * 9_000 + [" b"] * 9_000 + [" c"] * 2_000})
    out = pa.Table.from_batches(alignment._aligned(iter(rows.to_batches(max_chunksize=5_000)), pair))
    assert calls == [" a", " b", " c"] and out.num_rows == 20_000 and len(set(out["codes"].to_pylist())) == 3
    together = rows.set_column(0, "place", pa.array([k % 2 << alignment.NUMBER_BITS | k for k in range(20_000)], pa.int64()))
    assert pa.Table.from_batches(alignment._aligned(iter(together.to_batches(max_chunksize=5_000)), pair)).num_rows == 2


def test_empty(spark, docs_of):
    assert align_tokenizers(docs_of([])).count() == 0
    assert [tuple(r)[1:7] for r in align_tokenizers(docs_of([(1, None), (2, "")])).collect()] == [(0,) * 6] * 2
