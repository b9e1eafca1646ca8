"""Exact dedup: against brute force, with runs that lie across many partitions."""

import hashlib
import random

import pytest

from tidemark.llm import exact
from tidemark.llm.exact import drop_copies, exact_groups


def by_force(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        norm = (text or "").translate(dict.fromkeys(map(ord, exact.WHITE)))
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = {}
    for norm, found in groups.items():
        found.sort()
        for at, (_, none, doc_id, k) in enumerate(found):
            keep = None if found[0][1] else found[0][2]
            out[k] = (None if none else doc_id, keep, len(found), at == 0, hashlib.sha256(norm.encode()).hexdigest())
    return sorted(out.values(), key=str)


def corpus():
    rng = random.Random(4)
    words = ["ka", "lo\t", "mé ", "tu\n", "𝔘\x0b", "a b"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    hot = "the same passage "
    texts += [hot.replace(" ", rng.choice([" ", "  ", "\r\n"])) for _ in range(400)] + [None, "", " \t\n"] * 5 + ["x" * 300_000, "x" * 299_999 + " x"] * 2
    rng.shuffle(texts)
    ids = [None if k % 97 == 0 else rng.randrange(500) for k in range(len(texts))]
    return list(zip(ids, texts))


@pytest.mark.parametrize("part_bytes", [64 << 20, 20_000, 2_000])
def test_groups(spark, docs_of, monkeypatch, part_bytes):
    monkeypatch.setattr(exact, "part_bytes", lambda n: part_bytes)
    rows = corpus()
    got = [tuple(r) for r in exact_groups(docs_of(rows)).collect()]
    assert sorted(got, key=str) == by_force(rows)


def test_documents_that_stay(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact, "part_bytes", lambda n: 20_000)
    rows = corpus()
    docs = docs_of(rows)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
    want = [(r[1], r[4]) for r in by_force(rows) if r[3]]
    got = [(r["doc_id"], hashlib.sha256((r["text"] or "").translate(dict.fromkeys(map(ord, exact.WHITE))).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r["size"] for r in kept.collect()} == {1} and kept.where("label = 'x'").count() == len(want)


def test_empty(spark, docs_of):
    assert exact_groups(docs_of([])).count() == 0 and drop_copies(docs_of([])).count() == 0


def test_partitions_grow_with_the_root():
    assert exact.part_bytes(30 << 30) == 64 << 20 and exact.part_bytes(1 << 40) == 256 << 20 and exact.part_bytes(160 << 40) == 2 << 30
