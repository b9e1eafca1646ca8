"""Substring dedup, packing, sharding, Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pytest

from tidemark.llm import similarity
from tidemark.llm.decontamination import find_contamination, item_blocks, keep_uncontaminated
from tidemark.llm.packing import byte_bpe, fullest, pack_documents
from tidemark.llm.recurring import Layout
from tidemark.llm.sharding import minimax_capacity, minimax_cuts, shard_documents
from tidemark.llm.similarity import keep_representatives, linked, near_components
from tidemark.llm.substrings import remove_repeats

WORDS = [a + b for a in ("ka", "lo", "mé", "tu", "ri", "so") for b in ("n", "r", "st", "la", "dé", "")]
VARIED = [f"{w}{k}" for w in WORDS for k in range(40)]


def prose(rng, n):
    return " ".join(rng.choice(VARIED) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(0, 120)) for _ in range(25)]
    shared = prose(rng, 60)
    rows = list(base) + [base[3]] * 12 + [base[4]] * 3
    for _ in range(20):
        words = base[5 + rng.randrange(3)].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(VARIED)
        rows.append(" ".join(words))
    rows += [f"{prose(rng, 15)} {shared} {prose(rng, 9)}" for _ in range(6)]
    rows += [shared + "\n" + shared, "", None, "one", "one two", "Ünï cödé " * 30, prose(rng, 30_000)]
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


def repeats_by_force(rows, window=20):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[s : s + window]), (doc_id, s)) != (doc_id, s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_repeats(spark, docs_of):
    rows = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in remove_repeats(docs_of(rows)).collect()}
    assert got == repeats_by_force(rows)


SLABS = [Layout(3000, 7, 3, 2), Layout(3000, 8, 8, 3), Layout(500, 5, 2, 1)]


@pytest.mark.parametrize("layout", SLABS)
def test_repeats_by_groups_and_slabs(spark, docs_of, layout):
    rows = corpus(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in remove_repeats(docs_of(rows), layout=layout).collect()}
    assert got == repeats_by_force(rows)


@pytest.mark.parametrize("layout", SLABS)
def test_components_by_groups_and_slabs(spark, docs_of, layout):
    rows = corpus(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_components(docs_of(rows), layout=layout).collect()}
    assert got == components_by_force(rows, 4, 85)


def test_rows_of_the_exchanges():
    """In proportion up to 1 TB; a hundredfold corpus then has no more than its power of 1.5 as many rows, and tasks stay as large."""
    gb, tb = 2**30, 2**40
    rows = {n: Layout.sized(n, 200).rows(n) for n in (gb, 16 * gb, tb, 10 * tb, 100 * tb)}
    assert rows[gb] <= 110_000 and rows[tb] <= 1100 * max(rows[gb], 32_768 * 2) and rows[100 * tb] <= 3_000_000_000 and rows[100 * tb] <= 1.2 * 1000 * rows[tb]
    assert not Layout.sized(tb // 2).slabs and Layout.sized(100 * tb).slabs
    for n in (10 * tb, 100 * tb):
        x = Layout.sized(n)
        assert x.chunk_bytes <= 64 << 20 and (n / x.chunk_bytes / x.slabs) * x.width * (x.chunk_bytes / 2 / x.buckets) <= 40 << 20


def test_repeats_null_ids_and_repeated_rows(spark, docs_of):
    text = prose(random.Random(1), 50)
    got = remove_repeats(docs_of([(7, text), (7, text), (None, text)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 50), (7, 0), (7, 0)]
    assert [r["removed"] for r in got if r["doc_id"] is None] == [[0, 50]]
    assert remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs_of([]), window=10, block=10)


def test_packing(spark, docs_of):
    rows = [*corpus(), (None, "null id"), (0, corpus()[0][1]), (9000, "x <|endoftext|> y 漢字")]
    bpe, by_doc = byte_bpe(), {}
    for r in pack_documents(docs_of(rows)).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    every = [r for rs in by_doc.values() for r in rs]
    for doc_id, text in rows:
        ids = np.append(bpe.exact.encode(text or "", add_special_tokens=False).ids, 2).astype("<u4")
        mine = sorted((r for r in by_doc[doc_id]), key=lambda r: r["piece"])
        for r in mine:
            if len(ids) <= 1024:
                assert r["piece"] == 0 and r["start"] == 0
        if doc_id != 0:
            assert b"".join(ids[r["start"] : r["start"] + r["length"]].tobytes() for r in mine) == ids.tobytes()
            assert [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine] == [r["ids_crc32"] for r in mine]
            assert all(r["length"] == 1024 for r in mine[1:])
    bins = {}
    for r in every:
        bins.setdefault(r["sequence_id"], []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in every) // 1024) + 2
    assert pack_documents(docs_of([])).count() == 0


def test_fullest_combination():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 40)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = fullest(counts, room)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room)
        assert all(m <= counts[k] for k, m in chosen.items())


def test_minimax():
    rng = random.Random(2)
    for _ in range(200):
        n, k = rng.randint(1, 9), rng.randint(1, 4)
        z = np.array([rng.randint(1, 30) for _ in range(n)])
        best = min(max(int(z[a:b].sum()) for a, b in zip((0, *c), (*c, n))) for c in combinations_with_replacement(range(n + 1), k - 1))
        cuts = [0, *minimax_cuts(z, k), n]
        assert minimax_capacity(z, k) == best
        assert cuts == sorted(cuts) and max(int(z[a:b].sum()) for a, b in zip(cuts, cuts[1:])) == best


def test_shards(spark, docs_of):
    rows = [*corpus(), (None, "null id"), (0, corpus()[0][1])]
    got = shard_documents(docs_of(rows), 5).collect()
    sizes = {i: len((t or "").encode()) + 8 for i, t in rows}
    assert len(got) == len(rows) and all(r["size"] == sizes[r["doc_id"]] for r in got)
    texts = dict(rows)
    by_text, slots = {}, {}
    for r in got:
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    # no partition of the groups, in their order, into five runs has a smaller largest shard
    groups = {}
    for t in texts.values():
        key = hashlib.md5((t or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + sum(sizes[i] for i, u in rows if (u or "") == (t or "")) if key not in groups else groups[key]
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) == minimax_capacity(np.array([groups[k] for k in sorted(groups)]), 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(docs_of([]), 5).count() == 0


def shingles(text, size):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def components_by_force(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [2000, 4])
def test_components(spark, docs_of, block):
    rows = corpus(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_components(docs_of(rows), block=block).collect()}
    assert got == components_by_force(rows, 4, 85)


def test_components_edges(spark, docs_of):
    got = near_components(docs_of([(4, "a B c"), (2, "A b C"), (None, "a b c"), (5, ""), (6, None), (2, "A b C")])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == {(4, 1, 2): 1, (2, 1, 2): 2, (None, 1, None): 1, (5, 0, 5): 1, (6, 0, 6): 1}
    assert near_components(docs_of([])).count() == 0


def test_representatives_keep_columns(spark, docs_of):
    rows = corpus(9)
    want = {i for i, (_, c) in components_by_force(rows, 5, 80).items() if i == c}
    docs = docs_of([*rows, rows[0], (None, "a b")])
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 1


def test_components_of_hubs(spark, monkeypatch):
    """Stars, chains and pairs, with keys that are dealt into parts."""
    monkeypatch.setattr(similarity, "HUB_ROWS", 3)
    rng, edges = random.Random(3), []
    edges += [(1000, k) for k in range(300)] + [(k, k + 1) for k in range(2000, 2040)] + [(3000 + k, 4000 + k) for k in range(50)] + [(299, 5000), (5000, 5001)]
    rng.shuffle(edges)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["cls"]: r["label"] for r in similarity.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in up}
    assert similarity.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_linked_by_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        s[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(0, 2**62, 1)
        sets.append(np.unique(s))
    n = Counter(t for s in sets for t in s.tolist())
    roots = linked(sets, [np.array([n[t] for t in s.tolist()], np.uint8) for s in sets], np.array([len(s) for s in sets]), np.arange(40), 85)
    up = list(range(40))
    for _ in range(40):
        for a in range(40):
            for b in range(40):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(x & y) >= 85 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    assert roots == up


def contamination_by_force(rows, items, window=13):
    split = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = lambda t: split.findall((t or "").encode().translate(low))
    places = {}
    for i, t in items:
        w = words(t)
        for o in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            places.setdefault(tuple(w[o : o + window]), set()).add(i)
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in places}:
            for s in range(len(w) - m + 1):
                if k := places.get(tuple(w[s : s + m])):
                    hit.update(range(s, s + m))
                    found |= k
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_an_item_with_two_texts_counts_once_in_any_number_of_blocks(spark, docs_of):
    rng = random.Random(8)
    items = [(5, prose(rng, 20)), (5, prose(rng, 30)), *((k, prose(rng, 25)) for k in range(10, 30))]
    docs, bench = docs_of([(1, f"{items[0][1]} x {items[1][1]}"), (2, f"{items[7][1]} {items[0][1]} {items[12][1]}")]), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for block_bytes in (1 << 20, 2000, 500, 1):
        rows = find_contamination(docs, bench, block_bytes=block_bytes).collect()
        got[block_bytes] = sorted(tuple(r) for r in rows)
    assert all(x == got[1 << 20] for x in got.values()) and [r[3] for r in got[1]] == [[5], sorted([5, items[7][0], items[12][0]])]
    assert got[1][0][6] == [30]  # the longer text's match
    blocks = item_blocks(bench, 2000)
    assert len(blocks) > 1 and sorted(i for b in blocks for (i, _) in b.collect()) == sorted(i for i, _ in items)
    assert all(sum(len(t.encode()) + 64 for _, t in b.collect()) <= 2000 for b in blocks)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination(spark, docs_of, block_bytes):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(1, 40))) for k in range(12)] + [(50, "Short One"), (51, None), (None, "nothing"), (52, "..."), (53, prose(rng, 20)), (53, prose(rng, 14))]
    rows = []
    for k in range(40):
        item = rng.choice(items[:12])[1].split()
        cut = item[rng.randrange(max(1, len(item) // 3)) :]
        rows.append((k, " ".join([prose(rng, rng.randint(0, 60)), ", ".join(cut).upper() if k % 3 else "-".join(cut), prose(rng, rng.randint(0, 300)), "short, one" if k % 7 == 0 else ""])))
    rows += [(90, None), (91, ""), (92, items[3][1]), (93, " ".join(items[4][1].split() * 3)), (94, f"{items[16][1]} and {prose(rng, 5)} {items[17][1]}"), (95, items[17][1]), (96, f"{prose(rng, 200_000)} {items[16][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_by_force(rows, items)
    docs = docs_of(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert got == want
    kept = keep_uncontaminated(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [d for d, w in sorted(want.items()) if not w[3]]
    assert find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_longest_match(spark, docs_of):
    rng = random.Random(7)
    item = prose(rng, 40)
    text = f"{prose(rng, 5)} {' '.join(item.split()[2:32])} {prose(rng, 9)}"
    r = find_contamination(docs_of([(1, text)]), spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert (r["item_ids"], r["match_starts"], r["item_starts"], r["match_words"]) == ([8], [5], [2], [30])


def test_windows_of_a_full_block_fit_a_worker():
    """The windows of a block of the default size in a process of its own: two workers beside an executor's heap of 1800 MB have 1200 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from tidemark.llm.decontamination import BLOCK_BYTES, Windows, block_of
rng, words = random.Random(1), [b"word%x" % k for k in range(300_000)]
def items():
    size, k = 0, 0
    while size < BLOCK_BYTES:
        item = [words[min(299_999, int(rng.paretovariate(0.6)))] for _ in range(100)]
        size, k = size + sum(map(len, item)) + 100, k + 1
        yield k, item
w = Windows(block_of(items()))
print(len(w.keys), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert n > 1_000_000 and mb < 450
