"""N-gram Jaccard join with several global token orders, and the groups of documents that its links connect.

A document's set are its distinct word shingles. Two sets with Jaccard similarity t or more share a token within their first
n - ceil(t n) + 1 tokens, whatever order the tokens are put in, if it is the same order for all sets. The orders here all put rare tokens first (by the number
of documents that have them, counted over the whole corpus) and break ties by a hash of their own. Tokens of one document only link nothing
and are left out after the prefix is cut. The steps:

1. every chunk learns in how many documents each of its shingles occurs (tidemark.llm.recurring);
2. documents with equal sets form a class, of which one set goes on;
3. classes with a common prefix token in the first order form a list; lists with the same members are joined into one;
4. classes that lists connect are an area, compared in one place: pairs that share a prefix token in every order are candidates, and
   their overlap is counted. What leaves an area are only the classes that turned out connected, never pairs;
5. connected components, by distributed label propagation.

Areas of more than ``block`` classes are compared list by list instead, and lists of more than that are cut into blocks: each block is joined
for itself and with the same few centres first; what these links connect needs no further comparison, and only lists that still have several components are
then joined block against block, with pairs of one component skipped.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing (component: its own id); rows without id have component null;
repeated rows and rows that share an id are linked like others, and a component's number is the smallest id in it; texts of any length are taken whole, in a chunk of their own if need be;
tokens that tie in an order are put by their hash; an empty table gives an empty result; extra columns
are not returned by near_components and kept by keep_representatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import recurring as R
from tidemark.llm.shared import discard, free_name, scratch_path, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers of the orders' tie-breaking hashes.
ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_EXACT = 200  # counts beyond are known to a factor of two only, which is still one order for all sets


def count_byte(n: np.ndarray) -> np.ndarray:
    return np.where(n <= _EXACT, n, np.minimum(255, _EXACT + np.log2(np.maximum(n, 1)))).astype(np.uint8)


def byte_count(b: np.ndarray) -> np.ndarray:
    return np.where(b <= _EXACT, b, np.exp2(np.maximum(b.astype(float) - _EXACT, 0)))


def shingle_sets(texts: list[bytes], size: int, known: R.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, one after the other, and where each text's begin."""
    sets, starts = [], [0]
    for text in texts:
        words = text.translate(_LOWER).split()
        if not words:
            one = np.zeros(0, np.uint64)
        else:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            one = np.unique(R.rolling(h, size)) if len(h) >= size else R.mixed(R.rolling(h, len(h)) + np.uint64(len(h)), ORDERS[0])
        sets.append(one)
        starts.append(starts[-1] + len(one))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(starts, np.int64)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(shared: np.ndarray, counts: np.ndarray, n: int, order: int, percent: int) -> np.ndarray:
    """The tokens of a set's prefix that other documents have too. shared: those of its n tokens; the others come first in every order."""
    p = n - least_overlap(n, percent) + 1 - (n - len(shared))
    return shared[np.lexsort((R.mixed(shared, ORDERS[order]), counts))[: max(0, p)]]


_SETS = "row long, doc_id long, n long, sig_a long, sig_b long, tokens binary, counts binary, prefix array<long>"


def _signed(a: np.ndarray) -> list[int]:
    return a.view(np.int64).tolist()


def set_table(docs: DataFrame, size: int, percent: int, layout: R.Layout | None = None) -> DataFrame:
    """A row for each document: number of shingles, a 128-bit signature of the set, and, if the prefix has any token of other documents, all tokens
    of the set that have: the rest can be in no overlap."""
    layout = layout or R.Layout.of(docs)
    chunks = R.chunks_of(docs, layout.chunk_bytes)

    def features(blob: bytes) -> tuple[R.Chunk, np.ndarray, np.ndarray]:
        chunk = R.open_chunk(blob)
        return chunk, *shingle_sets(chunk.texts, size, R.WordHashes())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch["chunk"].to_pylist(), batch["blob"]):
                _, tokens, _ = features(blob.as_py())
                sent, n, _ = R.distinct(tokens, layout)
                yield from R.send(key, sent, count_byte(n))

    def count(which: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        return count_byte(np.bincount(which, byte_count(n), size))

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for key, blob in zip(left["chunk"].to_pylist(), left["blob"]):
            chunk, tokens, starts = features(blob.as_py())
            sent, _, back = R.distinct(tokens, layout)
            counts = R.answer_array(right, sent.keys)[back]
            for k, doc_id in enumerate(chunk.ids):
                t, c = tokens[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]]
                a, b = (int(R.mixed(t, o).sum(dtype=np.uint64).astype(np.int64)) for o in ORDERS[1:])
                common, n = t[c > 1], len(t)
                first = prefix(common, c[c > 1], n, 0, percent)
                whole = len(first) > 0
                out.append(((key << R.ROW_BITS) + k, doc_id, n, a, b, common.tobytes() if whole else None, c[c > 1].tobytes() if whole else None, _signed(first)))
        types = (pa.int64(),) * 5 + (pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 8, types)], [x.split()[0] for x in _SETS.split(", ")])

    told = R.answers(chunks.mapInArrow(emit, R.SENT), count, count, layout)
    return written(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(sets, _SETS), "sets")


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked(sets: list[np.ndarray], counts: list[np.ndarray], size: np.ndarray, labels: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[int]:
    """For each set the first set of its component, where equal labels are connected already. sets: the tokens
    that several documents have, of as many as size says; sides: only sets of different sides are compared (None: all)."""
    n, union = len(sets), Union(len(sets))
    first: dict[int, int] = {}
    for k, label in enumerate(labels.tolist()):
        union.join(first.setdefault(label, k), k)

    def index(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each set the places of its tokens, and for each place the sets that have it."""
        lengths = [len(x) for x in lists]
        values, back = np.unique(np.concatenate(lists), return_inverse=True)
        owner = np.repeat(np.arange(n), lengths)
        by = np.argsort(back, kind="stable")
        return owner[by], np.searchsorted(back[by], np.arange(len(values) + 1)), np.split(back, np.cumsum(lengths)[:-1])

    def overlaps(k: int, at: tuple) -> np.ndarray:
        owner, start, own = at
        t = own[k]
        runs = start[t + 1] - start[t]
        ends = np.cumsum(runs)
        return np.bincount(owner[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[t] - (ends - runs), runs)], minlength=n)

    whole = index(sets)
    orders = [index([prefix(s, c, m, o, percent) for s, c, m in zip(sets, counts, size.tolist())]) for o in range(len(ORDERS))]
    for k in range(n - 1):
        may = np.zeros(n, bool)
        may[k + 1 :] = True
        if sides is not None:
            may &= sides != sides[k]
        may &= (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
        for at in orders:  # the filters of all orders must agree
            if not may.any():
                break
            may &= overlaps(k, at) > 0
        places = np.flatnonzero(may)
        root = union.find(k)
        places = [y for y in places.tolist() if union.find(y) != root]
        if places:
            common = overlaps(k, whole)
            for y in places:
                if 100 * common[y] >= percent * (size[k] + size[y] - common[y]):
                    union.join(k, y)
    return [union.find(k) for k in range(n)]


def _join_lists(members: DataFrame, sets: DataFrame, keys: list[str], percent: int, sides: bool) -> DataFrame:
    """members: (keys..., cls, label, side): links (cls, to) within each group."""

    def run(rows: pa.Table) -> pa.Table:
        cls = rows["cls"].to_pylist()
        tokens = [np.frombuffer(x.as_py(), np.uint64) for x in rows["tokens"]]
        counts = [np.frombuffer(x.as_py(), np.uint8) for x in rows["counts"]]
        roots = linked(tokens, counts, rows["n"].to_numpy(), rows["label"].to_numpy(), percent, rows["side"].to_numpy() if sides else None)
        pairs = [(c, cls[r]) for c, r in zip(cls, roots) if c != cls[r]]
        return pa.table({"x": pa.array([p[0] for p in pairs], pa.int64()), "y": pa.array([p[1] for p in pairs], pa.int64())})

    return members.join(sets, "cls").groupBy(*keys).applyInArrow(run, "x long, y long")


#: A key with more rows than so many, and than its share of them, is dealt into parts; there are at most HUBS such keys, whatever the table.
HUB_ROWS, HUBS, PARTS = 1000, 1 << 16, 64


def dealt_join(left: DataFrame, right: DataFrame, key: str, n_left: int, by: str) -> DataFrame:
    """left and right joined on a key that is unique in right and may have most rows of left: the rows of such keys are dealt by another column into
    parts, each of which gets a copy of right's row. left, of n_left rows, is read twice and should be a written table."""
    # at most HUBS rows: each has more than a HUBS-th of left
    hubs = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HUB_ROWS, n_left // HUBS)).select(key, F.lit(True).alias("_hub"))
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(0)
    copies = F.explode(F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.join(F.broadcast(hubs), key, "left").withColumn("_part", part.cast("int")).drop("_hub")
    return dealt.join(right.join(F.broadcast(hubs), key, "left").withColumn("_part", copies).drop("_hub"), [key, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the smallest node that each node of the edges (x, y) reaches. Labels spread over edges and jump to their label's label until nothing changes.
    Tables of earlier rounds are deleted."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "labels")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    both, edge_path = kept(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels, path = kept(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "cls"))
    n_edges, n_nodes = both.count(), labels.count()
    while True:
        near = dealt_join(both, labels.select(F.col("cls").alias("y"), F.col("label").alias("l")), "y", n_edges, "x").groupBy(F.col("x").alias("cls")).agg(F.min("l").alias("l"))
        spread, spread_path = kept(labels.join(near, "cls").select("cls", F.least("label", "l").alias("new"), F.col("label").alias("old")))
        # every label is itself a node, so it has a label of its own
        jump = spread.select(F.col("cls").alias("new"), F.col("new").alias("over"))
        step, step_path = kept(dealt_join(spread, jump, "new", n_nodes, "cls").select("cls", F.least("new", "over").alias("label"), "old"))
        discard(spark, path)
        discard(spark, spread_path)
        labels, path = step.select("cls", "label"), step_path
        if not step.where("label <> old").limit(1).count():
            discard(spark, edge_path)
            return labels


def _large_lists(members: DataFrame, sets: DataFrame, percent: int, block: int, centres: int) -> DataFrame:
    """Links within lists of areas that are too large for one place. A list's block is joined with the list's first centres; what is left of lists
    that still have several components is joined block against block."""
    placed = members.withColumn("nb", F.ceil(F.col("m") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("nb")).cast("int"))
    large = placed.where("nb > 1")
    centre = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("m")) < centres
    few = large.where(centre).select("token", "nb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), "cls")
    once = placed.select("token", "block", "cls").union(few.select("token", "block", "cls")).distinct()
    edges = written(_join_lists(once.withColumn("label", F.col("cls")).withColumn("side", F.lit(None).cast("int")), sets, ["token", "block"], percent, False), "links")
    labels = components(edges)
    known = large.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_ = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    crossed = known.join(open_, "token").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("other <> block")
    crossed = crossed.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cls", "label", F.col("block").alias("side"))
    return edges.union(written(_join_lists(crossed, sets, ["token", "i", "j"], percent, True), "links"))


def near_components(docs: DataFrame, size: int = 4, percent: int = 85, block: int = 2000, centres: int = 8, layout: R.Layout | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links join sets of at least percent hundredths Jaccard similarity of size-word shingles."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    table = set_table(docs, size, percent, layout)
    named = table.where("doc_id is not null and n > 0")
    sig = ["n", "sig_a", "sig_b"]
    classes = written(named.groupBy(*sig).agg(F.min("row").alias("cls"), F.min("doc_id").alias("least")), "classes")
    sets = written(named.where("size(prefix) > 0").join(classes.select(F.col("cls").alias("row")), "row", "left_semi").select(F.col("row").alias("cls"), "n", "tokens", "counts", "prefix"), "class-sets")
    postings = sets.select("cls", F.explode("prefix").alias("token"))
    # lists with the same members have the same number and the same sums of two hashes; the smallest token stands for them
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(20,0)")).alias("b")).where("m > 1")
    lists = lists.groupBy("m", "a", "b").agg(F.min("token").alias("token")).select("token", "m")
    members = written(postings.join(lists, "token"), "lists")
    sets = sets.drop("prefix")
    # classes that lists connect, where they are no more than a block, are compared in one place
    heads = members.groupBy("token").agg(F.min("cls").alias("y"))
    near = components(members.join(heads, "token").select(F.col("cls").alias("x"), "y"))
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    near = written(near.join(sizes, "label").select("cls", F.col("label").alias("area"), "size"), "areas")
    small = near.where(F.col("size") <= block)
    side = F.lit(None).cast("int")
    edges = written(_join_lists(small.select("cls", F.col("area").alias("at"), F.col("cls").alias("label"), side.alias("side")), sets, ["at"], percent, False), "links")
    if near.where(F.col("size") > block).limit(1).count():
        edges = edges.union(_large_lists(members.join(near.where(F.col("size") > block).select("cls"), "cls"), sets, percent, block, centres))
    labels = components(edges)
    joined = classes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = joined.join(least, "label").select(*sig, "component_id")
    rows = table.select("doc_id", *sig).join(by_set, sig, "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns; of rows with the same id and text one stays. Rows without id are kept."""
    key, at = free_name(docs, "kept"), free_name(docs, "at")
    kept = near_components(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    once = W.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy(F.lit(0))
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(key), "left_semi")
    named = named.withColumn(at, F.row_number().over(once)).where(F.col(at) == 1).drop(at)
    return named.unionByName(docs.where("doc_id is null"))
