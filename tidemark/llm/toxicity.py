"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so that a misspelling shares most of its vector with the word that is meant. Runs
of more than 64 characters without white space are split at inner punctuation, and what is still longer into overlapping pieces. A
document is an average of its distinct words' vectors, which goes into a softmax over two classes. The weights of the average are themselves a
softmax of the words' own class scores: a plain mean (``plain=True``) drowns one insult among a thousand harmless words: fitted three times as long it
finds 57 of 97 toxic held-out texts of which the weighted one finds 91 (README has the figures). N-gram vectors, softmax weights and bias are trained together, by Adam on minibatches.

Fitting uses a bounded, documented sample of the labelled rows: the ``per_class`` rows of each label with the smallest hash of their id, among texts
of at most ``fit_chars`` characters; of equal texts one. Scoring covers every whole text.

Defined results: a null or empty text has no words, gets the bias alone and is never called toxic; rows without id or label are not used to fit; of
several labels of one id the largest counts; repeated rows give a row each; an empty table an empty result; without any
labelled rows of both classes every score is 0; texts of any length are scored whole; extra columns are not returned by score_documents and kept by keep_clean; rows
with the same text have the same score, and a score of exactly 0.5 is toxic.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_CACHE = 200_000
LONGEST, PIECE = 64, 16


def parts(run: str) -> Iterator[str]:
    """The words of a longer run: between punctuation, and of still longer ones every piece of PIECE characters that begins at half a piece."""
    for w in _INNER.split(run):
        if len(w) <= LONGEST:
            yield w
        else:
            yield from (w[at : at + PIECE] for at in range(0, len(w) - PIECE // 2, PIECE // 2))


def words_of(text: str) -> list[str]:
    """The distinct lower-case words of a text, without punctuation at their ends."""
    raw = set(text.lower().split())
    plain = {w for w in raw if w.isalnum()}
    plain.update(_EDGES.sub("", w) for w in raw - plain)
    for run in [w for w in plain if len(w) > LONGEST]:
        plain.remove(run)
        plain.update(parts(run))
    plain.discard("")
    return sorted(plain)


@dataclass
class Subwords:
    """Which rows of the table of vectors a word's character n-grams have."""

    least: int = 3
    most: int = 5
    buckets: int = 1 << 16

    def bags(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word) of every n-gram of bytes of <word>, all words at once, and the number of each word's."""
        marked = [f"<{w}>".encode() for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        of = np.repeat(np.arange(len(marked)), sizes)
        b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
        rows, owners, n = [], [], len(b)
        h = np.zeros(n, np.uint32)
        for k in range(1, self.most + 1):
            if n < k:
                break
            h = h[: n - k + 1] * np.uint32(0x01000193) + b[k - 1 :] + np.uint32(1)
            if k >= self.least:
                whole = of[: n - k + 1] == of[k - 1 :]
                mixed = h[whole] * np.uint32(0x9E3779B1)
                rows.append(((mixed ^ mixed >> np.uint32(15)) % np.uint32(self.buckets)).astype(np.int64))
                owners.append(of[: n - k + 1][whole])
        rows.append(np.fromiter((zlib.crc32(m) % self.buckets for m in marked), np.int64, len(marked)))
        owners.append(np.arange(len(marked)))
        owner = np.concatenate(owners)
        return np.concatenate(rows), owner, np.bincount(owner, minlength=len(marked))


#: Letters and what is written in their place.
LOOKALIKES = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7", "l": "1", "c": "k", "k": "c", "u": "v", "h": "4"}


def misspelt(word: str, rng: random.Random) -> str:
    """The word with one letter doubled, dropped, swapped with the next or replaced by a lookalike."""
    if len(word) < 4:
        return word
    i, how = rng.randrange(len(word) - 1), rng.randrange(4)
    if how == 0:
        return word[:i] + word[i] + word[i:]
    if how == 1:
        return word[:i] + word[i + 1 :]
    if how == 2:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + rng.choice(LOOKALIKES.get(word[i], word[i])) + word[i + 1 :]


@dataclass
class Model:
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    subwords: Subwords
    plain: bool = False

    def direction(self) -> np.ndarray:
        """Class scores of every n-gram row: with two classes the softmax needs only their difference."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def attend(scores: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the words within each document, and the weighted mean of their scores. start: where each non-empty document begins."""
    most = np.maximum.reduceat(scores, start)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(scores))))
    e = np.exp(scores - most[of])
    a = e / np.add.reduceat(e, start)[of]
    return a, np.add.reduceat(a * scores, start)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for n[0] numbers, then the same for the next."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


class Forms:
    """The words of the texts to fit on, each with a few misspellings, and the n-gram rows of every form: hashed once, not in each epoch."""

    def __init__(self, texts: list[str], sub: Subwords, spellings: int, letters: random.Random):
        known: dict[str, int] = {}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
        self.each = spellings + 1
        forms = [f for w in known for f in (w, *(misspelt(w, letters) for _ in range(spellings)))]
        rows, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(forms), 50_000):
            flat, owner, size = sub.bags(forms[at : at + 50_000])
            rows.append(flat[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(size)
        self.rows, self.size = np.concatenate(rows), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def draw(self, docs: np.ndarray, typos: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forms that occur, which of them each word of these texts has, and where each text begins."""
        words = np.concatenate([self.docs[d] for d in docs])
        wrong = np.where(rng.random(len(words)) < typos, rng.integers(1, self.each, len(words)), 0) if self.each > 1 else 0
        forms, ids = np.unique(words * self.each + wrong, return_inverse=True)
        return forms, ids, np.concatenate([[0], np.cumsum([len(self.docs[d]) for d in docs])[:-1]]).astype(np.int64)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None, dim: int = 8, epochs: int = 8, batch: int = 128, least_steps: int = 100, typos: float = 0.3, spellings: int = 3, trim: float = 0.9, rate: float = 0.03, decay: float = 0.01, seed: int = 7, subwords: Subwords | None = None, plain: bool = False) -> Model:
    """least_steps: more epochs if they have fewer batches. weights: of each text, such that together they stand for all labelled rows. typos: share of the words, of either class,
    that each epoch sees in one of so many misspellings, so that no word is known by its whole form alone. trim: in the second half, texts that the model
    is that sure to be labelled wrong are passed over, or it would learn them by heart. plain: every word weighs the same."""
    sub, rng = subwords or Subwords(), np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (sub.buckets, dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2), sub, plain)
    forms = Forms(texts, sub, spellings, random.Random(seed))
    keep = np.array([i for i, b in enumerate(forms.docs) if len(b)], np.int64)
    if not len(keep) or len(set(labels[keep].tolist())) < 2:
        model.vectors[:], model.bias[:] = 0, (40.0, 0.0)
        return model
    weights = np.ones(len(texts)) if weights is None else weights / weights.mean()
    params = {"v": model.vectors, "w": model.softmax, "b": model.bias}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    step, epochs = 0, max(epochs, -(-least_steps // -(-len(keep) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(keep)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            seen, ids, start = forms.draw(docs, typos, rng)
            size = forms.size[seen]
            flat = forms.rows[_runs(forms.start[seen], size)]
            owner = np.repeat(np.arange(len(seen)), size)
            word = np.add.reduceat(model.vectors[flat], np.cumsum(size) - size) / size[:, None]
            u = model.softmax[:, 1] - model.softmax[:, 0]
            score = (word @ u)[ids]
            n_words = np.diff(np.append(start, len(ids)))
            of = np.repeat(np.arange(len(docs)), n_words)
            a, z = (1 / n_words[of], np.add.reduceat(score, start) / n_words) if plain else attend(score, start)
            p = 1 / (1 + np.exp(-np.clip(z + model.offset(), -40, 40)))
            dz = weights[docs] * (p - labels[docs]) / len(docs)
            if epoch >= epochs // 2:
                dz[np.abs(p - labels[docs]) > trim] = 0
            ds = np.bincount(ids, dz[of] * a * (1 if plain else 1 + score - z[of]), len(seen))  # the weights depend on the scores too
            du = word.T @ ds
            per_form = ds / size
            used = np.flatnonzero(np.bincount(flat, minlength=sub.buckets))
            dv = np.bincount(flat, per_form[owner], sub.buckets)[used][:, None] * u
            step += 1
            lr = rate * (1 - (step / (epochs * -(-len(order) // batch))) * 0.9)
            for k, grad, rows in (("v", dv, used), ("w", np.stack([-du, du], 1) + decay * model.softmax, slice(None)), ("b", np.array([-dz.sum(), dz.sum()]), slice(None))):
                m, s = first[k], second[k]
                m[rows] = 0.9 * m[rows] + 0.1 * grad
                s[rows] = 0.99 * s[rows] + 0.01 * grad * grad
                params[k][rows] -= lr * (m[rows] / (1 - 0.9**step)) / (np.sqrt(s[rows] / (1 - 0.99**step)) + 1e-7)
            if decay:
                model.vectors[used] *= 1 - lr * decay
    return model


class Scorer:
    """Scores of texts; a word is looked up once, in a table that is emptied when it is full."""

    def __init__(self, direction: np.ndarray, offset: float, subwords: Subwords, plain: bool = False):
        self.direction, self.offset, self.subwords, self.plain = direction, offset, subwords, plain
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            flat, owner, size = self.subwords.bags(part)
            self.known.update(zip(part, (np.bincount(owner, self.direction[flat], len(part)) / size).tolist()))

    def many(self, texts: list[str | None]) -> list[float]:
        out, at = [], 0
        while at < len(texts):
            bags, n = [], 0
            while at < len(texts) and n < 100_000:  # so many words at a time
                bags.append(words_of(texts[at] or ""))
                n, at = n + len(bags[-1]), at + 1
            if len(self.known) + n > _CACHE:
                self.known.clear()
            self.learn([*{w for bag in bags for w in bag if w not in self.known}])
            for bag in bags:
                z = self.offset if bag else min(self.offset, -1e-6)
                if bag:
                    scores = np.fromiter(map(self.known.__getitem__, bag), float, len(bag))
                    z += float(scores.mean() if self.plain else attend(scores, np.zeros(1, np.int64))[1][0])
                out.append(float(1 / (1 + np.exp(-min(40, max(-40, z))))))
        return out


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 2500, fit_chars: int = 20_000) -> Model:
    """Learns labels.toxic from the rows that aren't held out: at most per_class texts of each label, each of at most fit_chars."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_at", F.xxhash64("doc_id"))
    total = Counter({r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    # somewhat more ids than needed, since some texts are missing, too long or copies; documents themselves are read once
    spare = per_class + per_class // 4
    picked = [r for label in (0, 1) for r in known.where(F.col("toxic") == label).orderBy("_at", "doc_id").limit(spare).collect()]
    if not picked:
        return fit([], np.zeros(0))
    toxic, place = {r["doc_id"]: r["toxic"] for r in picked}, {r["doc_id"]: k for k, r in enumerate(picked)}
    chosen = docs.sparkSession.createDataFrame([(i,) for i in toxic], "doc_id long")  # at most 2 * spare ids
    rows = docs.select("doc_id", "text").where(F.length("text") <= fit_chars).join(F.broadcast(chosen), "doc_id").toArrow().to_pydict()
    seen, copies, texts, ids, taken = set(), set(), [], [], Counter()
    for _, i, t in sorted((place[i], i, t) for i, t in zip(rows["doc_id"], rows["text"])):
        # copies of one text would make its rare words weigh like common ones
        if i not in seen and t not in copies and taken[toxic[i]] < per_class:
            seen.add(i)
            copies.add(t)
            texts.append(t)
            ids.append(i)
            taken[toxic[i]] += 1
    y = np.array([toxic[i] for i in ids], float)
    n = Counter(y.astype(int).tolist())
    # Half of the weight follows the true shares and half is even, so that rare toxic rows aren't ignored.
    share = {k: 0.5 * total[k] / sum(total.values()) + 0.25 for k in n}
    return fit(texts, y, np.array([share[int(v)] / n[int(v)] for v in y]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; only the text goes into a score."""
    # 256 kB whatever the corpus: one number for each row of the table of vectors.
    sent = docs.sparkSession.sparkContext.broadcast((model.direction().astype(np.float32), model.offset(), model.subwords, model.plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direction, offset, subwords, plain = sent.value
        scorer = Scorer(direction.astype(float), offset, subwords, plain)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(scorer.many(batch["text"].to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The same documents and columns without those that the model calls toxic."""
    sent = docs.sparkSession.sparkContext.broadcast((model.direction().astype(np.float32), model.offset(), model.subwords, model.plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direction, offset, subwords, plain = sent.value
        scorer = Scorer(direction.astype(float), offset, subwords, plain)
        for batch in batches:
            yield batch.filter(pa.array([x < 0.5 for x in scorer.many(batch["text"].to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
