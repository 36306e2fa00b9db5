"""Quality classifier on supervised subword embeddings.

A word has the features of itself and of the character n-grams of ``<word>``, hashed into ``BUCKETS`` learned vectors; a word that
repeats the one before it has, as often, that of all such pairs instead.  A document is the mean of its features' vectors, and a
softmax layer tells its class.  All is trained by stochastic gradient descent on a bounded
sample of labelled documents, balanced over the classes; every document is then scored whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._text import SPACE_WORDS, Words, blocks, encoded, mix
from gridspark.llm._worker import tidy

BUCKETS, SIZE, GRAMS = 1 << 15, 16, (3, 4, 5)
#: The classifier learns from at most so many documents of each class, of at most so many characters each.
MAX_DOCS, MAX_CHARS = 1500, 20_000
EPOCHS, BATCH, RATE, LAYER_RATE, SEED = 10, 32, 60.0, 1.0, 11
_BLOCK = 2 << 20
#: Characters of distinct words whose features are looked up at a time.
_CHARS = 50_000
_P = np.uint64(0x100000001B3)


def word_features(words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, index of each word's first one and, at the end, their number) of distinct words and their hashes."""
    codes = np.frombuffer((b"<" + b"><".join(words) + b">").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    whole = np.concatenate(([0], np.cumsum((np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80)))
    lengths = np.diff(whole[np.concatenate(([0], np.cumsum([len(w) for w in words])))]) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    of, found = [np.arange(len(words))], [mix(hashes)]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * _P + codes[at + k] + np.uint64(1)
            of.append(word[at])
            found.append(mix(h))
    owner = np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(words) + 1))


def _distinct(words: Words) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, their hashes, the number of each word)."""
    hashes, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = words.raw.tobytes()
    return [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)], hashes, number


#: The feature of a pair of equal words.
_TWICE = int(mix(np.array([2], np.uint64))[0] % np.uint64(BUCKETS))


def _repeats(words: Words, number: np.ndarray) -> np.ndarray:
    """Is a word equal to the one before it in its text?"""
    return np.append(False, (number[1:] == number[:-1]) & (words.doc[1:] == words.doc[:-1]))


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares of all features) of each text; none for a text without words."""
    words = Words(texts, SPACE_WORDS, False)
    if not len(words):
        return [(np.empty(0, np.int64), np.empty(0))] * len(texts)
    known, hashes, number = _distinct(words)
    buckets, first = word_features(known, hashes)
    sizes, again = np.diff(first), _repeats(words, number)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        plain = number[a:b][~again[a:b]]
        own, times = np.unique(plain, return_counts=True)
        at = np.repeat(first[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        held, place = np.unique(np.append(buckets[at], _TWICE), return_inverse=True)
        total = np.bincount(place, weights=np.append(np.repeat(times, sizes[own]), sizes[number[a:b][again[a:b]]].sum()))
        out.append((held[total > 0], total[total > 0] / max(total.sum(), 1)))
    return out


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x SIZE
    weights: np.ndarray  # SIZE x 2
    bias: np.ndarray  # 2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of class 1 of each text, to six decimals."""
        words = Words(texts, SPACE_WORDS, False)
        mean = np.zeros((len(texts), SIZE))
        if len(words):
            known, hashes, number = _distinct(words)
            per_word, sizes = np.empty((len(known), SIZE)), np.empty(len(known), np.int64)
            part = np.cumsum([len(w) for w in known]) // _CHARS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(known)]
            for a, b in zip(edges, edges[1:], strict=False):
                buckets, first = word_features(known[a:b], hashes[a:b])
                per_word[a:b] = np.add.reduceat(self.vectors[buckets], first[:-1], axis=0)
                sizes[a:b] = np.diff(first)
            full = np.flatnonzero(words.counts)
            at = words.first[:-1][full]
            again = _repeats(words, number)
            each = per_word[number]
            each[again] = self.vectors[_TWICE] * sizes[number[again]][:, None]
            mean[full] = np.add.reduceat(each, at, axis=0) / np.add.reduceat(sizes[number], at)[:, None]
        logits = mean @ self.weights + self.bias
        return np.round(1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -500, 500))), 6)


def trained(texts: list[bytes], classes: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Softmax over mean vectors by stochastic gradient descent; the rate falls to nothing.  Without two classes all scores are the share of class 1."""
    rng = np.random.default_rng(seed)
    share = float(classes.mean()) if len(classes) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros((BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.array([-20.0, 20.0]) * (2 * share - 1))
    # A class counts as much as the other, however many documents it has.
    held, weight = bags(texts), np.where(classes == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    weights, bias = rng.uniform(-0.5, 0.5, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    wanted = np.stack((1 - classes, classes), 1).astype(np.float32)
    steps = epochs * -(-len(held) // BATCH)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(held))
        for a in range(0, len(held), BATCH):
            rows = order[a : a + BATCH]
            x = np.zeros((len(rows), BUCKETS), np.float32)
            for k, r in enumerate(rows):
                x[k, held[r][0]] = held[r][1]
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            h = x @ vectors[used]
            logits = h @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - wanted[rows]) * weight[rows][:, None] / len(rows)
            now = rate * (1 - step / steps)
            inner = d @ weights.T
            weights -= LAYER_RATE * now / rate * (h.T @ d)
            bias -= LAYER_RATE * now / rate * d.sum(0)
            vectors[used] -= now * (x.T @ inner)
            step += 1
    return Model(vectors.astype(np.float64), weights.astype(np.float64), bias.astype(np.float64))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, most: int = MAX_DOCS, longest: int = MAX_CHARS) -> tuple[list[bytes], np.ndarray]:
    """The texts and classes to learn from: of each class the ``most`` documents whose ids hash lowest, less those without a text of up to ``longest`` characters."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (learn if learn is not None else F.lit(True)))
    known = own.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_class"))
    few = [known.where(F.col("_class") == c).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(most) for c in (0, 1)]
    text = F.col(text_col).cast("string")
    read = docs.where(F.char_length(text) <= longest).select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = read.join(F.broadcast(few[0].union(few[1])), "_id").groupBy("_id", "_class").agg(F.min("_text").alias("_text")).orderBy("_id").collect()  # at most 2 * most rows
    return [r["_text"].encode() for r in rows], np.array([r["_class"] for r in rows], np.int64)


def fitted(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """A model of the documents that :func:`sample` gives."""
    return trained(*sample(docs, labels, **how))


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (the probability of class 1) and ``predicted`` (1 from a score of 0.5 on) of every document, without a shuffle.

    A null, empty or blank text has no features and gets what the bias alone gives.  Rows that repeat give a row each; an empty table
    gives no rows; extra columns are ignored.  A text is read whole, however long, and its score does not depend on those beside it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * SIZE numbers: 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(encoded(batch.column(1)), _BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(sent.value.scores(held))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = rows.mapInArrow(tidy(run), f"id {rows.schema['_id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
