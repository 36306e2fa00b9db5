"""Quality rules: hashed n-gram importance weights with a deterministic threshold.

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams are counted: one over the trusted
target (the documents labelled good), one over the whole raw corpus.  A document's score is the mean,
over its n-grams, of ``log p_target - log p_raw``; a document passes when the score reaches a threshold.
The threshold is fixed by a parameter or, by default, put where the labelled documents are split best; there, a good document is scored
by a target without itself, as documents without a label are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import saved
from gridspark.llm._text import SPACE_WORDS, Words, blocks, encoded, mix
from gridspark.llm._worker import tidy

BUCKETS = 1 << 16
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Up to so many labels are broadcast to the documents; beyond that, documents and labels are joined by a shuffle. All labels count either way.
BROADCAST_LABELS = 1_000_000
#: Used if the labels hold no bad or no good document.
DEFAULT_THRESHOLD = -0.25
_BINS, _LOW, _HIGH = 2048, -8.0, 8.0
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each unigram and bigram."""
    at, pairs = words.windows(2)
    top = np.uint64(64 - 16)
    grams = np.concatenate((words.hash, mix(pairs ^ np.uint64(0x5851F42D4C957F2D))))
    return np.concatenate((words.doc, words.doc[at])), (grams >> top).astype(np.int64)


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw with add-one smoothing; zeros if the target is empty."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _score(words: Words, llr: np.ndarray, n: int) -> np.ndarray:
    doc, bucket = _buckets(words)
    return np.bincount(doc, weights=llr[bucket], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)


def scores_without_own(texts: list[bytes], raw: np.ndarray, target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The scores of texts, each by a target from which its own n-grams are taken out if ``own`` says that they are in it."""
    doc, bucket = _buckets(Words(texts, SPACE_WORDS, False))
    n = np.bincount(doc, minlength=len(texts))
    _, group, times = np.unique(doc * BUCKETS + bucket, return_inverse=True, return_counts=True)
    mine = np.where(own[doc], times[group], 0)
    p = np.log(target[bucket] - mine + 1.0) - np.log(target.sum() + BUCKETS - np.where(own, n, 0))[doc]
    q = np.log(raw[bucket] + 1.0) - np.log(raw.sum() + BUCKETS)
    return np.bincount(doc, weights=p - q, minlength=len(texts)) / np.maximum(n, 1)


def scores(texts: list[bytes], llr: np.ndarray) -> np.ndarray:
    """The length-normalised log ratio of each text; 0 without words."""
    return _score(Words(texts, SPACE_WORDS, False), llr, len(texts))


def measure(texts: list[bytes], llr: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures and the score of each text."""
    words = Words(texts, SPACE_WORDS, False)
    n = len(texts)
    counts = words.counts
    inside = SPACE_WORDS[words.buf] & ((words.buf & 0xC0) != 0x80)
    per = lambda flags: np.add.reduceat(np.append(flags, 0).astype(np.int64), words.at[:-1]) if n else np.zeros(0, np.int64)
    at, window = words.windows(WINDOW)
    key = mix(window + mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    hit = np.cumsum(cover)[:-1] > 0
    dup = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    dup[i] += 1
                elif line.strip(b" \t\n\x0b\x0c\r"):
                    seen.add(line)
    return {
        "n_words": counts.astype(np.int64), "word_chars": per(inside), "n_symbols": per(_SYMBOLS[words.buf]), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(words.doc[hit], minlength=n).astype(np.int64), "score": _score(words, llr, n),
    }


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIGURES = ", ".join(f"{c} long" for c in _COLUMNS) + ", score double"


def _measured(llr_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = llr_b.value
        for batch in batches:
            texts = encoded(batch.column(1))
            for first, held in blocks(texts):
                got = measure(held, llr)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), *(pa.array(got[c]) for c in (*_COLUMNS, "score"))], ["doc_id", *_COLUMNS, "score"])

    return run


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id hashes of all labelled documents, and their qualities (the least where labels disagree)."""
    known = labels.where("quality in (0, 1)").where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col("quality").cast("long").alias("quality"))
    return known.groupBy("_h").agg(F.min("quality").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``quality`` and ``_text`` of every labelled document, however many there are."""
    known = trusted(labels, id_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    if known.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(known), "_h").select("quality", "_text")
    # Each task holds its share of the labels and the texts stream by; saved, because they are read twice.
    return saved(rows.join(known.hint("shuffle_hash"), "_h").select("quality", "_text"), "labelled-documents")


def counted(texts: DataFrame) -> np.ndarray:
    """The n-grams of each of ``BUCKETS`` buckets over all texts, the only column.  What reaches the driver is one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pre-aggregates a whole partition: at most a row for each bucket leaves a task.
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, held in blocks(encoded(batch.column(0))):
                total += np.bincount(_buckets(Words(held, SPACE_WORDS, False))[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = texts.mapInArrow(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toPandas().to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    if len(counts):
        out[counts[:, 0].astype(int)] = counts[:, 1]
    return out


def best_threshold(scores: DataFrame) -> float:
    """Where good and bad labelled documents are split best: the middle of the best bins.

    ``scores`` has ``quality`` and ``score``; what reaches the driver is a histogram of ``_BINS`` bins.
    """
    at = F.least(F.greatest(F.floor((F.col("score") - _LOW) / (_HIGH - _LOW) * _BINS), F.lit(0)), F.lit(_BINS - 1)).cast("int")
    rows = scores.where("quality in (0, 1) and score is not null").groupBy(at.alias("at"), "quality").count().collect()
    bad, good = np.zeros(_BINS), np.zeros(_BINS)
    for r in rows:
        (good if r["quality"] == 1 else bad)[r["at"]] += r["count"]
    if not bad.sum() or not good.sum():
        return DEFAULT_THRESHOLD
    # Bin b starts at the threshold: all bins below are rejected.
    right = np.concatenate(([0.0], np.cumsum(bad)))[:-1] / bad.sum() + (1 - np.concatenate(([0.0], np.cumsum(good)))[:-1] / good.sum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(_LOW + (best[0] + best[-1]) / 2 * (_HIGH - _LOW) / _BINS)


def _prepared(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, threshold: float | None):
    """The broadcast log ratios and the threshold."""
    context = docs.sparkSession.sparkContext
    known = labelled(docs, labels, id_col=id_col, text_col=text_col)
    raw, target = counted(docs.select(F.col(text_col).cast("string"))), counted(known.where("quality = 1").select("_text"))
    llr = context.broadcast(weights(raw, target))  # BUCKETS doubles: 512 KB
    if threshold is None and target.sum():
        counts = context.broadcast((raw, target))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                quality = batch.column(0).to_numpy(zero_copy_only=False)
                for first, texts in blocks(encoded(batch.column(1))):
                    own = quality[first : first + len(texts)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(scores_without_own(texts, *counts.value, own == 1))], ["quality", "score"])

        threshold = best_threshold(known.mapInArrow(tidy(score), "quality long, score double"))
    return llr, DEFAULT_THRESHOLD if threshold is None else threshold


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """Scores every document: ``doc_id``, the base figures, ``base_failed``, ``score`` and ``kept``.

    A null or empty text has no words and fails the base.  A document is base-failed with fewer than
    20 words, or with over 30 % of its words in repeated 8-word windows.  Rows with equal ids give a
    row each.  Labels have their ids in a column of the same name; those with null or unknown ids, or other qualities than 0 and 1, are ignored; without
    good labels every score is 0.  An empty table gives no rows.  Extra columns are ignored.  A text is measured whole, however long.
    """
    llr, threshold = _prepared(docs, labels, id_col, text_col, threshold)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(tidy(_measured(llr)), f"doc_id {rows.schema['_id'].dataType.simpleString()}, {_FIGURES}")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("score") >= threshold)).select("doc_id", *_COLUMNS, "base_failed", "kept", "score")


def filter_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, without any join; nulls, repeated rows and empty tables as there."""
    llr, threshold = _prepared(docs, labels, id_col, text_col, threshold)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(encoded(batch.column(at))):
                got = measure(held, llr.value)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
                yield batch.slice(first, len(held)).filter(pa.array(~failed & (got["score"] >= threshold)))

    return docs.mapInArrow(tidy(run), docs.schema)
