"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt into ranges of their ids, so that files, stripes and rows ascend.  A reader gets stripes in parallel, and a
search for some documents skips files by their statistics, stripes by Bloom filters and rows by the row index.

The tokenizer's own pattern never reaches across ASCII white space, so the library is asked once for each distinct chunk
between white space while that chunk stays in a bounded cache; a text's ids are those of its chunks, gathered with numpy.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm._shared import new_path, saved
from gridspark.llm._text import slices
from gridspark.llm._worker import kept

END_ID = 1
#: Chunks in the cache; it is emptied when it has more, before a group of texts.
CACHE = 1_000_000
#: Plain words that go to the library as one text.
JOINED = 256
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 10_000
FALSE_POSITIVES = 0.01
#: Characters that are split and looked up at a time.
GROUP = 4 << 20


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``pool`` holds the ids of all cached chunks one after another.

    The tokenizer ignores case and keeps letters apart from a full stop or comma, so chunks are lower-cased and cut there, which
    makes fewer distinct ones.  Its special tokens are looked for as they are written; texts that may hold one keep their case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        pieces = self.library.get_vocab()
        self.closing = np.zeros(max(pieces.values()) + 1, bool)
        self.closing[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(found)), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, chunks: list[str]) -> None:
        """Words of ASCII letters go to the library many to a text, where each ends with a closing piece; other chunks are texts of their own."""
        plain = [c for c in chunks if c.isascii() and c.isalpha()]
        other = [c for c in chunks if not (c.isascii() and c.isalpha())]
        pools, sizes = [self.pool], [self.sizes]
        ids, _ = self._ids([" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)])
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the tokenizer does not close each word with a piece of its own")
        pools.append(ids)
        sizes.append(np.diff(ends, prepend=0))
        for k in range(0, len(other), 20_000):
            ids, own = self._ids(other[k : k + 20_000])
            pools.append(ids)
            sizes.append(own)
        self.number.update(zip(plain + other, range(len(self.number), len(self.number) + len(chunks)), strict=True))
        self.pool, self.sizes = np.concatenate(pools), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each text in them); a null text has no ids, and ``end`` closes each text unless it is None."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy of its own: some string kernels misread the offsets of a slice
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"([a-z])([.,])(\s)", replacement=r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if len(self.number) > CACHE:
            self.clear()
        distinct = words.dictionary.to_pylist()
        known = self.number
        place = np.array([-1 if k is None else k for k in map(known.get, distinct)], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            missing = [distinct[i] for i in new.tolist()]
            self._learn(missing)
            place[new] = [known[w] for w in missing]
        chunk = place[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        sizes = self.sizes[chunk]
        before = np.concatenate(([0], np.cumsum(sizes)))
        bounds = before[np.asarray(split.offsets) - split.offsets[0].as_py()] if len(texts) else np.zeros(1, np.int64)
        flat = self.pool[np.repeat(self.starts[chunk] - before[:-1], sizes) + np.arange(before[-1])]
        if end is None:
            return flat, bounds
        out = np.full(len(flat) + len(texts), end, np.int32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] + np.arange(len(texts))] = False
        out[inside] = flat
        return out, bounds + np.arange(len(texts) + 1)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder, which outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return kept(("chunks", path), lambda: ChunkEncoder(path))


def encode_sorted(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``row`` (place in its partition) and ``ids`` of every row of ``docs``, in ascending order of id.

    A null or empty text has the end id alone; null ids come first; rows with equal ids follow each other, by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, at = encoder(tokenizer_path), 0
        for batch in batches:
            for part in slices(batch, 1, GROUP):
                ids, offsets = e.encode(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(at, at + len(part))), lists], ["doc_id", "row", "ids"])
                at += len(part)

    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text").mapInArrow(run, f"doc_id {kind}, row long, ids array<int>")


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE_BYTES, index_stride: int = INDEX_STRIDE) -> None:
    """Writes ``docs`` as ORC files whose names ascend with the ids in them."""
    out = encode_sorted(docs, tokenizer_path, id_col=id_col, text_col=text_col)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "orc.row.index.stride": str(index_stride), "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "compression": "zstd"}
    out.write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """``doc_id``, ``file_no``, ``row`` and ``ids``; with ``doc_ids``, what cannot hold them is skipped by statistics and Bloom filters."""
    rows = spark.read.orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.select("doc_id", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file_no"), "row", "ids")


def describe_ids(stored: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of the rows of :func:`read_ids`.

    Stripes are read in parallel; a prefix scan over documents inside each file and over the files' totals gives the starts.
    Only figures are shuffled.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.ascontiguousarray(np.asarray(lists.values), "<u4")
            bounds = np.asarray(lists.offsets)
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc)], ["doc_id", "file_no", "row", "n_tokens", "ids_crc32"])

    figures = saved(stored.select("doc_id", "file_no", "row", "ids").mapInArrow(run, f"doc_id {kind}, file_no int, row long, n_tokens long, ids_crc32 long"), "token-figures")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = figures.withColumn("_inside", before(Window.partitionBy("file_no").orderBy("row"), "n_tokens"))
    # One row for each file meets in the second level of the scan.
    totals = figures.groupBy("file_no").agg(F.sum("n_tokens").alias("_n")).select("file_no", before(Window.orderBy("file_no"), "_n").alias("_before"))
    return inside.join(totals, "file_no").select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def stored_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` into the shared folder and describes what is read back.

    Null and empty texts have the end id alone; null ids come first; rows with equal ids follow each other by text and give a row each; a very long
    text is encoded whole.  An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, tokenizer_path, path, id_col=id_col, text_col=text_col)
    return describe_ids(read_ids(spark, path))
