"""Token counts by a separator scan over flat token files.

A flat file is nothing but little-endian 16-bit ids, each document closed by the end-of-document id; it has no index and no
header.  Files are read in blocks of equal length, wherever documents begin or end.  A first pass finds the separators of each
block with numpy and sums a block up in three numbers.  A two-level prefix scan, inside each file and over files, tells every
block how many documents end before it and where the last of those ends, so that the second pass counts the tokens of documents
across blocks and files without any shuffle of documents.

Files are reached through pyarrow's file systems (local and shared folders, HDFS, S3, GCS), by tasks as well as the driver.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm._shared import new_path, saved

END_ID = 50256
BLOCK_BYTES = 8 << 20
ID = np.dtype("<u2")


def _open(uri: str):
    """(file system, path) of a location."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


_encodings: dict[tuple[str, str, int], object] = {}


def encoding(ranks_path: str, pattern: str, end_id: int = END_ID):
    """The worker's encoding from a file of ranks, which every executor has; a ValueError if its ids and ``end_id`` cannot be told apart in 16 bits."""
    import tiktoken

    key = ranks_path, pattern, end_id
    if key not in _encodings:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}
        if max(end_id, *ranks.values()) > np.iinfo(ID).max or end_id < 0:
            raise ValueError(f"ids of {ranks_path} or the end id {end_id} do not fit {8 * ID.itemsize} bits")
        if end_id in ranks.values():
            raise ValueError(f"the end id {end_id} is an id of {ranks_path}")
        _encodings[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def write_flat(docs: DataFrame, folder: str, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` as a flat file for each partition, in the order of their rows, and returns which document is which: ``file_no``, ``nth``, ``doc_id``.

    A null text is empty; null ids and repeated rows are documents like others, and a very long text is written whole.  Nothing is shuffled.  A file appears under
    its name when it is whole, so a task that runs again after its executor was lost writes the same file once more; an attempt that fails deletes what it wrote.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        own = f"{path}/_{number}-{uuid.uuid4().hex}"
        e = encoding(ranks_path, pattern, end_id)
        at = 0
        try:
            with system.open_output_stream(own) as out:
                for batch in batches:
                    for text in batch.column(1).to_pylist():
                        ids = e.encode_ordinary(text) if text else []
                        out.write(np.array([*ids, end_id], ID).tobytes())
                    n = len(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0)], ["file_no", "nth", "doc_id"])
                    at += n
        except BaseException:
            system.delete_file(own)
            raise
        if at:
            system.move(own, f"{path}/part-{number:06d}.ids")
        else:
            system.delete_file(own)

    return saved(rows.mapInArrow(run, f"file_no int, nth long, doc_id {kind}"), "flat-names")


def flat_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: ``file_no``, ``path``, ``at`` (byte offset), ``size`` and ``first`` (ids in all blocks before it).

    The driver lists names and sizes, and no contents.
    """
    from pyarrow import fs

    block_bytes -= block_bytes % ID.itemsize
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files, first = [], 0
    for f in sorted((f for f in found if f.is_file and f.base_name.endswith(".ids")), key=lambda f: f.base_name):
        files.append((int(f.base_name.split("-")[1].split(".")[0]), f"{folder}/{f.base_name}", f.size, first))
        first += f.size // ID.itemsize
    rows = spark.createDataFrame(files, "file_no int, path string, bytes long, before long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))).alias("at")
    blocks = rows.where("bytes > 0").select("file_no", "path", "bytes", "before", at)
    return blocks.select("file_no", "path", "at", F.least(F.lit(block_bytes).cast("long"), F.col("bytes") - F.col("at")).alias("size"), (F.col("before") + (F.col("at") / ID.itemsize).cast("long")).alias("first"))


def _ids(path: str, at: int, size: int) -> np.ndarray:
    system, name = _open(path)
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read_at(size, at), ID)


def count_tokens(blocks: DataFrame, *, end_id: int = END_ID) -> DataFrame:
    """``file_no`` and ``nth`` (file and place there of the document's end), ``start`` and ``n_tokens`` (with the end id) of every document.

    Ids after the last separator of all are no document.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.flatnonzero(_ids(row["path"], row["at"], row["size"]) == end_id)
                last = row["first"] + int(ends[-1]) + 1 if len(ends) else None
                yield pa.RecordBatch.from_pylist([row | {"n_ends": len(ends), "last_end": last}], pa.schema([*batch.schema, ("n_ends", pa.int64()), ("last_end", pa.int64())]))

    columns = "file_no int, path string, at long, size long, first long"
    spread = blocks.select("file_no", "path", "at", "size", "first").repartition(F.col("path"), F.col("at"))
    sums = saved(spread.mapInArrow(summed, f"{columns}, n_ends long, last_end long"), "flat-blocks")
    # A separator's end is the greatest so far, so the last end before a block is a running maximum.
    earlier = Window.partitionBy("file_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.groupBy("file_no").agg(F.max("last_end").alias("_end"))
    before = files.select("file_no", F.max("_end").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)).alias("_file_end"))
    inside = sums.select("*", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("nth"), F.max("last_end").over(earlier).alias("_end"))
    told = inside.join(before, "file_no").select(*(c.split()[0] for c in columns.split(", ")), "nth", F.coalesce("_end", "_file_end", F.lit(0)).alias("last"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.flatnonzero(_ids(row["path"], row["at"], row["size"]) == end_id) + row["first"] + 1
                starts = np.concatenate(([row["last"]], ends))[:-1]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["file_no"], np.int32)), pa.array(row["nth"] + np.arange(n)), pa.array(starts.astype(np.int64)), pa.array((ends - starts).astype(np.int64))], ["file_no", "nth", "start", "n_tokens"])

    return told.repartition(F.col("path"), F.col("at")).mapInArrow(counted, "file_no int, nth long, start long, n_tokens long")


def document_tokens(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id`` and ``n_tokens`` (with the end id) of every row of ``docs``, scanned from flat files of its texts.

    Null and empty texts have the end id alone; rows with equal or null ids give a row each; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "flat-ids")
    names = write_flat(docs, folder, ranks_path, pattern, id_col=id_col, text_col=text_col)
    # Both sides have a row for each document: neither is ever broadcast.
    return names.join(count_tokens(flat_blocks(spark, folder, block_bytes)).hint("merge"), ["file_no", "nth"]).select("doc_id", "n_tokens")
