"""Token ids of documents as Simple-8b files in ascending id order, and their reader.

Texts are range-partitioned and sorted by id, encoded in the task that holds them, and written as files of
a bounded number of ids to the given (shared) folder. A task writes under a name of its attempt and then
renames; a task that runs again replaces its files by equal ones. Files are named by partition and
sequence, so names sort in id order. A table of files (one row each) gives every file's first position.

Defined cases: a null text has only its end id; rows with a null id come first; rows of one id are ordered by
their text's hash; an empty table gives no file and reads as an empty table; only the named columns are read.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsloom.llm import simple8b
from oddsloom.llm.byte_pair import encoder
from oddsloom.session import materialize

FILE_IDS = 1 << 21


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files; returns their table: file, n_docs, n_ids, first_id (position)."""

    def flush(name: str, keys: list, parts: list[bytes]) -> pa.RecordBatch:
        from pyarrow import fs

        ids = np.frombuffer(b"".join(parts), "<u4")
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        data = simple8b.write_file(keys, lengths, ids)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        scratch = posixpath.join(root, f"_{name}.{TaskContext.get().taskAttemptId()}")
        with store.open_output_stream(scratch) as out:
            out.write(data)
        store.move(scratch, posixpath.join(root, name))
        return pa.RecordBatch.from_pydict(
            {"file": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        partition = TaskContext.get().partitionId()
        keys: list = []
        parts: list[bytes] = []
        held = files = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for key, ids in zip(rows[0].to_pylist(), encode(rows[1].to_pylist())):
                    keys.append(key)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= file_ids:
                        yield flush(f"part-{partition:06d}-{files:06d}.s8b", keys, parts)
                        keys, parts, held, files = [], [], 0, files + 1
        if keys:
            yield flush(f"part-{partition:06d}-{files:06d}.s8b", keys, parts)

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    table = materialize(ordered.mapInArrow(run, "file string, n_docs long, n_ids long"), "token-files")
    # One row for each file: a running sum over a table that is small beside the tokens.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({"first_id": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})


def read(spark: SparkSession, folder: str, table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch[0], batch[1]):
                reader = simple8b.Reader(content.as_buffer())
                ids = reader.ids().astype("<u4")
                ends = np.cumsum(reader.lengths)
                starts = ends - reader.lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([posixpath.basename(path.as_py())] * len(ends), pa.string()),
                        pa.array(reader.doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(reader.lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["file", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    rows = files.select("path", "content").mapInArrow(
        run, "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(table.select("file", "first_id"), "file").select(
        "doc_id",
        (F.col("first_id") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
