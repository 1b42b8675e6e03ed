"""Token-id files of a corpus: written in ascending doc_id order, read back by any number of tasks.

The documents are range-partitioned by id and sorted; each task encodes its run and closes a file
every 8M ids, so its memory is bounded (some 20 MB of ids and 60 MB of the codec's tables). A Parquet index in the shared folder lists the files of
committed tasks. ``idcodec`` is the file format.

Edge cases: null text is empty (the end id alone); null ids come first; equal ids are ordered by
the text's hash and the text, so that tasks can share a hot id; rows that repeat both follow each
other; extra columns, whatever their names, are not read; an empty table writes no file and gives
no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, small_batches, stage, text_of
from .idcodec import BLOCK, LANES, pack_file, unpack_file
from .tokens import batches_of, tokenizer_file, word_ids
from .warc import filesystem

END_ID = 1
FILE_IDS = BLOCK * LANES
#: Ids of the documents handed on at once.
BATCH_IDS = 1 << 20
#: Rows and bytes of an Arrow batch of texts: larger than others', as what all texts of a call share is looked up once.
BATCH_ROWS, BATCH_BYTES = 2_000, "16m"
FILES = "part int, seq int, path string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the corpus's ids in files of about ``file_ids``; the staged index, one row a file."""
    folder = new_path(docs.sparkSession, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_file(vocabulary))
        task = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        rows: list[tuple] = []
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> None:
            nonlocal keys, held, size
            name = f"{task.partitionId():06d}-{len(rows):05d}-{task.taskAttemptId()}.ids"
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(pack_file(keys, held))
            rows.append((task.partitionId(), len(rows), f"{folder}/{name}", len(keys), size))
            keys, held, size = [], [], 0

        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            for a, b in batches_of(texts):
                for key, x in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    keys.append(key)
                    held.append(np.append(x, np.uint16(END_ID)))
                    size += len(held[-1])
                    if size >= file_ids:
                        close()
        if keys:
            close()
        if rows:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

    small_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stage(dealt.mapInArrow(write, FILES), "ids-index")


def with_starts(files: DataFrame) -> DataFrame:
    """The index with the number of ids before each file: within a part, then part by part (one row a task)."""
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n")).select("p", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    local = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
    return local.join(parts, F.col("part") == F.col("p")).select("path", (F.col("before") + F.col("inside")).alias("start"))


def read_ids(files: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, on demand, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    raw = f.read()
                rows: list[tuple] = []
                size = 0
                for doc, ids in unpack_file(raw):
                    wide = ids.astype("<u4")
                    rows.append((doc, start, len(ids), zlib.crc32(wide.tobytes()), *([wide.view(np.int32)] if keep_ids else [])))
                    start += len(ids)
                    size += len(ids)
                    if size >= BATCH_IDS:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # a task a file, however few bytes the index takes
    return with_starts(files).repartitionByRange(max(1, files.count()), "start").mapInArrow(read, schema)


def documents_ids(docs: DataFrame) -> DataFrame:
    """The contract's rows, read back from the files."""
    return read_ids(write_ids(docs), keep_ids=False)
