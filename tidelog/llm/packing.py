"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become pieces of at most ``size`` tokens. The pieces are counted by length, at most
``size`` counts whatever the corpus, and best-fit-decreasing runs over those counts: equal bins
move together, so the plan has a few rows a length. Each planned run of slots is spread on the
executors and pieces take slots by joining on (length, rank within length).

Edge cases: null text is empty and a document of its end token alone; repeated ``doc_id`` rows are
packed each (ranks tie-break on the checksum); texts of any length are cut into pieces; an empty
table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, small_batches, stage, text_of
from .tokens import batches_of, tokenizer_file, word_ids

SIZE = 2048
END_ID = 0
#: Slots that one row of the spread plan makes, and the parts that all pieces are ranked in.
RUN = 4096
#: Characters encoded at once.
CALL_CHARS = 1_000_000
PARTS = 1024


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = "word_bpe_49k.json", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, the ids of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_file(vocabulary))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches_of(texts, CALL_CHARS):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for k, ids in enumerate(encode(texts[a:b]), a):
                    ids = np.append(ids, np.uint16(END_ID)).astype("<u4")
                    for p, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size]
                        for column, v in zip(out, (k, p, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=True):
                            column.append(v)
                columns = [keys.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5])]
                if keep_ids:
                    edges = np.concatenate(([0], np.cumsum(out[3]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(out[5]) if out[5] else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_of(docs)).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: rows (length, first rank, slots, first sequence, slots a sequence, offset).

    Bins of the same remaining room are kept as (first sequence, bins) runs. For each length, longest
    first, the fullest bins that still fit it take as many as they hold before the next.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, bins: int, each: int, space: int) -> None:
            nonlocal left, rank
            if bins and each:
                rows.append((length, rank, bins * each, first, each, size - space))  # noqa: B023
                rank, left = rank + bins * each, left - bins * each
                if space - each * length:  # noqa: B023
                    room[space - each * length].append((first, bins))  # noqa: B023

        for space in sorted(s for s in room if s >= length):
            each = space // length
            while left and room[space]:
                first, bins = room[space].pop()
                full = min(bins, left // each)
                put(first, full, each, space)
                if full < bins:
                    rest = left
                    put(first + full, 1 if rest else 0, rest, space)
                    if over := bins - full - bool(rest):
                        room[space].append((first + full + bool(rest), over))
            if not left:
                break
        each = size // length
        for bins, n in ((left // each, each), (1, left % each)):
            if bins and n:
                put(made, bins, n, size)
                made += bins
    return rows


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` is read twice, so it should be staged."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    rows = plan(histogram, size)
    total = sum(histogram.values())
    # a length gets parts by its share, so that no part holds much over 1/1024 of all pieces
    parts = {n: max(1, -(-c * PARTS // max(total, 1))) for n, c in histogram.items()}
    hot = F.create_map(F.lit(0), F.lit(1), *[F.lit(x) for p in parts.items() if p[1] > 1 for x in p])
    n_parts = F.coalesce(F.try_element_at(hot, F.col("length").cast("int")), F.lit(1)).cast("long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n_parts)
    ranked = rank_within(cut, ["length"], ["doc_id", "piece", "ids_crc32"], salt)
    # by Arrow, since rows of a list would start Python workers of their own beside those with the tables
    names = ["length", "rank0", "slots", "sequence0", "each", "offset0"]
    runs = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*(rows or [(0, 0, 0, 0, 1, 0)]), strict=True)], names=names))
    chunks = runs.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))))
    within = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * RUN, F.least((F.col("chunk") + 1) * RUN, F.col("slots")) - 1)))
    slots = within.select("length", (F.col("rank0") + F.col("k")).alias("rank"), (F.col("sequence0") + F.floor(F.col("k") / F.col("each"))).cast("long").alias("sequence_id"), (F.col("offset0") + F.pmod("k", "each") * F.col("length")).cast("long").alias("offset"))
    return ranked.join(slots, ["length", "rank"]).drop("rank")


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = "word_bpe_49k.json", keep_ids: bool = True) -> DataFrame:
    """The packed pieces. With ``keep_ids``, ``sequences`` makes them token sequences."""
    return place(stage(pieces(docs, size, vocabulary, keep_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids; a sequence holds at most ``size`` pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    out = pack(docs, keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
