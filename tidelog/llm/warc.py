"""WARC archives: write records and their index, then read records back by coalesced byte ranges.

``write_archives`` writes a gzip member a record and returns the index (file, offset, length,
URL, digest, page id), which is a Parquet table in the shared folder. ``read_records`` takes any
selection of the index: its rows are dealt out by file and 8 MB of offset, sorted, joined into
ranges where gaps are small, and each range is one read. Files carry the task attempt in their
name and only a committed task's rows are in the index, so lost attempts leave nothing behind
that is read.

Edge cases: null html is an empty payload; a null or odd URL is percent-encoded in the record and
kept as it is in the index; null page ids are always responses; of rows equal in page id and
payload one is the response and the others revisit it.
"""

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, stage, text_of

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30
CHUNK_BYTES = 8 << 20
GAP_BYTES = 64 << 10
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def classify(pages: DataFrame) -> DataFrame:
    """Pages with digest, occurrence and, for revisits, the page whose record they refer to.

    Only (page, digest) pairs meet by digest; the payloads are shuffled once, by page.
    """
    html = text_of(pages, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    pairs = rows.where(F.col("n") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    kept = pairs.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    linked = pairs.distinct().join(kept, "digest")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    joined = rows.join(linked, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull() & ((F.col("page_id") != F.col("refers_to")) | (F.col("copy") > 1))
    return joined.withColumn("refers_to", F.when(revisit, F.col("refers_to")))


def _record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 1)}", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a gzip member."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])} | {"version": lines[0]}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame) -> DataFrame:
    """Write the pages' records into archives in the shared folder; the index, staged."""
    folder = new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        stream, name, at, files = None, "", 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if stream is None or at >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at, files = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files:03d}.warc.gz", 0, files + 1
                    stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["copy"], r["refers_to"])
                stream.write(raw)
                rows.append((f"{folder}/{name}", at, len(raw), r["url"], r["digest"], r["page_id"], "response" if r["refers_to"] is None else "revisit"))
                at += len(raw)
            if rows:
                cols = [*zip(*rows, strict=True)]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if stream is not None:
            stream.close()

    rows = classify(pages).select("page_id", "url", "html", "digest", F.col("copy"), "refers_to")
    return stage(rows.mapInArrow(write, INDEX), "warc-index")


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, positions) of the reads for sorted records: neighbours within ``gap`` share one."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - out[-1][1] <= gap:
            start, end, members = out[-1]
            members.append(i)
            out[-1] = (start, max(end, o + n), members)
        else:
            out.append((o, o + n, [i]))
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The selected records of an index. ``payloads=False`` leaves the payload null once it is checked."""
    import hashlib

    def read(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        fs, path = filesystem(key[0])
        rows = []
        offsets, lengths, urls = pdf["offset"].tolist(), pdf["length"].tolist(), pdf["url"].tolist()
        with fs.open_input_file(path) as f:
            for start, end, members in ranges(offsets, lengths):
                chunk = f.read_at(end - start, start)
                for i in members:
                    fields, http, payload = parse_record(chunk[offsets[i] - start : offsets[i] - start + lengths[i]])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"digest mismatch in {key[0]} at {offsets[i]}")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, urls[i], kind, int(refers) if refers else None, size, digest, payload if payloads and kind == "response" else None))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")], dtype=object)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    dealt = index.select("file", "offset", "length", "url", F.floor(F.col("offset") / CHUNK_BYTES).alias("chunk"))
    return dealt.groupBy("file", "chunk").applyInPandas(read, RECORD)


def archive_pages(pages: DataFrame) -> DataFrame:
    """The contract's rows, read back from the archives."""
    out = read_records(write_archives(pages), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
