"""WARC archives, index first.

Each task writes its rows as records, one gzip member each, to files of its own in the shared folder, and gives back
an index row for each: file, offset, length, URL and digest. The index is a table, written by Spark's committer, so a
task that runs again leaves at most an unreferenced file. Reading takes any selection of index rows, sorts them by
file and offset, coalesces neighbours into one byte-range read and parses the records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, new_path, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


@dataclass(frozen=True)
class Settings:
    """revisit_from: least payload bytes for a revisit record; file_bytes: where a new file begins; gap, read_bytes: how ranges coalesce."""

    revisit_from: int = 100
    file_bytes: int = 256 << 20
    level: int = 5
    gap: int = 64 << 10
    read_bytes: int = 8 << 20
    date: str = "1970-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers only and names the page that has the payload."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Headers, payload (None for a revisit) and the payload's length as the HTTP headers have it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return headers, payload if headers["WARC-Type"] == "response" else None, length


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archive(pages: DataFrame, folder: str | None = None, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record and return the index, a table beside the archive files.

    Of records with equal payloads of at least revisit_from bytes, those with the smallest id are responses and the
    others revisit it; shorter ones are all responses. A null html is an empty payload, a null url has no target
    header, a null id is never an original (rows without any id in their group are responses). Rows that repeat the
    smallest id are responses each. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = rows.where(F.octet_length("html") >= s.revisit_from)
    # Only digests that occur more than once leave this aggregate; as a table its size is known to the planner.
    again = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    again, scratch = written(again, "warc-repeats")
    long_enough = F.octet_length("html") >= s.revisit_from
    rows = rows.join(again, "payload_digest", "left").withColumn("refers_to", F.when(long_enough & F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first"))), F.col("first")))
    rows = rows.select("page_id", "url", "html", "payload_digest", "refers_to")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = filesystem(folder)
        context, out, at, files = TaskContext.get(), None, 0, 0
        try:
            for pdf in parts:
                index = []
                for page, url, html, digest, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["payload_digest"], pdf["refers_to"], strict=True):
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    payload = html.encode("utf-8", "surrogatepass")
                    packer = zlib.compressobj(s.level, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, refers, s.date)) + packer.flush()
                    if out is None or at >= s.file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(base, recursive=True)
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files}.warc.gz"
                        out, at, files = store.open_output_stream(f"{base}/{name}", compression=None), 0, files + 1
                    out.write(member)
                    index.append((page, url, digest, len(payload), "response" if refers is None else "revisit", refers, name, at, len(member)))
                    at += len(member)
                frame = pd.DataFrame(index, columns=names)
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    rows.mapInPandas(run, INDEX).write.parquet(f"{folder}/index")
    discard(spark, scratch)
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, s: Settings = Settings(), ranges: int | None = None) -> DataFrame:
    """The records that the index rows name, with payload (null for a revisit) and what their own headers say.

    Reads of one file that lie within gap bytes of each other are one read of up to read_bytes.
    """
    spark = index.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = index.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    schema = T.StructType([*chosen.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("header_type", T.StringType()), T.StructField("header_digest", T.StringType()), T.StructField("header_bytes", T.LongType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, name = None, None
        for pdf in parts:
            pdf = pdf.reset_index(drop=True)
            n, rows = 0, list(zip(pdf["folder"], pdf["file"], pdf["offset"], pdf["length"], strict=True))
            while n < len(rows):
                folder, file, start, length = rows[n]
                end, last = start + length, n + 1
                while last < len(rows) and rows[last][1] == file and rows[last][2] - end <= s.gap and rows[last][2] + rows[last][3] - start <= s.read_bytes:
                    end, last = max(end, rows[last][2] + rows[last][3]), last + 1
                if name != (folder, file):
                    store, base = filesystem(folder)
                    opened, name = store.open_input_file(f"{base}/{file}"), (folder, file)
                data = opened.read_at(end - start, start)
                found = []
                for _, _, at, size in rows[n:last]:
                    headers, payload, full = parse(zlib.decompress(data[at - start : at - start + size], 31))
                    found.append((payload, headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), full))
                out = pdf.iloc[n:last].copy()
                for k, column in enumerate(("payload", "header_type", "header_digest", "header_bytes")):
                    out[column] = [x[k] for x in found]
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
                n = last

    return chosen.mapInPandas(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, s: Settings = Settings()) -> DataFrame:
    """Write all pages, read all records back; sizes and digests are those of what was read, a revisit's those of its headers."""
    back = read_records(write_archive(pages, folder, s), s)
    return back.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "header_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "header_digest").alias("payload_digest"),
        F.col("header_type").alias("record_type"),
        "refers_to", "file", "offset", "length",
    )
