"""WARC archives: writing gzip members per record, and a splittable reader.

``write`` turns rows into records of ``.warc.gz`` files in a shared folder, one
file per task, put in place by a rename so that a repeated task replaces its own
file.  ``read`` deals byte ranges of all files to tasks.  A task looks in its
range for the gzip magic number, accepts a place only if a whole member decodes
there to a WARC record of the stated length whose payload has the stated digest
(without one to check, if the next member or the end follows), and from there
owns every record that starts inside its range.

Defined cases: a null payload is empty; null page ids are kept (their record
id has no number) and are never the target of a revisit while a copy has an id;
of repeated rows with the largest page id all are responses; an empty table
gives no files and no records.  Bytes that are no member are skipped.  A payload of
any length is one record, compressed and read in chunks but held whole.  Ties don't
arise: the largest page id of equal payloads is one number.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcomelens.llm.common import shared_path, spread
from outcomelens.session import shuffle_partitions

REVISIT_FROM = 1000  # payload bytes from which equal payloads become revisits
SPLIT = 8 << 20
_CHUNK = 1 << 18
_BATCH = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
RECORD = ("file string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html with digest, bytes and ``keeper``: the page a record revisits, else null."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    copies = (rows.filter(F.col("bytes") >= REVISIT_FROM).groupBy("digest")
              .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select("digest", "largest"))
    rows = spread(rows, copies, key="digest", by="page_id", how="left")
    return rows.withColumn("keeper", F.expr("CASE WHEN largest IS NOT NULL AND NOT (page_id <=> largest) THEN largest END")).drop("largest")


def member(page_id, url: str | None, html: str, keeper=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member."""
    payload = html.encode()
    name = "" if page_id is None else int(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", f"<{_URN}{name}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if keeper is not None:
        head += [("WARC-Refers-To", f"<{_URN}{int(keeper)}>"), ("WARC-Profile", _PROFILE)]
    block = http if keeper is not None else http + payload
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, folder: str) -> int:
    """Write a record per row of ``pages`` (page_id, url, html); returns the number of records."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get()
        store, root = _open(folder)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        draft, out, n = f"{root}/_draft-{task.taskAttemptId()}", None, 0
        for batch in batches:
            for i, url, html, keeper in zip(batch.page_id, batch.url, batch.html, batch.keeper):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                out.write(member(None if pd.isna(i) else i, url, html, None if pd.isna(keeper) else keeper))
                n += 1
        if out is not None:
            out.close()
            store.move(draft, name)
        yield pd.DataFrame({"n": [n]})

    rows = with_revisits(pages).withColumn("page_id", F.col("page_id").cast("string")).withColumn("keeper", F.col("keeper").cast("string"))
    return rows.select("page_id", "url", "html", "keeper").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def parse(data: bytes) -> dict | None:
    """A decoded member as a record, or None if it isn't one."""
    if not data.startswith(b"WARC/1."):
        return None
    top, found, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not found or not head.get("content-length", "").isdigit() or len(rest) != int(head["content-length"]) + 4:
        return None
    block = rest[:-4]
    kind = head.get("warc-type")
    payload, size = block, len(block)
    if "application/http" in head.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size = len(payload)
        if kind == "revisit":
            size, payload = (int(stated[1]) if stated else None), None
    digest = head.get("warc-payload-digest", "")
    try:
        digest = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest.startswith("sha1:") else None
    except ValueError:
        digest = None
    stated_digest = digest
    if payload is not None:
        digest = hashlib.sha1(payload).hexdigest()
    return {"record_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_digest": digest, "payload_bytes": size, "payload": payload,
            "checked": payload is not None and digest == stated_digest}


def _member(f, at: int, held: bytes, head_only: bool = False) -> tuple[bytes, int, bytes] | None:
    """Decode the member at ``at``; ``held`` are bytes already read from there.
    Gives its data, the place after it and the bytes held from there, or None."""
    d, out, read = zlib.decompressobj(31), [], at
    chunk = held
    try:
        while True:
            if not chunk:
                f.seek(read)
                chunk = f.read(_CHUNK)
                if not chunk:
                    return None
            read += len(chunk)
            out.append(d.decompress(chunk))
            if not b"WARC/1.".startswith(out[0][:7]) and out[0][:7]:
                return None
            if d.eof or head_only and out[0]:
                break
            chunk = b""
    except zlib.error:
        return None
    return b"".join(out), read - len(d.unused_data), d.unused_data


def records(f, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Records that start in [start, end) of an open file, with their offsets."""
    at, held, sure = start, b"", start == 0
    while at < end:
        got = _member(f, at, held)
        record = parse(got[0]) if got else None
        checked = record.pop("checked") if record else False
        if record and not sure and not checked:  # the first place in a range: the chain must go on behind it
            follows = _member(f, got[1], got[2], head_only=True) if got[1] < size else (b"WARC/1.", 0, b"")
            record = record if follows and follows[0].startswith(b"WARC/1.") else None
        if record:
            yield at, record
            _, at, held = got
            sure = True
            continue
        at, held, sure = _next_magic(f, at + 1, end), b"", False


def _next_magic(f, at: int, end: int) -> int:
    """Place of the next gzip magic number from ``at`` on, or ``end``."""
    while at < end:
        f.seek(at)
        chunk = f.read(min(_CHUNK, end - at + 2))
        place = chunk.find(b"\x1f\x8b\x08")
        if place >= 0:
            return min(at + place, end)
        if len(chunk) < 3:
            return end
        at += len(chunk) - 2
    return end


def read(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """All records of the ``.warc.gz`` files under a folder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for uri, size, start in zip(batch.path, batch.length, batch.start):
                store, path = _open(uri)
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for at, r in records(f, size, start, min(start + split, size)):
                        rows.append({"file": uri, "offset": at} | r)
                        held += len(r["payload"] or b"") + 500
                        if held >= _BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
             .filter("length > 0"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    # by number, so that the few small rows of ranges aren't brought together in one task
    return ranges.repartition(shuffle_partitions(spark), "path", "start").mapInPandas(run, RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """Contract columns of the archive query: write all pages, read the archives back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    number = F.col("record_id").substr(len(_URN) + 1, 20)
    kept = F.substring("refers_to", len(_URN) + 1, 20).cast("long")
    if not write(pages, folder):
        found = spark.createDataFrame([], RECORD)
    else:
        found = read(spark, folder)
    return found.select(F.when(number != "", number.cast("long")).alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", kept.alias("refers_to"))
