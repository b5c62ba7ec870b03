"""WARC archives as seekable Zstandard bundles.

A bundle is a valid Zstandard stream: independent frames of a few records each, then a skippable frame whose payload is
a seek table (compressed and plain size of each frame). An index maps each record's id to its bundle, frame and offset
inside the plain frame, so that one record is read by decompressing one frame. Bundles are rows of a table with a binary
column, written where all executors see them; export() turns rows into files.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved, with_row_number

#: Plain bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Skippable frame and footer marks of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def record(record_id: str, kind: str, url: str, payload: bytes, size: int, digest: str, page_id: str | None, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its full length and digest stay in the header.

    WARC-Target-URI is the URL with its white space and control characters percent-encoded; the URL itself and the ids
    are headers of their own as JSON, which has no line breaks.
    """
    target = "".join(quote(c) if c <= " " or c.isspace() or not c.isprintable() else c for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:seqloom:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-URL: {json.dumps(url)}", f"X-Page-ID: {json.dumps(page_id)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {json.dumps(refers_to)}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that starts at a byte of a plain frame."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    headers = dict(line.split(": ", 1) for line in rest)
    body = end + 4
    stop = body + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the WARC record at byte {at} doesn't end where it says")
    return headers, data[body:stop], stop + 4


class BundleWriter:
    """Groups records into frames and frames into bundles; close() returns the finished bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.z = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.reset()

    def reset(self) -> None:
        self.frames, self.sizes, self.open, self.open_bytes, self.index, self.bytes = [], [], [], 0, [], 0

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.sizes), self.open_bytes))
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            packed = self.z.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int]]]:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        out, index = b"".join(self.frames) + table, self.index
        self.reset()
        return out, index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the bundle's footer."""
    n, _, mark = struct.unpack("<IBI", bundle[-9:])
    start = len(bundle) - 9 - 8 * n - 8
    if mark != SEEKABLE or struct.unpack("<I", bundle[start : start + 4])[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", bundle, start + 8 + 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    import zstandard

    at, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(1, plain))


def read_at(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index."""
    return parse_record(read_frame(bundle, seek_table(bundle), frame), offset)[:2]


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """row, page_id, url, html, payload_bytes, payload_digest, revisit, refers_to (the id that the row revisits; null: it is a response).

    Of rows with equal payloads of at least least bytes, that with the largest id is the response (null ids are
    smallest; of equal largest ids one row), all others revisit it. Other columns of pages are ignored, whatever their names.
    """
    row = free_name(pages, "warc_row")
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    d = with_row_number(pages, row).select(F.col(row).alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    d = d.withColumn("payload_bytes", F.octet_length(data)).withColumn("payload_digest", F.sha1(data))
    groups = d.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("top")).where("n > 1")
    tops = saved(groups.select(F.col("payload_digest").alias("digest"), F.col("top.page_id").alias("top_id"), F.col("top.row").alias("top_row")))
    out = d.join(tops, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("top_row").isNotNull() & (F.col("top_row") != F.col("row"))
    return out.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("top_id"))).drop("digest", "top_id", "top_row")


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row of pages and returns the bundles: bundle_id, bundle binary, index array<struct<record_id, frame, offset>>.

    A null payload is empty, a null URL too. Ids may be null, of any text, or repeat; a record's id is its row's number.
    Other columns of pages are ignored. An empty table gives no bundles.
    """
    d = revisits(pages, id_col, url_col, html_col)
    d = d.select("row", F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("revisit"), F.lit("")).otherwise(F.coalesce("html", F.lit(""))).alias("html"), "payload_bytes", "payload_digest", "revisit", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, part, n = BundleWriter(frame_bytes), TaskContext.get().partitionId(), 0

        def closed() -> pd.DataFrame:
            bundle, index = w.close()
            return pd.DataFrame({"bundle_id": [f"{part:06d}-{n:06d}"], "bundle": [bundle], "index": [[{"record_id": r, "frame": f, "offset": o} for r, f, o in index]]})

        for b in batches:
            for row, page, url, html, size, sha1, again, refers in b.itertuples(index=False, name=None):
                w.add(str(row), record(str(row), "revisit" if again else "response", url or "", html.encode(), size, sha1, page, refers))
                if w.bytes >= bundle_bytes:
                    yield closed()
                    n += 1
        if w.index:
            yield closed()

    return saved(d.mapInPandas(run, "bundle_id string, bundle binary, index array<struct<record_id:string,frame:int,offset:long>>"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: bundle_id, frame, offset, record_id, record_type, url, page_id, refers_to (texts), payload_bytes, payload_digest, payload.

    Records are read where the index says, each frame decompressed once by the seek table. A record that isn't there,
    bytes that no record covers, and a response that doesn't match its digest are errors. Bundles without records, or
    none, give no rows; null ids come back as null, repeated ones as often as they were written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, bundle, index in zip(b["bundle_id"], b["bundle"], b["index"], strict=True):
                table, places = seek_table(bundle), defaultdict(list)
                for i in index:
                    places[i["frame"]].append((i["offset"], i["record_id"]))
                for frame in range(len(table)):
                    data, at, rows = read_frame(bundle, table, frame), 0, []
                    for offset, record_id in sorted(places[frame]):
                        h, payload, end = parse_record(data, offset)
                        if offset != at or h["WARC-Record-ID"] != f"<urn:seqloom:{record_id}>":
                            raise ValueError(f"index of {name}: no record {record_id} at byte {offset} of frame {frame}")
                        size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response":
                            size, real = len(payload), hashlib.sha1(payload).hexdigest()
                            if real != digest:
                                raise ValueError(f"digest of record {record_id}")
                        rows.append((name, frame, offset, record_id, h["WARC-Type"], json.loads(h["X-URL"]), json.loads(h["X-Page-ID"]), json.loads(h.get("X-Refers-To-Page-ID", "null")), size, digest, payload))
                        at = end
                    if at != len(data):
                        raise ValueError(f"index of {name}: frame {frame} has more bytes than records")
                    yield pd.DataFrame(rows, columns=["bundle_id", "frame", "offset", "record_id", "record_type", "url", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return bundles.select("bundle_id", "bundle", "index").mapInPandas(run, "bundle_id string, frame int, offset long, record_id string, record_type string, url string, page_id string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, bundle_id, frame, offset of every record."""
    return bundles.select("bundle_id", F.explode("index").alias("i")).select(F.col("i.record_id").alias("record_id"), "bundle_id", F.col("i.frame").alias("frame"), F.col("i.offset").alias("offset"))


def export(bundles: DataFrame, folder: str) -> None:
    """Writes bundles as files to a folder of this machine, one at a time. For use outside clusters."""
    os.makedirs(folder, exist_ok=True)
    for r in bundles.select("bundle_id", "bundle").toLocalIterator():
        with open(os.path.join(folder, f"{r.bundle_id}.warc.zst"), "wb") as f:
            f.write(r.bundle)


__all__ = ["BundleWriter", "export", "parse_record", "read_at", "read_bundles", "record", "record_index", "revisits", "seek_table", "write_bundles"]
