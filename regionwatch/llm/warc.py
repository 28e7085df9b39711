"""WARC archives of web pages: written with one gzip member per record, read back sequentially.

Every task writes archives of its own under the shared folder and returns a row for each; only rows of tasks that
Spark accepted are in the manifest, so files of lost or repeated tasks are never read. The reader decompresses one
member at a time in small steps, frames the payload by Content-Length and verifies its digest.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest page_id is a response, the others
are revisits that name it and carry no block. Smaller ones are all responses.

Defined results: a null html is an empty payload; a null url is the empty string; repeated rows of the smallest
page_id are all responses; rows with a null page_id refer to the smallest id of their group, or are responses if it
has none; an empty table gives archives of no records; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import work_folder
from .common import join_unique, materialise, slices

MIN_BYTES = 0
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
GZIP = 31  # zlib's window bits for a gzip header

RESPONSE, REVISIT = "response", "revisit"


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload: bytes  # of a revisit: empty
    payload_bytes: int  # of the full payload
    payload_digest: str


class ArchiveError(ValueError):
    """An archive that is cut off, or whose record does not match its own length or digest."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# --- writing ------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. Numbers of pages stand in a header field of this library's own."""
    block = b"" if revisit else payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {REVISIT if revisit else RESPONSE}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return press.compress(raw) + press.flush()


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) for every page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # payloads too small to be revisits get a null key, which meets nothing
    rows = rows.withColumn("key", F.when(F.length("payload") >= min_bytes, F.sha1("payload")))
    firsts = materialise(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = join_unique(rows, firsts, "key", "n", total)
    alone = rows.where("key IS NULL").withColumn("first", F.lit(None).cast("long"))
    both = named.unionByName(alone).drop("key")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return both.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages under ``folder`` and returns the manifest (path, n_records, n_bytes), itself written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([records], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for b in slices(batches, 100):
            for row in b.to_pylist():
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                size += out.write(record_bytes(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"]))
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    plan = planned(pages, min_bytes).select("page_id", "url", "payload", "refers_to", "revisit")
    return materialise(plan.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


# --- reading ------------------------------------------------------------------


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn; a member must be read to its end before the next."""
    rest = b""

    def pieces(press) -> Iterator[bytes]:
        nonlocal rest
        while not press.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                raise ArchiveError("the archive ends within a record")
            piece = press.decompress(rest, CHUNK)
            rest = press.unused_data if press.eof else press.unconsumed_tail
            if piece:
                yield piece

    while rest := rest or stream.read(CHUNK):
        yield pieces(zlib.decompressobj(GZIP))


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    for member in members(stream):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise ArchiveError("a record without an end of its header")
            held += piece
        lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ArchiveError(f"not a record: {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = int(head["content-length"])
        del held[: end + 4]
        hasher = hashlib.sha1(held[:length])
        for piece in member:
            hasher.update(piece[: max(0, length - len(held))])
            held += piece
        if held[length:] != b"\r\n\r\n":
            raise ArchiveError("a block that is not as long as its Content-Length says")
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        if kind == RESPONSE and stated != base64.b32encode(hasher.digest()).decode("ascii"):
            raise ArchiveError(f"a payload that does not match its digest {stated}")
        number = lambda k: int(head[k]) if head.get(k, "None") != "None" else None
        yield Record(number("x-page-id"), head["warc-target-uri"], kind, number("x-refers-to-page-id"), bytes(held[:length]), int(head["x-payload-length"]), stated)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a record of the archives that the manifest lists."""
    fields = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

        def batch(held: list[Record]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[names_at[n]] for r in held], k) for n, k in zip(names, kinds)], names)

        names_at = {n: Record._fields.index(n) for n in names}
        for b in batches:
            for path, stated in zip(b["path"].to_pylist(), b["n_records"].to_pylist()):
                n, size, held = 0, 0, []
                with store.open_input_stream(path, compression=None) as stream:
                    for record in read_archive(stream):
                        n += 1
                        size += len(record.payload)
                        held.append(record)
                        if len(held) >= 1000 or size >= CHUNK * 64:
                            yield batch(held)
                            size, held = 0, []
                if held:
                    yield batch(held)
                if n != stated:
                    raise ArchiveError(f"{path} holds {n} records, not {stated}")

    # one archive a task
    listed = manifest.repartition(max(1, manifest.count()), "path")
    return listed.mapInArrow(run, fields)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes all pages to archives and reads the archives back."""
    folder = work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder)
