"""Dictionary-compressed WARC archives (operator 8).

Pages become WARC 1.1 records: a response record with the whole payload, or,
where another page has the same payload (SHA-256) and a larger id, a revisit
record that refers to that page.  Archives follow the ``.warc.zst`` layout: a
Zstandard dictionary, made from records of this very collection, sits in a
leading skippable frame, and every record is a frame of its own, so a reader
can start at any record (``offset`` is its place in the file).

Each task writes its own archives, rolled over at ``ARCHIVE_BYTES``, under new
names, into the folder given (any file system pyarrow knows), and returns one
manifest row per archive.  The manifest is a table that Spark commits: it
names the archives of successful task attempts only, so a lost executor or a
repeated attempt leaves at most an unnamed file.  Reading back starts from the
manifest, an archive at a time, and checks every payload against its digest.

The dictionary comes from a bounded sample, the ``SAMPLE_RECORDS`` records
of smallest hash, ``SAMPLE_BYTES`` of each; every record is written whole.
Where the sampled records are too few, or too alike, for Zstandard to train a
dictionary, their raw content is the dictionary (frames then carry no id).

Scale: payloads are read twice, once for their digests and once to be written.
Only digests that occur twice are joined back; while these are few the
payloads are not shuffled at all.

Defined results: a null payload is the empty payload; a null id counts as
smaller than any other, and pages without any id are responses; several rows
of the largest id (ties, repeated rows) are all responses; a very long payload
is one record, held whole by the task that writes or reads it; an empty table
gives no archive; further columns, whatever their names, are not archived.
Line breaks in an address are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import small_side
from tenure.session import stage_path, stage_shared

# Fixed value: the skippable frame that holds a .warc.zst dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
SAMPLE_RECORDS, SAMPLE_BYTES = 500, 16_384
DICTIONARY_BYTES = 32_768
LEVEL = 3
READ_BYTES = 128 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"       # the tables carry no capture time

MANIFEST = "archive string, records bigint, bytes bigint"
RECORD = ("id string, url string, payload_bytes bigint, payload_digest string, record_type string,"
          " refers_to string, archive string, offset bigint")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
              f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}",
              "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m.group()):02X}", url or ""),
              f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page: str | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def parse(raw: bytes) -> dict:
    """Fields of one record; raises where a payload does not have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if lines[0] != "WARC/1.1" or fields["WARC-Type"] == "response" and (
            len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"id": fields["WARC-Record-ID"][10:-1] or None, "url": fields["WARC-Target-URI"], "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": fields["WARC-Refers-To"][10:-1] if "WARC-Refers-To" in fields else None}


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes; the records' raw content where they are too few or too
    alike to train one, and none without records."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class Archive:
    """Writes one archive: the dictionary's skippable frame, then a frame for each record."""

    def __init__(self, folder: str, dictionary: bytes):
        self.system, base = _open_folder(folder)
        self.system.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        # Without this, the suffix would make pyarrow compress the file once more, as one frame.
        self.out = self.system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.bytes = self.records = 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        if dictionary:
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _write(self, frame: bytes) -> None:
        self.out.write(frame)
        self.bytes += len(frame)

    def add(self, raw: bytes) -> None:
        self._write(self.compress(raw))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.name, self.records, self.bytes


def read_archive(folder: str, name: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record, holding one record and one read buffer at a time."""
    system, base = _open_folder(folder)
    with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
        buffer, offset, dictionary = stream.read(READ_BYTES), 0, None
        if len(buffer) >= 8 and struct.unpack("<I", buffer[:4])[0] == DICTIONARY_MAGIC:
            size = 8 + struct.unpack("<I", buffer[4:8])[0]
            while len(buffer) < size and (more := stream.read(READ_BYTES)):
                buffer += more
            dictionary, buffer, offset = zstandard.ZstdCompressionDict(buffer[8:size]), buffer[size:], size
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        while buffer or (buffer := stream.read(READ_BYTES)):
            frame, parts, used = decompressor.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(buffer))
                used += len(buffer)
                if frame.eof:
                    break
                if not (buffer := stream.read(READ_BYTES)):
                    raise ValueError(f"{name} ends inside a record")
            buffer = frame.unused_data
            used -= len(buffer)
            yield offset, b"".join(parts)
            offset += used


def assign(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page, url, payload, refers_to): refers_to is the largest id of an equal payload, where it is another's."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload")
                        ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only digests that occur twice take part in the join; their rows meet one row each.
    keepers = small_side(stage_shared(rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(
        F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "keepers"))
    return rows.join(keepers, "digest", "left").select(
        F.col("page").cast("string").alias("page"), "url", "payload",
        F.when(F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper")),
               F.col("keeper").cast("string")).alias("refers_to"))


def sample(pages: DataFrame, payload_col: str) -> list[bytes]:
    """The first ``SAMPLE_BYTES`` of the ``SAMPLE_RECORDS`` different payloads of smallest hash.  Hashes are
    chosen first, so that only the chosen payloads travel."""
    payload = F.col(f"`{payload_col}`").cast("string")
    hashed = pages.where(payload.isNotNull()).select(
        F.xxhash64(payload).alias("h"), F.substring(payload.cast("binary"), 1, SAMPLE_BYTES).alias("payload"))
    chosen = stage_shared(hashed.select("h").distinct().orderBy("h").limit(SAMPLE_RECORDS), "sample_hashes")
    rows = hashed.join(chosen, "h", "left_semi").groupBy("h").agg(F.first("payload").alias("payload")).collect()
    return [bytes(r["payload"]) for r in sorted(rows, key=lambda r: r["h"])]


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` into archives below ``folder``; the manifest, a written table with a row per archive."""
    dictionary = train_dictionary([record("0", "http://", p, None) for p in sample(pages, payload_col)])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)      # DICTIONARY_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                archive = archive or Archive(folder, shared.value)
                archive.add(record(page, url, payload, refers_to))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())],
                                         names=["archive", "records", "bytes"])

    return stage_shared(assign(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in the manifest, read back and checked."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.int64() if f.endswith("bigint") else pa.string() for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for offset, raw in read_archive(folder, name):
                    rows.append(parse(raw) | {"archive": name, "offset": offset})
                    if len(rows) == 1000:
                        yield _rows(rows, names, types)
                        rows = []
                yield _rows(rows, names, types)

    # An archive per task: their number follows the bytes written.
    dealt = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return dealt.mapInArrow(run, RECORD)


def _rows(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   folder: str | None = None, **options) -> DataFrame:
    """Write the archives (by default below the session's shared folder), read them back, a row per page."""
    folder = folder or stage_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    back = read(write(pages, folder, id_col, url_col, payload_col, **options), folder)
    return back.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"), "archive", "offset")
