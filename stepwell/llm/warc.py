"""WARC archives: a writer with revisit records and a splittable reader.

Writing: every record is a gzip member of its own.  A payload that occurs more
than once and has at least MIN_REVISIT bytes is stored with the smallest page id
and the others are revisit records.  Tasks write to names of their own in the
shared folder and report them through a manifest table, so files of failed or
repeated attempts are never read.

Reading: a file is cut into byte ranges.  A task looks for the gzip magic in its
range, accepts a candidate only if its first bytes decode to a WARC header, then
follows members one after the other.  A record belongs to the range in which it
starts; its end may lie beyond.  Any range can be read alone and again.  Nothing
is passed over: a file must begin with a record, each record be followed by one or
by the file's end, and each be whole, else reading fails; the task of a range
looks at the head of the first record after it, so no damage lies between ranges.

Defined cases: a null html is an empty payload, a null url an empty target; a
very long payload is one record; rows that repeat the smallest page id of a
payload are responses all; a null page id stays null; short payloads (also empty
ones) are always responses; an empty table gives no archive and no row; a
truncated or corrupt file is an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .id_filter import IdFilter
from .staging import filesystem, new_dir, stage

MIN_REVISIT = 100
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
WARC_DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header_text(value: str) -> str:
    """A header value without line ends."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def encode_record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member that holds a response, or a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(raw: bytes) -> dict:
    """The fields of a decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": fields.get("X-Page-Id"),
        "url": fields.get("WARC-Target-URI", ""),
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("X-Refers-To-Page"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


class DamagedArchive(ValueError):
    """A file that does not hold one whole record after the other."""


def records_in(stream, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decompressed records that begin in ``start:end`` of a seekable stream of ``size`` bytes."""
    held, at = b"", start  # held: bytes of the file from at on

    def more() -> bool:
        nonlocal held
        place = at + len(held)
        if place >= size:
            return False
        stream.seek(place)
        held += stream.read(min(READ_BYTES, size - place))
        return True

    def begins_record() -> bool:
        """Whether a gzip member that decodes to a WARC header begins at ``held``'s start."""
        while len(held) < 512 and more():
            pass
        try:
            return held.startswith(MAGIC) and zlib.decompressobj(31).decompress(held[:512], 5) == b"WARC/"
        except zlib.error:
            return False

    def member() -> bytes:
        nonlocal held, at
        unpack, out, fed = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if fed == len(held) and not more():
                    raise DamagedArchive(f"the record at byte {at} is cut off")
                out.append(unpack.decompress(held[fed:]))
                fed = len(held)
        except zlib.error as e:
            raise DamagedArchive(f"the record at byte {at} is corrupt: {e}") from None
        used = len(held) - len(unpack.unused_data)
        held, at = held[used:], at + used
        return b"".join(out)

    aligned = start == 0
    while not aligned and at < end:  # the first record that starts in the range
        k = held.find(MAGIC)
        skip = k if k >= 0 else max(0, len(held) - 2)
        held, at = held[skip:], at + skip
        if k < 0:
            if not more():
                return
        elif at < end and not (aligned := begins_record()):
            held, at = held[1:], at + 1
    while aligned and at < size:
        if not begins_record():
            raise DamagedArchive(f"no record at byte {at}")
        if at >= end:
            return
        yield member()


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row and returns the manifest: path, bytes, records."""
    folder = folder or new_dir(spark, "warc")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")
    copies = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = stage(spark, narrow.join(copies, "digest").where("page_id <> first").distinct(), "revisits")
    # only what is stored twice is joined, by page and not by payload; a filter of fixed size lets the rest pass
    maybe = IdFilter(again.select(F.xxhash64("digest").alias("h")), "h").maybe(F.xxhash64("digest"))
    first = rows.where(maybe).join(again.hint("merge"), ["page_id", "digest"], "left")
    typed = rows.where(~maybe).withColumn("first", F.lit(None).cast(again.schema["first"].dataType)).unionByName(first)
    typed = typed.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written, n = None, 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if out is None:
                    fs, root = filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = encode_record(page_id, url, bytes(payload), digest, refers_to)
                out.write(member)
                written, n = written + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [written], "records": [n]})

    return stage(spark, typed.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest`` (path, bytes)."""
    splits = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in range(3))):
                fs, own = filesystem(path)
                with fs.open_input_file(own) as stream:
                    rows, held = [], 0
                    for raw in records_in(stream, size, start, min(size, start + split_bytes)):
                        row = decode_record(raw)
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)

    return splits.repartition(max(1, int(n or 0))).mapInArrow(run, _RECORD)
