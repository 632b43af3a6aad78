"""WARC archives as a chunked record table.

A payload is written as segments of at most ``chunk_bytes`` (WARC record segmentation: the
first segment is the ``response``, later ones are ``continuation`` records) and read back as rows
``(record_id, chunk_no, ...)``. Writer and reader hash chunk by chunk and carry the digest
along, so neither builds a record: the reader holds one line of at most one segment and a digest
state. Archives are gzip files made and read by Spark's text source, so any store that Spark knows
holds them; a gzip file is never split, so the segments of a record stay in order in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

EOL = "\r\n"
CHUNK_BYTES = 1 << 18
SALTS = 8
CHUNKS = ("record_id string, record_type string, refers_to string, chunk_no long, start long, n_bytes long, "
          "chunk binary, digest_so_far string, is_last boolean, payload_bytes long, payload_digest string, intact boolean")


def plan_revisits(records: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``id, sha -> refers_to`` for records whose payload another record with a smaller id has, one row per id and payload.

    Reads only ids, sizes and digests after the scan; ``records`` has ``id`` (any ordered type) and
    ``payload`` (binary). Payloads below ``min_bytes`` are never revisits.
    """
    d = cut(records.where(F.octet_length("payload") >= min_bytes)
            .select("id", _sha().alias("sha")))
    first = (d.groupBy("sha").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return (d.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
            .join(first, ["sha", "salt"]).where("id <> refers_to").groupBy("id", "sha").agg(F.min("refers_to").alias("refers_to")))


def _sha() -> Column:
    return F.unhex(F.sha2("payload", 256))


def _segments(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for i, payload in enumerate(batch.column(3)):
                for seg in record_segments(ids[i], urls[i], refers[i], memoryview(payload.as_buffer()), chunk_bytes):
                    out.append(seg)
                    held += len(seg)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
    return run


def record_segments(record_id: str, url: str | None, refers_to: str | None, payload: memoryview,
                    chunk_bytes: int) -> Iterator[bytes]:
    """The WARC records of one payload, each without its last line end."""
    digest, total = hashlib.sha256(), len(payload)
    target = [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    if refers_to is not None:
        digest.update(payload)
        head = ["WARC/1.1", "WARC-Type: revisit", f"WARC-Record-ID: <urn:record:{record_id}>", *target,
                f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Payload-Digest: sha256:{digest.hexdigest()}",
                f"X-Payload-Length: {total}", "Content-Length: 0"]
        yield (EOL.join(head) + EOL * 2 + EOL).encode()
        return
    number = 0
    while True:
        part = payload[number * chunk_bytes:(number + 1) * chunk_bytes]
        digest.update(part)
        last = (number + 1) * chunk_bytes >= total
        own = f"<urn:record:{record_id}>" if not number else f"<urn:record:{record_id}:{number}>"
        head = ["WARC/1.1", f"WARC-Type: {'continuation' if number else 'response'}", f"WARC-Record-ID: {own}", *target]
        if number:
            head.append(f"WARC-Segment-Origin-ID: <urn:record:{record_id}>")
        if number or not last:
            head.append(f"WARC-Segment-Number: {number + 1}")
        if last:
            head += [f"WARC-Payload-Digest: sha256:{digest.hexdigest()}", f"WARC-Segment-Total-Length: {total}"]
        yield (EOL.join([*head, f"Content-Length: {len(part)}"]) + EOL * 2).encode() + part + EOL.encode()
        if last:
            return
        number += 1


def write_archives(records: DataFrame, path: str, *, id_col: str = "id", url_col: str | None = None,
                   payload_col: str = "payload", min_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record per row below ``path`` (a new folder, in any store Spark can write).

    Of equal payloads of ``min_bytes`` and more the smallest id is the response and the others are
    revisits without a payload. A null payload is empty; a null id is written as an empty id and never a revisit. Rows
    that repeat an id become records with that id, each by its own payload. Other columns are ignored; an empty
    table writes an empty archive. A string payload counts as its UTF-8 bytes.
    """
    ship(records.sparkSession)
    url: Column = F.col(url_col) if url_col else F.lit(None)
    r = records.select(F.col(id_col).alias("id"), url.cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    revisits = plan_revisits(r, min_bytes)
    keyed = r.withColumn("sha", F.when(F.octet_length("payload") >= min_bytes, _sha()))
    joined = keyed.join(revisits.hint("shuffle_hash"), ["id", "sha"], "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", F.col("refers_to").cast("string"), "payload")
    (joined.mapInArrow(_segments(chunk_bytes), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", EOL).option("compression", "gzip").text(path))


class _Reader:
    """Parses lines of whole archives, keeping one digest state; ``rows`` collects the chunk rows."""

    def __init__(self, with_payload: bool):
        self.keep, self.rows, self.need, self.head, self.tail = with_payload, [], None, [], False
        self.digest, self.done, self.origin = None, 0, None

    def line(self, line: bytes) -> None:
        if self.need is not None:
            if len(line) > self.need:
                raise ValueError("a WARC record is longer than its Content-Length")
            whole = len(line) == self.need
            part = line if whole else line + b"\r\n"
            self.digest.update(part)
            self.parts.append(part) if self.keep else None
            self.need = None if whole else self.need - len(part)
            if whole:
                self.end()
        elif self.tail:
            self.tail = False
            if line:
                raise ValueError("a WARC record does not end with an empty line")
        elif line or self.head:
            if line:
                self.head.append(line)
            else:
                self.begin()

    def begin(self) -> None:
        if not self.head[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {self.head[0][:80]!r}")
        h = dict(x.decode().split(": ", 1) for x in self.head[1:])
        self.h, self.head, self.parts = h, [], []
        self.need = int(h["Content-Length"])
        kind = h["WARC-Type"]
        if kind != "continuation":
            self.digest, self.done, self.number, self.kind = hashlib.sha256(), 0, 0, kind
            self.origin = h["WARC-Record-ID"]
        elif h["WARC-Segment-Origin-ID"] != self.origin or int(h["WARC-Segment-Number"]) != self.number + 2:
            raise ValueError(f"segment {h['WARC-Segment-Number']} of {h['WARC-Segment-Origin-ID']} does not follow its record")
        else:
            self.number += 1
        # an empty block is the empty line that line() will see next

    def end(self) -> None:
        h, n = self.h, int(self.h["Content-Length"])
        start, self.done, self.tail = self.done, self.done + n, True
        so_far, said = self.digest.hexdigest(), h.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
        refers = h.get("WARC-Refers-To")
        total = h.get("X-Payload-Length") if refers else h.get("WARC-Segment-Total-Length")
        name = lambda x: x.removeprefix("<urn:record:").removesuffix(">")
        self.rows.append((name(self.origin) or None, self.kind, refers and name(refers), self.number, start, n,
                          b"".join(self.parts) if self.keep else None, so_far, said is not None,
                          total and int(total), said,
                          None if said is None or refers else said == so_far and int(total) == self.done))
        self.parts = []


def _read(with_payload: bool):
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(),
             pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Reader(with_payload)
        for batch in batches:
            for line in batch.column(0):
                r.line(line.as_py())
            if r.rows:
                columns = zip(*r.rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                r.rows = []
        if r.need is not None or r.head:
            raise ValueError("an archive ends within a record")
    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunk table of the archives below ``path``: one row per segment.

    ``digest_so_far`` is the SHA-256 of the payload up to and with this chunk; on the last row
    of a record ``payload_digest`` and ``payload_bytes`` are as its headers say and ``intact`` tells whether the
    bytes read agree (null for revisits, which carry none). An empty id is read as null. A torn record is an error, not a lost row.
    """
    ship(spark)
    lines = spark.read.option("lineSep", EOL).text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(_read(with_payload), CHUNKS)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk."""
    return chunks.where("is_last").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
