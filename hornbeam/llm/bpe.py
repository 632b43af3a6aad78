"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the bytes says so, so equal passages give equal
chunks wherever they stand. Then

1. chunk keys are counted over all texts; keys seen twice or more go to a bitmap of fixed size;
2. texts without such a chunk are encoded in place;
3. of the other texts each shared chunk is encoded once, keyed by its content, and its encoding is
   joined to every place it occurs; chunks that are not shared are encoded where they stand;
4. the chunks of a text meet in order, and each join is repaired: the piece from the last space before it to the
   first space after it is encoded anew, over as many chunks as it takes to reach a space.

The tokenizer drops white space and encodes each run between spaces by itself (checked when the file is
read), so a re-encoded piece with a space at both ends agrees exactly with the whole text. Runs are encoded
by the tokenizer's library, once per worker and run, in a bounded table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numpy_bitmap, numpy_maybe_in, ship, worker_cache
from .textvec import _powers, mix64, utf8, VALUES

WINDOW = 24        # bytes under the rolling hash
MEAN_BITS = 10     # a cut every 2**10 bytes on average
LEAST = 256        # bytes between cuts
SLICE = 1 << 16    # bytes that are hashed in one go
BITMAP_BITS = 1 << 24
MEMO = 200_000     # runs that a worker keeps
PIECE = 1 << 21    # bytes of text, and of packed ids, that a worker holds at a time beside the batch it reads
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
# a word of ASCII letters ends before these whatever follows, so a blank put there changes no token
AFTER_WORD = re.compile(rb"(?<=[a-z])(?=[.,;:!?|])")
TAIL = re.compile(rb"[^\x20\x09-\x0D]*\Z")


def asked_cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the windows of ``raw`` whose hash asks for a cut, in order. It depends on the bytes of the window alone."""
    up, down = _powers(1 << (SLICE + WINDOW).bit_length())
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(raw) - WINDOW + 1, SLICE):
        part = raw[at:at + SLICE + WINDOW - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[:len(part)], dtype=np.uint64, out=sums[1:])
        rolling = (sums[WINDOW:] - sums[:-WINDOW]) * down[:len(part) - WINDOW + 1]
        found.append(np.flatnonzero(mix64(rolling) >> np.uint64(64 - MEAN_BITS) == 0) + at + WINDOW)
    return np.concatenate(found)


def cuts(raw: np.ndarray, asked: np.ndarray | None = None) -> list[int]:
    """Where chunks of one text begin (without 0), by content alone: never within a UTF-8 character. ``asked`` when it is known."""
    n = len(raw)
    if n < LEAST + WINDOW:
        return []
    out, last = [], 0
    for p in (asked_cuts(raw) if asked is None else asked).tolist():
        while p < n and raw[p] & 0xC0 == 0x80:
            p += 1
        if p - last >= LEAST and p < n:
            out.append(p)
            last = p
    return out


def chunks_of(raw: np.ndarray, asked: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
    """The chunks of a text and their 128-bit keys."""
    at = [0, *cuts(raw, asked), len(raw)]
    parts = [raw[a:b].tobytes() for a, b in zip(at, at[1:])] if len(raw) else []  # noqa: B905
    return parts, [xxhash.xxh3_128_digest(x) for x in parts]


def short(keys: list[bytes]) -> np.ndarray:
    """64 bits of each key. They serve for counting only: a chance collision sends a chunk the longer way."""
    return np.frombuffer(b"".join(keys), "<i8")[::2]


def check_runs(spec: dict) -> None:
    """Refuse a tokenizer that does not encode the runs between spaces each by itself."""
    steps = [spec["normalizer"], *(spec["normalizer"] or {}).get("normalizers", [])]
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = {x["type"] for x in steps if x} - {"Sequence"}
    if not spec["added_tokens"] or not kinds <= {"NFC", "Replace", "Lowercase"} or not parts or parts[0].get("behavior") != "Removed" or not parts[0].get("invert") \
            or any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
        raise ValueError("the tokenizer does not drop white space; its runs cannot be encoded by themselves")


class Encoder:
    """Encodes bytes of text run by run in one worker; ids travel packed, two bytes each when they fit."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.runs: dict[bytes, bytes] = {}   # at most half of MEMO, and as many used before these
        self.older: dict[bytes, bytes] = {}
        mark = json.loads(spec)["added_tokens"][0]
        self.mark, self.mark_id = mark["content"].encode(), mark["id"]
        number = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(number.values()) < 1 << 16 else "<i4")
        names = {i: t for t, i in number.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def one(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def learn(self, runs: set[bytes]) -> None:
        new = [x for x in runs if x not in self.runs]
        if len(self.runs) + len(new) > MEMO // 2:
            self.older, self.runs = self.runs, {}
            new = list(runs)
        if self.older:
            self.runs.update((x, self.older[x]) for x in new if x in self.older)
            new = [x for x in new if x not in self.older]
        plain = [x for x in new if self.mark not in x]
        for x in new if len(plain) < len(new) else ():
            self.runs[x] = self.one(x).tobytes()
        for k in range(0, len(plain), 500):  # many runs in one call, a special token between them
            part = plain[k:k + 500]
            ids = self.one(self.mark.join(part))
            ends = (np.flatnonzero(ids == self.mark_id) * self.kind.itemsize).tolist()
            begins, raw = [0, *(x + self.kind.itemsize for x in ends)], ids.tobytes()
            self.runs.update(zip(part, [raw[a:b] for a, b in zip(begins, [*ends, len(raw)], strict=True)], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for text in texts:
            if b"<" not in text:  # else it may hold a special string, which is matched before lower-casing
                text = AFTER_WORD.sub(b" ", text.lower())
            runs = text.split()  # bytes: splits at exactly the six ASCII spaces
            got = list(map(self.runs.get, runs))
            if None in got:
                self.learn(set(runs))
                got = map(self.runs.get, runs)
            out.append(b"".join(got))
        return out

    def decode(self, packed: bytes) -> str:
        """As the library decodes without a decoder step: token strings joined by a blank."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, self.kind).tolist()))


def encoder(name: str, spec: str) -> Encoder:
    """One encoder in each Python worker."""
    kept = worker_cache("bpe")
    if name not in kept:
        kept.clear()
        kept[name] = Encoder(spec)
    return kept[name]


def split_chunk(text: bytes) -> tuple[bytes, bytes, bytes | None]:
    """``(head, middle, tail)``: what stands before the first and after the last space; no tail without a space."""
    first = SPACE.search(text)
    if not first:
        return text, b"", None
    tail = TAIL.search(text).group()
    return text[:first.start()], text[first.end():len(text) - len(tail)], tail


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _flush(rows: list[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        yield _batch(rows[k:k + size], schema)


def _encoded(e: Encoder, ids: list, packed: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) // e.kind.itemsize for x in packed])]).astype(np.int32)
    values = np.frombuffer(b"".join(packed), e.kind).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                                       pa.array(map(e.decode, packed), pa.string())], ["id", "ids", "decoded"])


def _chunked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """Each text of a batch with its chunks and their keys; the texts are hashed one after the other in one go."""
    raw, at = utf8(batch.column(column))
    ends = asked_cuts(raw)
    first, last = np.searchsorted(ends, at[:-1] + WINDOW), np.searchsorted(ends, at[1:], "right")
    for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        yield raw[a:b], *chunks_of(raw[a:b], ends[i:j] - a)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold about ``PIECE`` bytes (one text may hold more)."""
    for batch in batches:
        at = utf8(batch.column(column))[1]
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + PIECE, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def shared_chunks(t: DataFrame, bits: int) -> np.ndarray:
    """Bitmap (``bits / 8`` bytes) of the keys of chunks that occur twice or more."""
    schema = pa.schema([("key", pa.int64())])

    def keys(batches):
        for batch in _pieces(batches, 1):
            all_keys = [k for _, _, keys in _chunked(batch, 1) for k in keys]
            if all_keys:
                yield pa.RecordBatch.from_arrays([pa.array(short(all_keys))], schema=schema)

    return numpy_bitmap(t.mapInArrow(keys, "key long").groupBy("key").count().where("count > 1"), "key", bits)


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
           bits: int = BITMAP_BITS) -> DataFrame:
    """One row per input row: ``id, ids array<int>, decoded``.

    ``ids`` are those of the tokenizer file's library without special tokens around, truncation or
    padding; special strings inside a text are handled as its default; ``decoded`` is its text of these ids,
    special tokens kept. A null text is empty (no ids). Repeated rows are encoded alike and returned as
    often as they occur; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    check_runs(json.loads(spec))
    if json.loads(spec).get("decoder"):
        raise ValueError("a decoder step is not supported")
    ship(spark)
    sc, name = spark.sparkContext, f"{spark.sparkContext.applicationId}:{tokenizer}"
    spec = sc.broadcast(spec)
    t = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    kind = dict(t.dtypes)["id"]
    bitmap = sc.broadcast(shared_chunks(t, bits))

    def shared(keys: list[bytes]) -> np.ndarray:
        return numpy_maybe_in(bitmap.value, short(keys))

    def lone(batches):
        """Texts of which no chunk is shared, encoded in place."""
        e = encoder(name, spec.value)
        for batch in _pieces(batches, 1):
            ids = batch.column(0).to_pylist()
            mine = [(i, x.tobytes()) for i, (x, _, keys) in zip(ids, _chunked(batch, 1), strict=True) if not keys or not shared(keys).any()]
            yield _encoded(e, [i for i, _ in mine], e.encode([x for _, x in mine]), batch.schema.field(0).type)

    content = pa.schema([("key", pa.binary()), ("text", pa.binary())])

    def contents(batches):
        """Each shared chunk, once per piece of a batch."""
        for batch in _pieces(batches, 1):
            found = {}
            for _, parts, keys in _chunked(batch, 1):
                if parts:
                    found |= {keys[i]: parts[i] for i in np.flatnonzero(shared(keys))}
            yield from _flush(list(found.items()), content)

    encoded = pa.schema([("key", pa.binary()), ("head", pa.binary()), ("mid", pa.binary()), ("tail", pa.binary())])

    def once(batches):
        e = encoder(name, spec.value)
        for batch in _pieces(batches, 1):
            keys, split = batch.column(0).to_pylist(), [split_chunk(x) for x in batch.column(1).to_pylist()]
            got = e.encode([x[1] for x in split])
            yield from _flush([(k, h, m, z) for k, (h, _, z), m in zip(keys, split, got, strict=True)], encoded)

    def stand(batch):
        """The texts of a batch that hold a shared chunk: ``(place in the batch, chunks, keys, which are shared)``."""
        for i, (_, parts, keys) in enumerate(_chunked(batch, 1)):
            hit = shared(keys) if parts else np.zeros(0, bool)
            if hit.any():
                yield i, parts, keys, hit

    def places(batches):
        """The chunks of these texts that are not shared, encoded where they stand."""
        e = encoder(name, spec.value)
        schema = None
        for batch in _pieces(batches, 1):
            schema = schema or pa.schema([("row", pa.int64()), ("id", batch.schema.field(0).type), ("seq", pa.int32()), *list(encoded)[1:]])
            ids, row, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, parts, _, hit in stand(batch):
                own = np.flatnonzero(~hit).tolist()
                split = [split_chunk(parts[j]) for j in own]
                got = e.encode([s[1] for s in split])
                out += [(row[i], ids[i], j, h, m, z) for j, (h, _, z), m in zip(own, split, got, strict=True)]
            yield from _flush(out, schema)

    def wanted(batches):
        """The shared chunks of these texts by key; nothing is encoded."""
        schema = None
        for batch in _pieces(batches, 1):
            schema = schema or pa.schema([("row", pa.int64()), ("id", batch.schema.field(0).type), ("seq", pa.int32()), ("key", pa.binary())])
            ids, row = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [(row[i], ids[i], j, keys[j]) for i, _, keys, hit in stand(batch) for j in np.flatnonzero(hit).tolist()]
            yield from _flush(out, schema)

    def joined(batches):
        e = encoder(name, spec.value)
        yield from assemble(e, batches)

    texts = t.mapInArrow(contents, "key binary, text binary").groupBy("key").agg(F.first("text").alias("text"))
    book = texts.mapInArrow(once, "key binary, head binary, mid binary, tail binary")
    at = t.withColumn("row", F.monotonically_increasing_id())
    known = at.mapInArrow(places, f"row long, id {kind}, seq int, head binary, mid binary, tail binary")
    looked_up = at.mapInArrow(wanted, f"row long, id {kind}, seq int, key binary").join(book, "key").drop("key")
    whole = (known.unionByName(looked_up).repartition("row").sortWithinPartitions("row", "seq")
             .mapInArrow(joined, f"id {kind}, ids array<int>, decoded string"))
    return t.mapInArrow(lone, f"id {kind}, ids array<int>, decoded string").unionByName(whole)


def assemble(e: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the chunks of each text (rows ``row, id, seq, head, mid, tail`` in order), repairing every join."""
    row, text_id, parts, doubt, done, held, kind = None, None, [], b"", [], 0, None

    def finish():
        parts.append(e.encode([doubt])[0])
        return text_id, b"".join(parts)

    for batch in batches:
        kind = kind or batch.schema.field(1).type
        for r, i, _, head, mid, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != row:
                if row is not None:
                    done.append(finish())
                    held += len(done[-1][1])
                row, text_id, parts, doubt = r, i, [], b""
            doubt += head
            if tail is not None:  # a space on both sides: the piece in doubt is settled
                parts += [e.encode([doubt])[0], mid]
                doubt = tail
            if held > PIECE:
                yield _encoded(e, [x[0] for x in done], [x[1] for x in done], kind)
                done, held = [], 0
    if row is not None:
        done.append(finish())
    if done:
        yield _encoded(e, [x[0] for x in done], [x[1] for x in done], kind)
