"""Token ids in length-delimited binary records with an offset index.

A record file starts with ``MAGIC`` and the width of an id in bytes. Each record is framed by
its length, the masked checksum of the length, the body and the masked checksum of the body;
the body is the document's id, whether it is null, and its token ids, little-endian. Beside
each file stands an index of (offset, tokens) per record, so that a reader can seek any record.
Documents are range-partitioned and sorted by doc_id; files of a partition follow one another.

Texts are split where the tokenizer splits as well (before a single space between words, around a
line break, before a mark after a letter), and each distinct piece is encoded once by the
tokenizers library and kept for later texts.

Defined results: a null or empty text has the end id alone; a null doc_id comes first; rows of
one doc_id follow each other by text; columns of other names are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskframe.llm import text as T
from riskframe.llm.stage import arrow, scratch, staged

MAGIC = b"RFTOKENS"
END = 2
#: A partition starts a new file beyond this size.
FILE_BYTES = 32 << 20
#: Bytes of a file that wait to be written.
BUFFER = 1 << 20
#: Distinct pieces a worker remembers before it starts afresh; a bound of memory only.
REMEMBERED = 1_200_000
#: Bytes of text encoded at a time, and pieces given to the library at a time.
PART, SENT = 1 << 20, 4_000

_U = np.uint64


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole texts to ids; equal to encoding each text by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)      # piece hashes, sorted
        self.proof = np.zeros(0, np.uint64)      # a second look at each piece
        self.begin = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def fresh(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces; one call of the library for many, as its results are large."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for i in range(0, len(text), SENT):
            part = text[i:i + SENT]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(part)).astype(np.int32))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        body = data.tobytes()
        if any(x in body for x in self.special):           # they may hold marks that pieces cut at
            return self.plain(data, offsets)
        starts, ends = pieces(data, offsets)
        code = T.Rolling(T.BYTE_CODE[data]).of(starts, ends)
        values, one, inverse = distinct(code)
        proof = edges_of(data, starts, ends)
        if not (proof == proof[one][inverse]).all():       # two pieces of one hash: the plain way
            return self.plain(data, offsets)
        proof = proof[one]
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, values), max(0, len(self.known) - 1))
        there = self.known[at] == values if len(self.known) else np.zeros(len(values), bool)
        if there.any() and not (self.proof[at[there]] == proof[there]).all():
            return self.plain(data, offsets)
        fresh = np.flatnonzero(~there)
        if len(fresh):
            text = [body[s:e].decode() for s, e in zip(starts[one[fresh]].tolist(), ends[one[fresh]].tolist())]
            ids, count = self.fresh(text)
            begin = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
            self.ids = np.concatenate([self.ids, ids])
            where = np.searchsorted(self.known, values[fresh])
            self.known = np.insert(self.known, where, values[fresh])
            self.proof = np.insert(self.proof, where, proof[fresh])
            self.begin = np.insert(self.begin, where, begin)
            self.count = np.insert(self.count, where, count)
            at = np.searchsorted(self.known, values)
        slot = at[inverse]
        count = self.count[slot].astype(np.int64)
        ids = self.ids[T.ranges(self.begin[slot].astype(np.int64), count)]
        total = np.append(0, np.cumsum(count))
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def plain(self, data, offsets):
        text = [data[offsets[i]:offsets[i + 1]].tobytes().decode() for i in range(len(offsets) - 1)]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        return (np.array([i for x in lists for i in x], dtype=np.uint32),
                np.array([len(x) for x in lists], dtype=np.int64))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which one every value is."""
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], which


_WIDE_SPACE_LEAD = (0xC2, 0xE1, 0xE2, 0xE3)  # first bytes of white space beyond ASCII
_OPENS = T.SOLID.copy()
_OPENS[list(_WIDE_SPACE_LEAD)] = False
_NAMED = np.zeros(256, dtype=bool)               # ASCII letters and digits
_NAMED[0x30:0x3A] = _NAMED[0x41:0x5B] = _NAMED[0x61:0x7B] = True
_MARK = np.zeros(256, dtype=bool)                # other visible ASCII
_MARK[0x21:0x7F] = ~_NAMED[0x21:0x7F]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut every text where the tokenizer's own pattern cuts, whatever else the text holds."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        here, before, after = data[1:-1], data[:-2], data[2:]
        cut[1:-2] = (here == 0x20) & T.SOLID[before] & _OPENS[after]
        # the last character before is a letter or digit: ASCII, or one of two bytes from C3 on
        named = _NAMED[before]
        named[1:] |= (data[:-3] == 0xC3) & (before[1:] >= 0x80) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        cut[1:-2] |= _MARK[here] & named
        line = (here == 0x0A) & (named | _MARK[before]) & _OPENS[after]
        cut[1:-2] |= line
        cut[2:-1] |= line
    filled = np.diff(offsets) > 0
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    cut[last] &= _MARK[data[last]]              # a space or break at the very end stays with its word
    cut[first] = True                           # a text's first byte, whatever stands before it
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data))


def edges_of(data, starts, ends) -> np.ndarray:
    """First and last eight bytes and length, mixed: a check beside the hash of a piece."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    keep = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    head, tail = eight[starts + 8] << keep, eight[ends] >> keep
    return T.mix(head) * _U(3) ^ T.mix(tail + size.astype(np.uint64))


def masked(part: bytes) -> int:
    """Checksum rotated and shifted, so that checksums of checksums differ."""
    c = zlib.crc32(part)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return b"".join([size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body))])


def records(content: memoryview) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a file; a wrong checksum is an error."""
    if bytes(content[:8]) != MAGIC:
        raise ValueError("not a token record file")
    kind = {2: "<u2", 4: "<u4"}[content[8]]
    at = 9
    while at < len(content):
        size = bytes(content[at:at + 8])
        length, = struct.unpack("<Q", size)
        check, = struct.unpack("<I", content[at + 8:at + 12])
        body = bytes(content[at + 12:at + 12 + length])
        again, = struct.unpack("<I", content[at + 12 + length:at + 16 + length])
        if check != masked(size) or again != masked(body):
            raise ValueError(f"checksum of the record at {at} is wrong")
        doc, null = struct.unpack("<qB", body[:9])
        yield None if null else doc, np.frombuffer(body, dtype=kind, offset=9)
        at += 16 + length


_encoders: dict[str, Encoder] = {}

WRITTEN = "file string, part int, nth int, docs bigint, tokens bigint, bytes bigint"


def _writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        files, root = fs.FileSystem.from_uri(folder)
        part, nth = TaskContext.get().partitionId(), 0
        head = MAGIC + bytes([encoder.width])
        kind = "<u2" if encoder.width == 2 else "<u4"
        index, size, tokens, out, trial = [], len(head), 0, None, ""

        def begin(name: str):
            # a repeated attempt writes the same bytes under the same name
            path = f"{root}/.{name}-{uuid.uuid4().hex}"
            return files.open_output_stream(path, buffer_size=BUFFER), path

        def flush() -> pa.RecordBatch:
            nonlocal index, size, tokens, nth, out, trial
            name = f"part-{part:06d}-{nth:06d}"
            out.close()
            files.move(trial, f"{root}/{name}.rec")
            out, trial = begin(f"{name}.idx")
            out.write(np.array(index, dtype="<u8").tobytes())
            out.close()
            files.move(trial, f"{root}/{name}.idx")
            row = {"file": f"{name}.rec", "part": part, "nth": nth, "docs": len(index), "tokens": tokens, "bytes": size}
            index, size, tokens, nth, out = [], len(head), 0, nth + 1, None
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("file", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("docs", pa.int64()),
                 ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for row, n, data, offsets in T.chunks(batch.column("text"), PART):
                ids, counts = encoder.encode(data, offsets)
                ids = ids.astype(kind)
                ends = np.cumsum(counts)
                for i in range(n):
                    doc = docs[row + i]
                    own = ids[ends[i] - counts[i]:ends[i]]
                    body = struct.pack("<qB", doc or 0, doc is None) + own.tobytes() + np.array([END], kind).tobytes()
                    framed = frame(body)
                    if out is None:
                        out, trial = begin(f"part-{part:06d}-{nth:06d}.rec")
                        out.write(head)
                    index.append((size, int(counts[i]) + 1))
                    out.write(framed)               # records leave memory as they are made
                    size += len(framed)
                    tokens += int(counts[i]) + 1
                    if size >= FILE_BYTES:
                        yield flush()
        if index:
            yield flush()
    return write


def write_records(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns one row per file, in order.

    The rows name the files that belong to the result, with ``start``: the tokens before each.
    """
    files = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = files.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    _make(docs.sparkSession, folder)
    written = staged(arrow(ordered, _writer(folder, path or vocabulary_path()), WRITTEN), "manifest")
    # one row per file: the window holds names and counts only
    before = F.sum("tokens").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1))
    return written.withColumn("start", F.coalesce(before, F.lit(0)).cast("bigint"))


def _make(spark, folder: str) -> None:
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(java)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, start in zip(batch.column("content"), batch.column("start").to_pylist()):
            rows = []
            for doc, ids in records(memoryview(content.as_buffer())):
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files that the manifest names."""
    spark = manifest.sparkSession
    content = (spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder)
               .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    return arrow(content.join(manifest.select("file", "start"), "file").select("content", "start"), _read,
                 "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_records(write_records(docs, folder, path), folder)


def op9(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def reference(docs: list[tuple], path: str | None = None) -> list[tuple]:
    """The contract one text at a time, for tests."""
    from tokenizers import Tokenizer
    tokenizer, start, out = Tokenizer.from_file(path or vocabulary_path()), 0, []
    for doc, body in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = tokenizer.encode(body or "", add_special_tokens=False).ids + [END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
