"""Operator 1: token ids of a corpus in binary Simple-8b files, and reading them back.

Documents are range-partitioned by doc_id, so file k holds smaller ids than file k+1 and every file is ascending. Each
task streams its documents through the tokenizer and writes one file under a name of its own attempt; the manifest
lists the files of the attempts that succeeded, so a lost executor costs a rerun of its tasks and nothing else.

File (little-endian): magic | blocks: words, then escapes | index | its length (uint64) | magic. The index holds, for
each block, (byte offset, words, escapes, values) as int64, and for each document (doc_id, first value, values).

Defined results: a null text is the empty text (only the end id); repeated doc_ids are kept as documents of their own,
each with its own start; rows without doc_id have no place
in the order and are left out; an empty table gives no files and no rows; other columns of the input are ignored. A document
longer than a block spans blocks; memory holds one block of ids, one document, and the file's index: 24 bytes for each
document and 32 for each block of a task's partition.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm import simple8b
from rodada.llm.chunks import PieceEncoder
from rodada.llm.common import kept, texts
from rodada.operators.work import forget_on_exit, fresh_path

MAGIC = b"RDTOK8B1"


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, out, dtype, block: int = simple8b.BLOCK):
        self.out, self.dtype, self.block, self.at = out, np.dtype(dtype), block, 0
        self.parts: list[bytes] = []
        self.held = self.total = 0
        self.blocks, self.docs = array("q"), array("q")  # rows of four and of three
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, least: int) -> None:
        """Write blocks as long as that many ids are held."""
        ids, at = np.frombuffer(b"".join(self.parts), self.dtype), 0
        while len(ids) - at >= least:
            now = ids[at : at + self.block]
            words, escapes = simple8b.encode_block(now)
            self.blocks.extend((self.at, len(words), len(escapes), len(now)))
            self._put(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())
            at += len(now)
        self.parts, self.held = [ids[at:].tobytes()], len(ids) - at

    def add(self, doc_id: int, ids: bytes) -> None:
        """A document's ids, as the bytes of an array of dtype."""
        n = len(ids) // self.dtype.itemsize
        self.docs.extend((doc_id, self.total, n))
        self.parts.append(ids)
        self.held += n
        self.total += n
        if self.held >= self.block:
            self._flush(self.block)

    def close(self) -> None:
        if self.held:
            self._flush(1)
        index = struct.pack("<QQ", len(self.blocks) // 4, len(self.docs) // 3)
        index += np.array(self.blocks, "<i8").tobytes() + np.array(self.docs, "<i8").tobytes()
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """Random access to a file's documents; decodes a block at a time."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<Q", tail[:8])[0]
        index = self._read(size - 16 - n, n)
        b, d = struct.unpack("<QQ", index[:16])
        self.blocks = np.frombuffer(index, "<i8", 4 * b, 16).reshape(b, 4)
        self.docs = np.frombuffer(index, "<i8", 3 * d, 16 + 32 * b).reshape(d, 3)
        self.ends = np.cumsum(self.blocks[:, 3]).tolist()
        self.cached: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            at, words, escapes, n = self.blocks[k].tolist()
            raw = np.frombuffer(self._read(at, 8 * (words + escapes)), "<u8")
            values = simple8b.decode_block(raw[:words], raw[words:], n)
            self.cached = (k, values if escapes else values.astype(np.uint32) if not len(values) or int(values.max()) < 1 << 32 else values)
        return self.cached[1]

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The values first..first+n-1, in pieces of a block at most."""
        while n > 0:
            k = bisect_right(self.ends, first)
            begin = self.ends[k] - int(self.blocks[k, 3])
            piece = self.block(k)[first - begin : first - begin + n]
            yield piece
            first, n = first + len(piece), n - len(piece)


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def write_token_files(docs: DataFrame, directory: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> list[dict]:
    """Encode docs in ascending id order into files under directory; returns the manifest, a row for each file.

    The manifest has (part, path, n_docs, n_ids, start): it is as long as there are partitions.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, base = _open(directory)
        part, writer, out = TaskContext.get().partitionId(), None, None
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        encoder, tail = None, b""
        for batch in batches:
            for rows, strings in texts(batch, "text"):
                if writer is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(name)
                    encoder = kept(PieceEncoder, tokenizer_path)
                    writer, tail = Writer(out, encoder.dtype), b"" if end_id is None else encoder.one(end_id)
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), strings, strict=True):
                    writer.add(doc_id, encoder.packed(text or "") + tail)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name.rsplit("/", 1)[1]], "n_docs": [len(writer.docs) // 3], "n_ids": [writer.total]}, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(encode, "part int, path string, n_docs long, n_ids long").collect()  # a row a partition
    start, out = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        out.append(r.asDict() | {"start": start})
        start += r["n_ids"]
    return out


def read_token_files(spark, directory: str, manifest: list[dict], digest_only: bool = True) -> DataFrame:
    """Documents of the manifest's files: doc_id, start, n_tokens, ids_crc32 (and ids unless digest_only)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")
    if not manifest:
        return spark.createDataFrame([], schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(directory)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{base}/{row['path']}") as file:
                    reader, rows, held = Reader(file), [], 0
                    for doc_id, first, n in reader.docs.tolist():
                        crc, ids = 0, []
                        for piece in reader.ids(first, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                            if not digest_only:
                                ids.extend(piece.tolist())
                        rows.append((doc_id, row["start"] + first, n, crc) + (() if digest_only else (ids,)))
                        held += 1 + len(ids)
                        if held >= 1 << 16:
                            yield _batch(rows, digest_only)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, digest_only)

    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return files.repartition(len(manifest)).mapInArrow(decode, schema)


def _batch(rows: list[tuple], digest_only: bool) -> pa.RecordBatch:
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [] if digest_only else [("ids", pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs' ids in ascending doc_id order to a fresh shared folder and return what the files say."""
    directory = fresh_path(docs.sparkSession)
    manifest = write_token_files(docs, directory, tokenizer_path, end_id)
    if manifest:
        forget_on_exit(docs.sparkSession, directory)
    return read_token_files(docs.sparkSession, directory, manifest)
