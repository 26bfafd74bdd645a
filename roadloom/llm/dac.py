"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, the lowest first. Level 0 holds the first chunk of every id, level 1 the second
chunk of those ids that have one, and so on. Beside each level, a bitmap tells which of its ids go on, and a directory
holds the number of set bits before every block of 512 bits; the place of an id's next chunk is the rank of its bit. Any
token is read by one lookup a level, without decoding a block.

File: magic, three counts (documents, levels, ids), the documents' keys, null flags and first positions, then for each
level its length, chunks, bitmap and directory. All integers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.bpe import encoder, tokenizer_json
from roadloom.llm.scratch import Scratch
from roadloom.llm.textops import chunks

MAGIC = b"RLDAC\x00\x00\x01"
BLOCK = 512


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of some documents' ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)))) if len(more) else np.zeros(1)
        levels.append(np.array([len(rest)], "<u8").tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(levels), len(ids)], "<u8").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, keys, np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(), *levels])


class TokenFile:
    """Reads one file's bytes (or a map of them) in place."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        docs, depth, self.n_tokens = (int(x) for x in take("<u8", 3))
        keys, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(depth):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u8", -(-n // BLOCK) + 1)))

    def rank(self, level: int, i: int) -> int:
        """Set bits before the i-th of a level."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        inside = np.unpackbits(bits[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, i: int) -> int:
        """The i-th id of the file."""
        out = 0
        for level, (values, bits, _) in enumerate(self.levels):
            out |= int(values[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return out

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids from a to before b; they lie together on every level."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level, (values, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[where] |= values[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, a = where[more], self.rank(level, a)
            b = a + len(where)
        return out


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, file_tokens: int = 1 << 22) -> DataFrame:
    """Encode all texts and write them to files in ascending doc_id order (null first, ties by text), each document
    followed by end_id. Returns (file, part, seq, n_docs, n_tokens), lazily: the files are there once its rows are.

    A null text counts as empty. Files close after file_tokens ids, at the end of a document. A task that is run again
    writes the same files under the same names, each put in place by a rename.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(shared.value), TaskContext.get().partitionId(), 0
        store, root = pafs.FileSystem.from_uri(folder)
        ids, keys, sizes, held = [], [], [], 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal ids, keys, sizes, held, seq
            name = f"part-{part:06d}-{seq:05d}.dac"
            with store.open_output_stream(draft := f"{root}/.{name}-{uuid.uuid4().hex}") as f:
                f.write(dump(np.concatenate(ids), keys, np.array(sizes)))
            store.move(draft, f"{root}/{name}")
            row = {"file": name, "part": part, "seq": seq, "n_docs": len(keys), "n_tokens": held}
            ids, keys, sizes, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            for at, texts in chunks(b.column(1)):
                found, n = own.encode(texts)
                ends = np.cumsum(n)
                for key, p, q in zip(b.column(0).slice(at, len(texts)).to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
                    ids += [found[p:q], tail]
                    keys.append(key)
                    sizes.append(q - p + len(tail))
                    held += sizes[-1]
                    if held >= file_tokens:
                        yield flush()
        if keys:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(write, "file string, part int, seq int, n_docs bigint, n_tokens bigint")


def read_tokens(spark, folder: str) -> DataFrame:
    """(file, ord, doc_id, file_start, n_tokens, ids_crc32) of every document in a folder's files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = TokenFile(memoryview(raw.as_buffer()))
                crc = [zlib.crc32(t.tokens(p, q)) for p, q in zip(t.starts[:-1].tolist(), t.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(crc)), pa.array(range(len(crc)), pa.int32()), pa.array(t.doc_ids, pa.int64()), pa.array(t.starts[:-1]), pa.array(np.diff(t.starts)), pa.array(crc, pa.int64())], ["file", "ord", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "content").mapInArrow(read, "file string, ord int, doc_id bigint, file_start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents' ids, read the files back, and tell where each document's ids lie and what they are.

    (doc_id, start, n_tokens, ids_crc32); an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.path}/files"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    files = scratch.table(write_tokens(docs, tokenizer, folder), "manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))  # a row for each task that wrote
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    offsets = files.withColumn("inside", inside).join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("first"))
    return read_tokens(spark, folder).join(offsets, "file").select("doc_id", (F.col("first") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
