"""BPE encoding and decoding through a table of distinct words.

Texts are split into the pieces that byte-level BPE treats one by one. Every piece is counted over the whole corpus; the
most frequent distinct pieces, at most ``max_words`` of them, are encoded once each, and their ids are joined back by
position through a broadcast table whose size that parameter bounds. The rare rest (about 3 % of the pieces of a
heavy-tailed corpus) is encoded where it stands, once in each batch, as shuffling every position of a rare word would
move more than the texts themselves. Decoding joins ids with the table of pieces, which the vocabulary bounds.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from roadloom.llm.scratch import Scratch
from roadloom.llm.textops import chunks, flat, freed, gather, hash64, large, pieces

MAX_WORDS = 500_000
MAX_WORD_CHARS = 64


def tokenizer_json(path: str) -> str:
    """A tokenizer file's text, checked to be the kind that this module splits for."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    split = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that look at what is around them are not supported")
    return text


@functools.lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


#: Pieces that an encoder remembers: by itself, and beside a table of the frequent ones.
REMEMBERED, BESIDE_TABLE = 120_000, 40_000


@functools.lru_cache(maxsize=2)
def encoder(spec: str, memo: int = REMEMBERED) -> Encoder:
    return Encoder(spec, memo)


class Encoder:
    """Encodes string columns; the pieces met lately keep their ids."""

    def __init__(self, spec: str, memo: int = REMEMBERED):
        tok = Tokenizer.from_str(spec)
        self.model, self.limit = tok.model, memo
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.added = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}
        self.letters = dict(enumerate(byte_letters()))
        self.known = {self.letters_of(w.encode()): array("I", [i]).tobytes() for w, i in self.added.items()}

    def letters_of(self, raw: bytes) -> str:
        """Bytes as the vocabulary writes them, a letter each."""
        return raw.decode("latin-1").translate(self.letters)

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, one after the other, and how many each has."""
        raw, at = flat(distinct)
        letters, ends = self.letters_of(raw), at.tolist()
        recent, older, known, tokenize, out = self.recent, self.older, self.known, self.model.tokenize, []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            w = letters[a:b]
            ids = recent.get(w)
            if ids is None:
                ids = known.get(w) or older.get(w) or array("I", [t.id for t in tokenize(w)]).tobytes()
                if b - a <= MAX_WORD_CHARS:
                    recent[w] = ids
            out.append(ids)
        if len(recent) > self.limit:
            self.recent, self.older = {}, recent
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode(self, column: pa.Array, table: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has. Pieces in the table aren't encoded anew."""
        split, counts = pieces(column, tuple(self.added))
        coded = split.dictionary_encode()
        distinct, codes = coded.dictionary, np.asarray(coded.indices)
        if table is None or not len(table[0]):
            pool, lengths = self.words(distinct)
            starts = np.cumsum(lengths) - lengths
        else:
            keys, at, known, said = table
            h = hash64(distinct.to_pylist())
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            # Words are joined by the words themselves; hashes only find them.
            miss = np.flatnonzero(~np.asarray(pc.equal(said.take(pa.array(slot)), distinct.cast(pa.string()))))
            more, sizes = self.words(distinct.take(pa.array(miss)))
            starts, lengths = at[slot], at[slot + 1] - at[slot]
            starts[miss], lengths[miss] = len(known) + np.cumsum(sizes) - sizes, sizes
            pool = np.concatenate((known, more)) if len(miss) else known
        each = lengths[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        return pool[gather(starts[codes], each)].astype("<u4"), np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


def word_counts(docs: DataFrame, text: str = "text", special: tuple[str, ...] = ()) -> DataFrame:
    """(word, n): every distinct piece of all texts, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in chunks(b.column(0)):
                found = pc.value_counts(pieces(part, special)[0])
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(freed(count, encoder, vocabulary), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, spec: str, max_words: int = MAX_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The ids of the most frequent words, each encoded once: hashes in order, offsets, ids, and the words. At most max_words
    words of at most MAX_WORD_CHARS characters, so that its size is bounded whatever the corpus."""
    level = F.floor(F.log2("n") * 4)
    short = counts.filter(F.length("word") <= MAX_WORD_CHARS)
    least, total = None, 0
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some 250 rows at most
        if (total := total + row["count"]) > max_words:
            break
        least = row["level"]
    empty = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<u4"), pa.array([], pa.string())
    if least is None:
        return empty
    shared = counts.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, BESIDE_TABLE)
        for b in batches:
            ids, sizes = own.words(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids.astype(np.int32)))], ["word", "ids"])

    found = short.filter(level >= least).select("word").mapInArrow(freed(encode, encoder, vocabulary), "word string, ids array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return empty
    said, ids = (found.column(k).combine_chunks() for k in (0, 1))
    keys = hash64(said.to_pylist())
    order = pa.array(np.argsort(keys, kind="stable"))
    ids = ids.take(order)
    return keys[order], ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy().astype("<u4"), said.take(order).cast(pa.string())


def replaced(df: DataFrame, keep: list[str], column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep if c != column] + [T.StructField(column, kind)])


def encode_corpus(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", packed: bool = False, keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with the token ids of the whole text in column ``out``, as the tokenizers library gives them without special
    tokens added: an array of ints, or, packed, little-endian unsigned 32-bit integers.

    A null text has the ids of an empty one: none. Other columns pass through (``keep``: only these), a column named
    ``out`` is replaced; nulls, repeated rows and clashing names elsewhere make no difference. An empty table gives an
    empty table.
    """
    spark, spec = docs.sparkSession, tokenizer_json(tokenizer)
    scratch = Scratch(spark, "bpe")
    counts = scratch.table(word_counts(docs, text, tuple(encoder(spec).added)), "words")
    table = word_table(counts, spec, max_words)
    scratch.settle()
    scratch.close()
    return encode_with(docs, spec, table, text, out, packed, keep)


def encode_with(docs: DataFrame, spec: str, table: tuple | None, text: str = "text", out: str = "ids", packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """encode_corpus() by a table of words that is there already, or by none."""
    context = docs.sparkSession.sparkContext
    shared, words = context.broadcast(spec), context.broadcast(table)
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    names = [*keep, out]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        own = encoder(shared.value, BESIDE_TABLE if known else REMEMBERED)
        for b in batches:
            texts = b.column("text_to_encode")
            for at, part in chunks(texts):
                ids, n = own.encode(part, known)
                ends = np.concatenate(([0], np.cumsum(n)))
                if packed:
                    column = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
                else:
                    column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(part)) for c in keep), column], names)

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("text_to_encode")).mapInArrow(freed(encode, encoder, vocabulary), replaced(docs, keep, out, kind))


@functools.lru_cache(maxsize=2)
def vocabulary(spec: str) -> pa.Array:
    """The bytes of each id's piece, null where there is none; the last one stands for all ids beyond."""
    parsed = json.loads(spec)
    value = {c: b for b, c in enumerate(byte_letters())}
    out = {i: bytes(value[c] for c in piece) for piece, i in parsed["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    return pa.array([out.get(i) for i in range(max(out) + 2)], pa.large_binary())


large += [encoder, vocabulary]


def decode_corpus(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with the text of its token ids (array or packed) in column ``out``, special tokens included.

    Null ids give an empty text. Bytes that aren't UTF-8 become U+FFFD; an id without a piece gives nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    names = [*keep, out]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(shared.value)
        for b in batches:
            column = b.column("ids_to_decode")
            step = max(1, int(len(column) * (8 << 20) // max(column.nbytes, 1)))
            for at in range(0, len(column), step):
                part = column.slice(at, step)
                if pa.types.is_list(part.type):
                    n = np.asarray(pc.fill_null(pc.list_value_length(part), 0)).astype(np.int64)
                    values = np.asarray(pc.list_flatten(part)).astype(np.int64) & 0xFFFFFFFF
                else:
                    n = np.asarray(pc.fill_null(pc.binary_length(part), 0)).astype(np.int64) // 4
                    values = np.frombuffer(b"".join(x.as_buffer() for x in part if x.is_valid), "<u4").astype(np.int64)
                found = table.take(pa.array(np.where(values < len(table) - 1, values, len(table) - 1)))
                ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset :][: len(found) + 1] if len(found) else np.zeros(1, np.int64)
                raw = memoryview(found.buffers()[2]) if len(found) and found.buffers()[2] is not None else memoryview(b"")
                cut = ends[np.concatenate(([0], np.cumsum(n)))].tolist()
                texts = [str(raw[p:q], "utf-8", "replace") for p, q in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, step) for c in keep), pa.array(texts, pa.string())], names)

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(ids).alias("ids_to_decode")).mapInArrow(freed(decode, encoder, vocabulary), replaced(df, keep, out, T.StringType()))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Of each document: how many tokens its text has, and digests of the ids and of the text decoded from them."""
    encoded = encode_corpus(docs, tokenizer, packed=True, keep=["doc_id"])
    decoded = decode_corpus(encoded, tokenizer, out="decoded")
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
