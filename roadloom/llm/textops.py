"""Vectorised text splitting over Arrow columns: byte-level BPE pieces, words, word shingles."""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import SparkSession
from tokenizers.pre_tokenizers import ByteLevel

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts are worked on in pieces of about this many bytes, which bounds a task's memory; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 20
#: Rows of texts in an Arrow batch; Spark's default of 10,000 is too many for texts of several KB.
BATCH_ROWS = 1000


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Of each code point: letter, number, white space or other, by the Unicode version of the tokenizers library.

    Code points that Python's own tables lack are looked up in the library, as either may be the newer one.
    """
    kind = {"L": LETTER, "N": NUMBER}
    names = [unicodedata.category(chr(i)) for i in range(0x110000)]
    out = np.array([kind.get(c[0], OTHER) for c in names], np.uint8)
    out[WHITE_SPACE] = SPACE
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for m in regex.finditer(r"[\p{L}\p{N}]", "".join(chr(i) for i in range(0x110000) if names[i] == "Cn")):
        for beside, value in (("a", LETTER), ("1", NUMBER)):
            if len(split(beside + m[0])) == 1:
                out[ord(m[0])] = value
    return out


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of BATCH_ROWS rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: Cached functions whose results are large, and which only some kinds of tasks need.
large: list = []

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give memory that is free, but kept by allocators for later, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def freed(work: Work, *needs: Callable) -> Work:
    """work, of which a Python worker keeps nothing afterwards but the caches it ``needs``. Workers are used again by all
    stages of a session, so what one kind of task leaves behind counts beside all that come after it."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in large:
            if f not in needs:
                f.cache_clear()
        try:
            yield from work(batches)
        finally:
            release()

    return tidy


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices (offset, array) of a string column of about size bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    group = np.cumsum(lengths) // size
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(column)], strict=True):
        yield int(a), column.slice(a, b - a)


def flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts in one byte string (null: empty), and the byte offset at which each begins and the last ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = data[at[0] : at[-1]].to_pybytes() if data is not None and at[-1] > at[0] else b""
    return raw, at - at[0]


def pieces(column: pa.Array, special: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """Split texts into the pieces that byte-level BPE encodes one by one: contractions, words, numbers and other
    runs with one space before them, and runs of white space. ``special`` strings are pieces of their own.

    Returns all pieces in order, and how many each text has. Pieces cover the texts without gaps.
    """
    raw, at = flat(column)
    n = len(at) - 1
    if not raw:
        return pa.array([], pa.large_string()), np.zeros(n, np.int64)
    text = raw.decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = np.ones(len(cp), np.int64)
    if len(cp) != len(raw):
        width += (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte = np.concatenate(([0], np.cumsum(width)))
    begins = np.searchsorted(byte, at)
    edge = np.zeros(len(cp) + 1, bool)  # a new text, or a side of a special string
    edge[begins] = True
    inside = []
    for s in special:
        k = text.find(s)
        while k >= 0:
            if not edge[k + 1 : k + len(s)].any():
                edge[[k, k + len(s)]] = True
                inside.append((k, k + len(s)))
            k = text.find(s, k + len(s))
    kind = classes()[cp]
    space = kind == SPACE
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(len(cp), bool)  # the last white space before something else
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    start |= last
    blank = last & (cp == 0x20)
    follows = np.flatnonzero(blank) + 1
    start[follows] = False  # this space belongs to what follows it
    for q in np.flatnonzero((cp == 0x27) & start):
        q = int(q)
        for more in (1, 2):
            end = q + 1 + more
            if end <= len(cp) and not edge[q + 1 : end].any() and text[q + 1 : end] in ("s", "t", "m", "d", "re", "ve", "ll"):
                start[q + 1 : end] = False
                if end < len(cp):
                    start[end] = True
                break
    for a, b in inside:
        start[a + 1 : b] = False
    first = np.flatnonzero(start)
    offsets = np.append(byte[first], len(raw)).astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw))
    return out, np.diff(np.searchsorted(first, begins))


def hash64(words: list[str] | list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def words(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Runs of anything but ASCII white space, A-Z lower-cased if asked, and how many each text has (null: 0)."""
    raw, at = flat(column)  # ascii_lower misreads a large_string that was cast from a slice
    column = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    at = parts.offsets.to_numpy().astype(np.int64)
    flat_words = parts.values.slice(at[0], at[-1] - at[0])
    full = np.asarray(pc.binary_length(flat_words)) > 0
    count = np.concatenate(([0], np.cumsum(full)))
    at = at - at[0]
    return flat_words.filter(pa.array(full)), np.diff(count[at])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    base = 0xD6E8FEB86659FD93
    step = np.array([base, pow(base, -1, 1 << 64)], np.uint64)
    out = np.ones((2, n), np.uint64)
    out[:, 1:] = step[:, None]
    return tuple(np.cumprod(out, axis=1))


#: A random number for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(flat_words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, scrambled."""
    if len(flat_words) == 0:
        return np.zeros(0, np.uint64)
    raw, at = flat(flat_words)
    data = np.frombuffer(raw, np.uint8)
    size = max(CHUNK_BYTES, 1 << (len(data)).bit_length())
    up, down = powers(size)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] ^ np.diff(at).astype(np.uint64))


#: Texts whose shingles are sorted at once: their numbers take the bits that a hash gives up.
OWNERS, OWNER_BITS = 4096, 12


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, as sorted hashes, and how many each has. Hashes have 52 bits, the highest
    of 64.

    A text of fewer than k words has one: the whole sequence. A text without words has none.
    """
    if len(counts) > OWNERS:
        cut = np.concatenate(([0], np.cumsum(counts)))
        parts = [shingle_sets(hashes[cut[a] : cut[min(a + OWNERS, len(counts))]], counts[a : a + OWNERS], k) for a in range(0, len(counts), OWNERS)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(hashes)
    step = np.uint64(0xA0761D6478BD642F)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= step
        h[: max(n - j, 0)] += hashes[j:]
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keep = np.repeat(ends, counts) - np.arange(n) >= k  # as many words from here to the text's end
    for size in range(1, k):
        at = (ends - counts)[counts == size]
        whole = np.full(len(at), size, np.uint64)
        for j in range(size):
            whole = whole * step + hashes[at + j]
        h[at], keep[at] = whole, True
    key = np.sort(owner[keep] << np.uint64(64 - OWNER_BITS) | mix(h[keep]) >> np.uint64(OWNER_BITS))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key << np.uint64(OWNER_BITS), np.bincount((key >> np.uint64(64 - OWNER_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int64)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1 for every i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
