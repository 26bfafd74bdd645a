"""What texts have in common, found by one shuffle of packed postings.

A posting is a key (a hash) and its owner (a text's name), and maybe a place. A task sorts a block of postings by key, keeps
to itself what the block knows already (``local``), and packs the rest, keys as differences, by ranges of keys; a range's
postings meet in one task, which sees each key whole (``finish``). As ``local`` sends a bounded number of postings of each
key, however many owners it has in the block, a hot key is no hot range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadloom.llm.textops import freed

#: Postings that a task packs at once, and that a range has about.
PACKED, IN_RANGE = 1 << 19, 1 << 18

Postings = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys (unsigned), owners, places
Columns = tuple[np.ndarray, np.ndarray]


def enough(postings: int) -> int:
    """How many ranges so many postings are dealt to: a power of two, 2 at least."""
    return max(2, 1 << (int(postings) // IN_RANGE).bit_length())


def pack(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> bytes:
    """Ascending keys as differences of as many bytes as they need, then owners, then places (none if they are all 0)."""
    step = np.diff(x, prepend=np.zeros(1, np.uint64))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    placed = bool(place.any())
    return bytes([width, placed]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + owner.tobytes() + (place.astype(np.int32).tobytes() if placed else b"")


def unpack(body: bytes) -> Postings:
    width, placed = body[0], body[1]
    count = (len(body) - 2) // (width + 8 + 4 * placed)
    step = np.zeros((count, 8), np.uint8)
    step[:, :width] = np.frombuffer(body, np.uint8, count * width, 2).reshape(count, width)
    at = 2 + count * width
    place = np.frombuffer(body, np.int32, count, at + 8 * count) if placed else np.zeros(count, np.int32)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(body, np.int64, count, at), place


def _sorted(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Postings:
    """Postings in order, each once."""
    order = np.lexsort((place, owner, x))
    x, owner, place = x[order], owner[order], place[order]
    fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))
    return x[fresh], owner[fresh], place[fresh]


def starts(x: np.ndarray) -> np.ndarray:
    """Where each key begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def meet(
    rows: DataFrame,
    postings: Callable[[pa.RecordBatch], Iterator[Postings]],
    local: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[Columns, np.ndarray]],
    finish: Callable[[np.ndarray, np.ndarray, np.ndarray], Columns],
    ranges: int,
    names: tuple[str, str],
    bits: int = 64,
) -> DataFrame:
    """Two columns of integers, as ``local`` and ``finish`` make them of the postings of rows.

    Both get postings in order. local returns what the block knows, and which postings are sent on. Keys have ``bits`` bits.
    """
    shift = np.uint64(bits - (ranges.bit_length() - 1))

    def block(held: list[Postings]) -> pa.RecordBatch:
        x, owner, place = _sorted(*(np.concatenate(c) for c in zip(*held, strict=True)))
        (a, b), sent = local(x, owner, place)
        x, owner, place = x[sent], owner[sent], place[sent]
        cut = np.searchsorted(x, np.arange(ranges, dtype=np.uint64) << shift)
        cut = np.append(cut, len(x))
        full = np.flatnonzero(np.diff(cut))
        bodies = [pack(x[p:q] - (np.uint64(r) << shift), owner[p:q], place[p:q]) for r, p, q in zip(full.tolist(), cut[full].tolist(), cut[full + 1].tolist(), strict=True)]
        none = np.zeros(len(full), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((full, np.arange(len(a)) % ranges)).astype(np.int32)), pa.array(np.concatenate((none, a))), pa.array(np.concatenate((none, b))), pa.array(bodies + [None] * len(a), pa.binary())], ["r", *names, "packed"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Postings] = []
        many = 0
        for batch in batches:
            for some in postings(batch):
                held.append(some)
                many += len(some[0])
                if many >= PACKED:
                    yield block(held)
                    held, many = [], 0
        if many:
            yield block(held)

    def done(bodies: list[bytes]) -> pa.RecordBatch:
        a, b = finish(*_sorted(*(np.concatenate(c) for c in zip(*map(unpack, bodies), strict=True))))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], list(names))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            known = b.column(3).is_null()
            yield pa.RecordBatch.from_arrays([b.column(k).filter(known) for k in (1, 2)], list(names))
            for r, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if body is None:
                    continue
                if r != now and held:
                    yield done(held)
                    held = []
                now = r
                held.append(body)
        if held:
            yield done(held)

    kinds = ", ".join(f"{c} bigint" for c in names)
    packed = rows.mapInArrow(freed(deal), f"r int, {kinds}, packed binary")
    return packed.repartition("r").sortWithinPartitions("r").mapInArrow(freed(gather), kinds)


def tied(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Columns:
    """Each owner of a key with the key's least owner, once."""
    begin = starts(x)
    least = np.repeat(owner[begin], np.diff(np.append(begin, len(x))))
    other = owner != least
    pairs = np.unique(np.stack((owner[other], least[other])), axis=1)
    return pairs[0], pairs[1]


def stars(rows: DataFrame, postings: Callable[[pa.RecordBatch], Iterator[Postings]], ranges: int) -> DataFrame:
    """(a, b): links whose components are those of the owners that share keys. Of each key, a block sends its least owner."""

    def local(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[Columns, np.ndarray]:
        first = np.zeros(len(x), bool)
        first[starts(x)] = True
        return tied(x, owner, place), first

    return meet(rows, postings, local, tied, ranges, ("a", "b"))


def _owners(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each posting, the place of its owner among the key's owners, and how many owners the key has."""
    begin = starts(x)
    size = np.diff(np.append(begin, len(x)))
    new = np.concatenate(([False], (owner[1:] != owner[:-1]) & (x[1:] == x[:-1])))
    nth = np.cumsum(new)
    nth -= np.repeat(nth[begin], size)
    return nth, np.repeat(nth[begin + size - 1] + 1, size)


def common(rows: DataFrame, postings: Callable[[pa.RecordBatch], Iterator[Postings]], ranges: int, names: tuple[str, str]) -> DataFrame:
    """(owner, place) of the postings whose key has two owners at least. Of a key with several owners in a block, the block
    sends one posting of each of two."""

    def local(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[Columns, np.ndarray]:
        nth, many = _owners(x, owner)
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])))
        sent = (many == 1) | (first & (nth < 2))
        return (owner[~sent], place[~sent].astype(np.int64)), sent

    def finish(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Columns:
        some = _owners(x, owner)[1] > 1
        return owner[some], place[some].astype(np.int64)

    return meet(rows, postings, local, finish, ranges, names)


def counted(rows: DataFrame, postings: Callable[[pa.RecordBatch], Iterator[Postings]], ranges: int, names: tuple[str, str], bits: int) -> DataFrame:
    """(owner, how many of its keys another owner has too), in parts that are to be added up. What a block knows by itself may
    be counted again for an owner that another block has too: the sums are never too small."""

    def local(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[Columns, np.ndarray]:
        nth = _owners(x, owner)[0]
        return np.unique(owner[nth > 1], return_counts=True), nth < 2

    def finish(x: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Columns:
        return np.unique(owner[_owners(x, owner)[1] > 1], return_counts=True)

    return meet(rows, postings, local, finish, ranges, names, bits)
