"""Map elements from protocol buffer extracts (.osm.pbf), as a Python data source: a partition for each run of blobs.

Only what the element table needs is decoded. The reading follows the public description of the format: length-prefixed
blobs, each a zlib-compressed block with a string table and groups of nodes, dense nodes, ways and relations.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from roadloom.sources.osm_json import ELEMENT

BLOBS_A_TASK = 64
# Member types by number.
MEMBER = ["node", "way", "relation"]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as ints, everything else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def running(values: list[int]) -> list[int]:
    out, now = [], 0
    for v in values:
        now += signed(v)
        out.append(now)
    return out


def decode(block: bytes) -> Iterator[tuple]:
    """The elements of a block, as rows of ELEMENT."""
    texts, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            texts = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            grain = v
        elif n in (19, 20):
            lat0, lon0 = (v - (1 << 64) if v >> 63 else v, lon0) if n == 19 else (lat0, v - (1 << 64) if v >> 63 else v)
    degrees = lambda v, zero: repr((zero + grain * v) / 1e9)

    def tagged(f: dict[int, bytes]) -> dict[str, str]:
        return {texts[k]: texts[v] for k, v in zip(packed(f.get(2, b"")), packed(f.get(3, b"")), strict=True)}

    for group in groups:
        for n, v in fields(group):
            f = dict(fields(v))
            if n == 1:
                yield "node", str(signed(f[1])), degrees(signed(f[8]), lat0), degrees(signed(f[9]), lon0), None, None, tagged(f)
            elif n == 2:
                words, at = packed(f.get(10, b"")), 0
                for i, y, x in zip(running(packed(f[1])), running(packed(f[8])), running(packed(f[9])), strict=True):
                    tags = {}
                    while at < len(words) and words[at]:
                        tags[texts[words[at]]] = texts[words[at + 1]]
                        at += 2
                    at += 1
                    yield "node", str(i), degrees(y, lat0), degrees(x, lon0), None, None, tags
            elif n == 3:
                yield "way", str(f[1]), None, None, [str(i) for i in running(packed(f.get(8, b"")))], None, tagged(f)
            elif n == 4:
                members = [{"type": MEMBER[t], "ref": str(i), "role": texts[r]} for r, i, t in zip(packed(f.get(8, b"")), running(packed(f.get(9, b""))), packed(f.get(10, b"")), strict=True)]
                yield "relation", str(f[1]), None, None, None, members, tagged(f)


def blobs(path: str) -> Iterator[tuple[int, int]]:
    """(offset, length) of every data blob."""
    with open(path, "rb") as f:
        end = os.path.getsize(path)
        while f.tell() < end:
            head = dict(fields(f.read(struct.unpack(">I", f.read(4))[0])))
            at, size = f.tell(), head[3]
            if head[1] == b"OSMData":
                yield at, size
            f.seek(at + size)


def inflate(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 3 in f:
        return zlib.decompress(f[3])
    if 1 in f:
        return f[1]
    raise ValueError("only zlib and raw blobs are supported")


@dataclass
class Blobs(InputPartition):
    path: str
    places: list[tuple[int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blobs]:
        found = list(blobs(self.path))
        return [Blobs(self.path, found[k : k + BLOBS_A_TASK]) for k in range(0, len(found), BLOBS_A_TASK)] or [Blobs(self.path, [])]

    def read(self, part: Blobs) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            for at, size in part.places:
                f.seek(at)
                yield from decode(inflate(f.read(size)))


class PbfSource(DataSource):
    """``spark.read.format("osm_pbf").load(path)``; the file must be where driver and executors can open it."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("path", path).load()
