"""Substring dedup: passages that several documents share, by paragraph MinHash banding.

Paragraphs of two kinds are banded, of every distinct text and whatever others hold:

1. Windows of MIN_WORDS words. Where one begins is chosen by the words themselves: of any SURE - MIN_WORDS + 1 places in a row,
   that of the least hash. So two texts that share SURE words in a row, wherever these stand, share a window. A window is one
   band as a whole: windows meet if they are equal. Each is stretched, word by word, over what surrounds it in the first
   document that has it too; windows of a document that touch make a passage, which so ends at the very word.
2. Natural paragraphs, for near copies: lines of MIN_WORDS words or more; shorter ones are joined until they have as many, and
   a long one is cut at sentences chosen by their first words. Bands of a MinHash are tuned for recall at the threshold, paragraphs
   that collide are joined, exact Jaccard similarity of five-word shingles is verified, and components make the clusters.

The first document (least doc_id) that has a passage keeps it; the others' occurrences are removals. A copy of a whole text is one.
Words that repeat one phrase over and over (under half of the shingles distinct) are no passage: junk of that kind is alike
without being copied. What lies inside another passage of the same document is not listed besides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm import simjoin
from roadloom.llm.components import components
from roadloom.llm.ranges import Postings, common, enough, stars
from roadloom.llm.scratch import Scratch
from roadloom.llm.simjoin import node_ids
from roadloom.llm.textops import CHUNK_BYTES, chunks, flat, freed, gather, mix, powers, shingle_sets, word_hashes, words

#: Words of a window, and that a natural paragraph has at least; words in a row that are sure to hold a window; words that
#: choose where a window begins; words of a shingle.
MIN_WORDS, SURE, GRAM, SHINGLE = 40, 51, 8, 5
#: Sentences over LONG words are cut at one word in ONE_IN; lines are cut into pieces of PIECE words at least, at one sentence in four.
LONG, ONE_IN, PIECE = 30, 8, 50
#: The similarity, and the recall that bands aim at.
SIMILAR, RECALL = 0.75, 0.999
#: Places where a window may begin, of which one is chosen; and how far it is stretched on either side, at most.
SPAN, REACH = SURE - MIN_WORDS + 1, SURE - MIN_WORDS
#: About how many words there are for each window, and for each natural paragraph.
WORDS_A_WINDOW, WORDS_A_PARAGRAPH = 6, 60


def bands(similar: float = SIMILAR, recall: float = RECALL, budget: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows a band such that pairs at the threshold meet with the recall asked for."""
    for rows in range(16, 0, -1):
        n = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        if n * rows <= budget:
            return n, rows
    raise ValueError("the budget of hashes is too small for this recall")


class Sentences:
    """The words and sentences of some texts: where each word begins and ends in bytes, and which words each sentence has."""

    def __init__(self, column: pa.Array):
        raw, at = flat(column)
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        blank = ((data >= 9) & (data <= 13)) | (data == 32)
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate(([True], blank[:-1])) if len(data) else np.zeros(0, bool)
        after = np.concatenate((blank[1:], [True])) if len(data) else np.zeros(0, bool)
        self.start = np.flatnonzero(~blank & (before | edge[:-1]))
        self.end = np.flatnonzero(~blank & (after | edge[1:])) + 1
        flat_words, self.counts = words(column)
        self.hashes = word_hashes(flat_words)
        n = len(self.start)
        self.text_word = np.concatenate(([0], np.cumsum(self.counts)))
        self.text_at = at
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        stop = np.isin(data[self.end - 1], np.frombuffer(b".!?", np.uint8)) if n else np.zeros(0, bool)
        first = np.zeros(n + 1, bool)
        first[self.text_word] = True
        first[1:n] |= stop[:-1] | (lines[self.start[1:]] > lines[self.end[:-1]])
        unit = np.flatnonzero(first[:n])
        length = np.diff(np.append(unit, n))
        long = np.repeat(length > LONG, length)
        first[:n] |= long & (mix(self.hashes) % np.uint64(ONE_IN) == 0)
        self.unit = np.flatnonzero(first[:n])  # the first word of each sentence
        self.length = np.diff(np.append(self.unit, n))
        head = np.zeros(n + 1, bool)
        head[self.text_word] = True
        head[1:n] |= lines[self.start[1:]] > lines[self.end[:-1]]
        self.line = head[self.unit]  # whether a sentence begins a line
        # A sentence is named by its first two words, so that changes in it don't move the cuts.
        second = self.hashes[np.minimum(self.unit + 1, n - 1)] if n else self.hashes
        self.name = mix(self.hashes[self.unit] ^ mix(np.where(self.length > 1, second, np.uint64(0))))
        self.text_unit = np.searchsorted(self.unit, self.text_word)

    def points(self, text: int, byte: int) -> int:
        """The code point of a text at a byte of all."""
        return len(self.raw[self.text_at[text] : byte].decode())


class Seen:
    """Which names a task has met; only the first of each is worked on."""

    def __init__(self) -> None:
        self.names: set[int] = set()

    def fresh(self, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes.tolist()):
            if x not in self.names:
                self.names.add(x)
                out[i] = True
        return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each word on, as far as there are as many. Texts are not told apart."""
    up, down = powers(max(CHUNK_BYTES, 1 << len(hashes).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    n = max(len(hashes) - size + 1, 0)
    return mix((total[size : size + n] - total[:n]) * down[:n])


def distinct_shingles(hashes: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many distinct shingles each window has that begins at one of the words at."""
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    g = rolling(hashes, SHINGLE)
    g ^= mix(owner[: len(g)])
    order = np.argsort(g, kind="stable")
    before = np.full(len(g), -1)
    same = g[order[1:]] == g[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    fresh = np.zeros(len(at), np.int32)
    for j in range(MIN_WORDS - SHINGLE + 1):
        fresh += before[at + j] < at
    return fresh


def chosen(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words at which windows begin (the last of equal ones)."""
    end = np.cumsum(counts)
    left = np.repeat(end, counts) - np.arange(len(hashes))
    key = rolling(hashes, GRAM)
    start = np.flatnonzero(left >= SURE)
    out = [np.zeros(0, np.int64)]
    if len(start):
        seen = np.lib.stride_tricks.sliding_window_view(key, SPAN)[start]
        out.append(start + SPAN - 1 - seen[:, ::-1].argmin(axis=1))
    for t in np.flatnonzero((counts >= MIN_WORDS) & (counts < SURE)).tolist():  # fewer places than SPAN
        a, b = end[t] - counts[t], end[t] - MIN_WORDS + 1
        out.append(np.array([b - 1 - key[a:b][::-1].argmin()]))
    at = np.unique(np.concatenate(out))
    return at[2 * distinct_shingles(hashes, counts, at) >= MIN_WORDS - SHINGLE + 1] if len(at) else at


def windows(texts: DataFrame, ranges: int) -> DataFrame:
    """(body, at: the first word) of the windows that two texts have."""

    def postings(b: pa.RecordBatch) -> Iterator[Postings]:
        for at, part in chunks(b.column(1)):
            body = b.column(0).slice(at, len(part)).to_numpy()
            flat_words, counts = words(part)
            h = word_hashes(flat_words)
            first = chosen(h, counts)
            owner = np.repeat(np.arange(len(body)), counts)[first]
            yield rolling(h, MIN_WORDS)[first], body[owner], (first - (np.cumsum(counts) - counts)[owner]).astype(np.int32)

    return common(texts.select("body", "text"), postings, ranges, ("body", "at"))


def surroundings(texts: DataFrame) -> DataFrame:
    """From (body, doc_id, text, hits: windows' first words): (node, body, doc_id, at, around) for each window. around: 32 bits of
    the hashes of REACH words on either side (0: there is none), then the code points at which the REACH words before the
    window and the window begin, and at which the window and the REACH words after it end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks(b.column(2)):
                s = Sentences(part)
                hits = b.column(3).slice(at, len(part))
                owner = np.repeat(np.arange(len(part)), np.diff(hits.offsets.to_numpy()))
                word = hits.flatten().to_numpy().astype(np.int64)
                first = word + s.text_word[owner]
                place = first[:, None] + np.concatenate((np.arange(-REACH, 0), MIN_WORDS + np.arange(REACH)))
                there = (place >= s.text_word[owner][:, None]) & (place < s.text_word[owner + 1][:, None])
                hashes = np.where(there, s.hashes[np.where(there, place, 0)].astype(np.uint32) | np.uint32(1), np.uint32(0))
                # Code points before each byte: all bytes but those that go on with one.
                point = np.concatenate(([0], np.cumsum((np.frombuffer(s.raw, np.uint8) & 0xC0) != 0x80)))
                base = point[s.text_at[owner]][:, None]
                lo, hi = s.text_word[owner][:, None], s.text_word[owner + 1][:, None] - 1
                begins = point[s.start[np.maximum(first[:, None] + np.arange(-REACH, 1), lo)]] - base
                ends = point[s.end[np.minimum(first[:, None] + MIN_WORDS - 1 + np.arange(REACH + 1), hi)]] - base
                around = np.concatenate((hashes, begins.astype(np.uint32), ends.astype(np.uint32)), axis=1)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(np.arange(len(word) + 1) * (around.shape[1] * 4)), pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rolling(s.hashes, MIN_WORDS)[first].view(np.int64)), *(b.column(k).slice(at, len(part)).take(pa.array(owner)) for k in (0, 1)), pa.array(word.astype(np.int32)), raw], ["node", "body", "doc_id", "at", "around"])

    return texts.select("body", "doc_id", "text", "hits").mapInArrow(freed(work), "node bigint, body bigint, doc_id bigint, at int, around binary")


def stretched(rows: DataFrame) -> DataFrame:
    """From (node, body, doc_id, at, around, kept_doc, kept_body, other, before, after): each window with as many words before and after it as
    are given, or, if null, as are the same around ``other``: (node, body, doc_id, left, right: words; first, last: code points;
    before, after, kept_doc, kept_body)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (4, 7)]
            same = (both[0][:, : 2 * REACH] == both[1][:, : 2 * REACH]) & (both[0][:, : 2 * REACH] != 0)
            given = [np.asarray(b.column(k).fill_null(-1)).astype(np.int64) for k in (8, 9)]
            before = np.where(given[0] < 0, np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1), given[0])
            after = np.where(given[1] < 0, np.cumprod(same[:, REACH:], axis=1).sum(axis=1), given[1])
            at, row = b.column(3).to_numpy().astype(np.int64), np.arange(b.num_rows)
            first, last = both[0][row, 3 * REACH - before], both[0][row, 3 * REACH + 1 + after]
            numbers = (at - before, at + MIN_WORDS + after, first.astype(np.int64), last.astype(np.int64), before, after)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), *map(pa.array, numbers), b.column(5), b.column(6)], names)

    names = ["node", "body", "doc_id", "left", "right", "first", "last", "before", "after", "kept_doc", "kept_body"]
    kinds = ", ".join(f"{c} bigint" for c in names)
    return rows.select("node", "body", "doc_id", "at", "around", "kept_doc", "kept_body", "other", "before", "after").mapInArrow(freed(work), kinds)


def spans(found: list[tuple]) -> list[tuple]:
    """From a text's stretched windows (left, right, first, last, component, removed): (first, last, n_words, component, removed) of
    the passages that those of one component make together."""
    out, now = [], None
    for left, right, first, last, *kind in sorted(found, key=lambda x: (x[4] is None, x[4] or 0, x[5], x[0], x[1])):
        if now and now[4:] == kind and left <= now[1]:
            if right > now[1]:
                now[1], now[3] = right, last
            continue
        if now:
            out.append((now[2], now[3], now[1] - now[0], *now[4:]))
        now = [left, right, first, last, *kind]
    if now:
        out.append((now[2], now[3], now[1] - now[0], *now[4:]))
    return out


def united(found: list[tuple]) -> list[tuple]:
    """A document's passages (first, last, n_words, component, removed) without those that lie inside others: removed ones
    come first, then long ones. No two begin at the same place."""
    out: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (not x[4], x[0] - x[1], x[0])):
        if any(y[0] <= x[0] and x[1] <= y[1] for y in out):
            continue
        for y in sorted(out):
            if y[0] == x[0]:  # y is removed, and a part of x: the rest of x stays
                x = (y[1], x[1], x[2] - y[2], *x[3:])
        out.append(x)
    return out


ROWS = "body bigint, doc_id bigint, first bigint, last bigint, n_words bigint, component_id bigint, removed boolean"


def as_rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (*[pa.int64()] * 6, pa.bool_()), strict=True)], names)


def by_text(found: DataFrame, columns: list[str], make) -> DataFrame:
    """ROWS that make(list of the columns' values) gives for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, doc, rows in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                out += [(body, doc, *x) for x in make([tuple(r.values()) for r in rows])]
            if out:
                yield as_rows(out)

    return found.groupBy("body", "doc_id").agg(F.collect_set(F.struct(*columns)).alias("rows")).mapInArrow(freed(work), ROWS)


def blocks(s: Sentences, text: int) -> list[tuple[int, int]]:
    """The natural paragraphs of a text, as (first sentence, after the last)."""
    p, q = int(s.text_unit[text]), int(s.text_unit[text + 1])
    if s.counts[text] < MIN_WORDS:
        return []
    heads = np.append(p + np.flatnonzero(s.line[p:q]), q).tolist()
    out, a, held = [], p, 0
    for b, z in zip(heads[:-1], heads[1:], strict=True):
        n = int(s.unit[z - 1] + s.length[z - 1] - s.unit[b])
        if n >= MIN_WORDS:  # what short lines came before it are not part of it
            a, held = b, 0
        held += n
        if held >= MIN_WORDS:
            out += pieces(s, a, z, held) if held >= 2 * PIECE else [(a, z)]
            a, held = z, 0
    return out


def pieces(s: Sentences, a: int, z: int, left: int) -> list[tuple[int, int]]:
    """Sentences a to z, of left words in all, cut where a sentence's name says so and PIECE words are on either side."""
    out, held = [], 0
    for u, (n, name) in enumerate(zip(s.length[a:z].tolist(), (s.name[a:z] % np.uint64(4)).tolist(), strict=True), a):
        if held >= PIECE and left >= PIECE and name == 0:
            out.append((a, u))
            a, held = u, 0
        held += n
        left -= n
    return [*out, (a, z)]


def found_in(column: pa.Array, wanted: np.ndarray) -> tuple[Sentences, np.ndarray, np.ndarray, np.ndarray]:
    """The natural paragraphs of the texts wanted: the texts' sentences, (text, first word, after the last) of each, and their
    sets with their sizes."""
    s = Sentences(column)
    found = [(t, a, z) for t in np.flatnonzero(wanted).tolist() for a, z in blocks(s, t)]
    owner, a, z = np.array(found, np.int64).reshape(-1, 3).T
    word, end = s.unit[a], s.unit[z - 1] + s.length[z - 1]
    if not len(owner):
        return s, np.zeros((3, 0), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = shingle_sets(s.hashes[gather(word, end - word)], end - word)
    ok = 2 * n >= end - word
    return s, np.stack((owner, word, end))[:, ok], h[np.repeat(ok, n)], n[ok]


def paragraphs(texts: DataFrame, columns: str) -> DataFrame:
    """Of the natural paragraphs of all texts, the columns named: body, first, last (code points), n_words, node, n (distinct shingles),
    hashes (their set). A task looks at each text once."""
    wanted = columns.split(", ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = Seen()
        for b in batches:
            for at, part in chunks(b.column(1)):
                body = b.column(0).slice(at, len(part)).to_numpy()
                s, (owner, word, end), h, n = found_in(part, done.fresh(body))
                if not len(n):
                    continue
                point = np.concatenate(([0], np.cumsum((np.frombuffer(s.raw, np.uint8) & 0xC0) != 0x80)))
                base = point[s.text_at[owner]]
                made = {"body": lambda: pa.array(body[owner]), "first": lambda: pa.array(point[s.start[word]] - base), "last": lambda: pa.array(point[s.end[end - 1]] - base), "n_words": lambda: pa.array(end - word), "node": lambda: pa.array(node_ids(h, n)), "n": lambda: pa.array(n), "hashes": lambda: pa.array(simjoin.split(h, n), pa.binary())}
                yield pa.RecordBatch.from_arrays([made[c]() for c in wanted], wanted)

    kinds = ", ".join(f"{c} {({'hashes': 'binary'}).get(c, 'bigint')}" for c in wanted)
    return texts.select("body", "text").mapInArrow(freed(work), kinds)


def body(text: str = "text") -> Column:
    return F.xxhash64(text).alias("body")


def exact(texts: DataFrame, first: DataFrame, n_words: int, scratch: Scratch) -> DataFrame:
    """ROWS of passages around windows that two texts have. texts: (body, doc_id, text); first: (body, doc_id) of each text's first document;
    n_words: of all texts."""
    hits = windows(texts, enough(n_words // WORDS_A_WINDOW)).groupBy("body").agg(F.collect_set(F.col("at").cast("int")).alias("hits"))
    hits = scratch.table(scratch.table(hits, "places").join(first, "body"), "hits")
    scratch.settle()
    some = texts.select("body", "text").join(simjoin.small(hits.select("body")), "body", "left_semi")
    around = scratch.table(surroundings(some.join(hits, "body")), "around")
    scratch.settle()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "at", "around")
    kept = scratch.table(around.groupBy("node").agg(F.min(order).alias("kept")), "kept")
    both = around.join(kept, "node").filter("body <> kept.body")
    none = F.lit(None).cast("long")
    copies = scratch.table(stretched(both.withColumns({"kept_doc": F.col("kept.doc_id"), "kept_body": F.col("kept.body"), "other": F.col("kept.around"), "before": none, "after": none})), "copies")
    scratch.remove("around")
    scratch.settle()
    reach = copies.groupBy("node").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    own = kept.select("node", "kept.*").join(reach, "node").withColumns({"kept_doc": F.col("doc_id"), "kept_body": F.col("body"), "other": F.col("around")})
    found = copies.unionByName(stretched(own)).withColumn("removed", F.col("body") != F.col("kept_body"))
    out = by_text(found.withColumnRenamed("kept_doc", "component_id"), ["left", "right", "first", "last", "component_id", "removed"], spans)
    return scratch.table(out, "exact")


def banded(texts: DataFrame, ranges: int) -> DataFrame:
    """(a, b): ties of the paragraphs that share a band."""
    n_bands, rows = bands()
    odd = mix(np.arange(1, n_bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def postings(b: pa.RecordBatch) -> Iterator[Postings]:
        for _, part in chunks(b.column(1)):
            h, n = found_in(part, np.ones(len(part), bool))[2:]
            node = node_ids(h, n)
            once = np.zeros(len(n), bool)
            once[np.unique(node, return_index=True)[1]] = True
            h, n, node = h[np.repeat(once, n)], n[once], node[once]
            if not len(n):
                continue
            start = np.cumsum(n) - n
            x = mix(h)
            low = np.stack([np.minimum.reduceat(x * k, start) for k in odd]).reshape(n_bands, rows, len(n))
            keys = np.zeros((n_bands, len(n)), np.uint64) + np.arange(n_bands, dtype=np.uint64)[:, None]
            for r in range(rows):
                keys = mix(keys ^ low[:, r])
            yield keys.ravel(), np.tile(node, n_bands), np.zeros(keys.size, np.int32)

    return stars(texts.select("body", "text"), postings, ranges)


def near(texts: DataFrame, first: DataFrame, n_words: int, scratch: Scratch) -> DataFrame:
    """ROWS of natural paragraphs that two texts have, as copies or near copies."""
    found = scratch.table(paragraphs(texts, "body, first, last, n_words, node"), "paragraphs")
    edges = scratch.table(banded(texts, enough(bands()[0] * n_words // WORDS_A_PARAGRAPH)).distinct(), "ties")
    scratch.settle()
    wanted = scratch.table(edges.selectExpr("explode(array(a, b)) AS node").distinct(), "wanted")
    holders = found.join(simjoin.small(wanted), "node").groupBy("node").agg(F.min("body").alias("body"))
    some = texts.join(simjoin.small(scratch.table(holders.select("body").distinct(), "holders")), "body", "left_semi")
    sets = paragraphs(some, "node, n, hashes").join(simjoin.small(wanted), "node", "left_semi")
    of = scratch.table(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "sets")
    scratch.settle()
    roots = components(simjoin.link(scratch, edges, of), scratch)
    both = found.groupBy("node").agg(F.min("body").alias("a"), F.max("body").alias("b"))
    nodes = scratch.table(both.join(roots, "node", "full").filter("root IS NOT NULL OR a <> b").select("node", F.coalesce("root", "node").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "nodes")
    named = scratch.table(found.join(simjoin.small(nodes), "node").join(first, "body").select("root", "body", "doc_id", "first", "last", "n_words").distinct(), "named")
    scratch.settle()
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body", "first")
    kept = named.groupBy("root").agg(F.min("body").alias("a"), F.max("body").alias("b"), F.min(place).alias("keeper")).filter("a <> b").select("root", "keeper")
    out = named.join(scratch.table(kept, "keepers"), "root").withColumn("removed", F.col("body") != F.col("keeper.body"))
    return scratch.table(out.select("body", "doc_id", "first", "last", "n_words", F.col("keeper.doc_id").alias("component_id"), "removed"), "near")


def repeats(docs: DataFrame) -> DataFrame:
    """ROWS: every occurrence of a passage that two documents or more share, by doc_id and body (a hash of the text); first and
    last are code points. component_id is the doc_id of the occurrence that stays (the least doc_id, then the first in it; a
    null doc_id comes last); removed is false for that one, and for what else that document has of the passage.

    Null and empty texts have no passages. Rows of equal doc_id and text are one document; what repeats only inside one
    document is no repeat. A copy of another document's text of MIN_WORDS words or more is a passage as a whole, and only the
    first of equal texts is searched for others. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    texts = docs.select(body(), "doc_id", "text").filter("text IS NOT NULL")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    named = scratch.table(texts.select("body", "doc_id", n_words, F.length("text").cast("long").alias("last")), "bodies")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    least = named.groupBy("body").agg(F.min(order).alias("least"), F.max(order).alias("most"), F.first("n_words").alias("n_words"), F.first("last").alias("last"))
    least = scratch.table(least.select("body", F.col("least.doc_id").alias("doc_id"), (F.col("least") != F.col("most")).alias("copied"), "n_words", "last"), "least")
    first = least.select("body", "doc_id")
    whole = least.filter((F.col("n_words") >= MIN_WORDS) & F.col("copied")).withColumnRenamed("doc_id", "component_id")
    copies = named.select("body", "doc_id").join(simjoin.small(whole), "body")
    copies = copies.select("body", "doc_id", F.lit(0).cast("long").alias("first"), "last", "n_words", "component_id", (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("removed")).distinct()
    total = named.agg(F.sum("n_words")).first()[0] or 0
    found = scratch.table(copies, "whole").unionByName(exact(texts, first, total, scratch)).unionByName(near(texts, first, total, scratch))
    scratch.only("whole", "exact", "near")
    return by_text(found, ["first", "last", "n_words", "component_id", "removed"], united)


def repeated_passages(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "first", "last", "n_words", "component_id", "removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed passages cut out of the text, and n_chars following it. Documents of which no word is left go;
    others, also those without words from the start, stay."""
    scratch = Scratch(docs.sparkSession, "cut")
    cuts = repeats(docs).filter("removed").groupBy("body", "doc_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("first", "last")))).alias("spans"))
    cuts = scratch.table(cuts.select(F.col("body").alias("cut_body"), F.col("doc_id").alias("cut_doc"), "spans"), "spans")
    both = docs.join(simjoin.small(cuts, "spans"), (F.xxhash64("text") == F.col("cut_body")) & docs["doc_id"].eqNullSafe(F.col("cut_doc")), "left")
    # What lies between the spans: from each one's end to the next one's start.
    reach = F.expr("transform(sequence(0, size(spans)), k -> CASE WHEN k = 0 THEN 0L ELSE array_max(transform(slice(spans, 1, k), s -> s.last)) END)")
    starts = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.length("text").cast("long")))
    rest = F.array_join(F.zip_with(reach, starts, lambda a, b: F.substring("text", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))), "")
    cut = both.withColumn("rest", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rest))
    cut = cut.filter(F.col("spans").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("rest")} | ({"n_chars": F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("rest").cast("long"))} if "n_chars" in docs.columns else {})
    return cut.select(*(changed.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns))
