"""Language identification by cross-parsing entropy.

For every language, the suffix automaton of a sample of labelled text is built. A text is parsed against it into longest
matches: from each position, the longest stretch that occurs in the sample is a phrase, and the next one starts after it.
The language that needs the fewest bits wins: as many for a phrase as it takes to say where in the sample it is, the logarithm
of the sample's length. So a language of which there is little labelled text isn't at a disadvantage.

As each parse starts anew at the automaton's root, an automaton and the rule for restarting are one table of transitions.
Texts are cut into lanes of LANE symbols, and all lanes step through all languages' tables together in numpy. A lane's
end also ends a phrase, in every language alike. Where languages with many letters would make the table larger than DENSE cells,
only the moves that there are are kept, in order, and looked up by bisection; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from roadloom.llm.scratch import give_back
from roadloom.llm.textops import LETTER, chunks, classes, flat, freed, small_batches

#: The sample that a model is fitted on: so many excerpts of so many characters for each language.
EXCERPTS, EXCERPT_CHARS = 150, 160
LANE, PAD, BLANK, UNKNOWN = 512, 0, 1, 2
UNDETERMINED = "und"
#: Most cells of a table with a cell for each state and symbol.
DENSE = 1 << 25


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # of each code point
    moves: np.ndarray  # state row + symbol -> next state row << 1 | whether a phrase ends; with keys, of each key
    roots: np.ndarray  # of each language
    lengths: np.ndarray  # of each language's sample, in symbols
    keys: np.ndarray | None = None  # state row + symbol of the moves that go on with a phrase, in order
    starts: np.ndarray | None = None  # by language and symbol: where a phrase that starts anew goes

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The moves of states (a row for each language) by symbols."""
        if self.keys is None:
            return self.moves[state + symbol]
        key = state + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.moves[at], self.starts[:, symbol])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 first."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def excerpts(docs: DataFrame, per_language: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> DataFrame:
    """(lang, excerpt) of the labelled documents that aren't held out: for each language, per_language documents of the
    lowest hashes, and of each an excerpt of ``chars`` characters at a hashed place."""
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    known = docs.filter(ok).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    order = F.xxhash64(F.lit("langid"), "doc_id")
    share = F.lit(1.0)
    for lang, n in counts.items():  # hashes this low are enough for the documents that are looked for
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4.0 * per_language / n))).otherwise(share)
    near = known.filter(F.pmod(order, F.lit(1 << 20)) <= share * (1 << 20))
    spread = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    cut = near.select("lang", order.alias("o"), F.substring("text", F.pmod(F.xxhash64(F.lit("at"), "doc_id"), spread).cast("int") + 1, F.lit(chars)).alias("excerpt"))
    return cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "excerpt"))).filter(F.col("n") <= per_language).select("lang", "excerpt", "n")


def fit(samples: list[tuple[str, str]], dense: int = DENSE) -> Model:
    """A model of (language, text) pairs; empty if there are none."""
    texts: dict[str, list[str]] = {}
    for (lang, _), text in zip(samples, pc.utf8_lower(pa.array([t for _, t in samples], pa.string())).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    letters = sorted({c for ts in texts.values() for t in ts for c in t if classes()[ord(c)] == LETTER})
    symbols = np.where(classes() == LETTER, UNKNOWN, BLANK).astype(np.uint32)
    for k, c in enumerate(letters):
        symbols[ord(c)] = UNKNOWN + 1 + k
    width = UNKNOWN + 1 + len(letters)
    languages, roots, lengths, base = sorted(texts), [], [], 0
    keys, goals, starts = [], [], []
    for lang in languages:
        joined = f" {UNSEEN} ".join(sorted(texts[lang]))
        said = collapse(symbols[np.frombuffer(joined.encode("utf-32-le"), np.uint32)])[0].tolist()
        states = suffix_automaton(said)
        known = np.array([(base + s, c, base + t) for s, row in enumerate(states) for c, t in row.items() if c != UNKNOWN], np.int64).reshape(-1, 3)  # UNKNOWN: what parts the excerpts, and letters of no language
        keys.append(known[:, 0] * width + known[:, 1])
        goals.append(known[:, 2] * width << 1)
        first = known[known[:, 0] == base]
        start = np.full(width, base * width << 1 | 1)
        start[first[:, 1]] = first[:, 2] * width << 1 | 1
        starts.append(start)
        # What fills up a lane leaves the state as it is.
        stay = np.arange(base, base + len(states)) * width
        keys.append(stay + PAD)
        goals.append(stay << 1)
        roots.append(base * width)
        lengths.append(len(said))
        base += len(states)
    own = np.array(roots, np.int64)[:, None], np.array(lengths, np.int64)
    if not languages:
        return Model([], symbols, np.zeros(0, np.int32), *own)
    keys, goals, starts = np.concatenate(keys), np.concatenate(goals), np.stack(starts)
    if base * width > dense:
        order = np.argsort(keys)
        return Model(languages, symbols, goals[order], *own, keys[order], starts)
    moves = np.concatenate([np.tile(start, n) for start, n in zip(starts, np.diff([*(r // width for r in roots), base]), strict=True)])
    moves[keys] = goals
    return Model(languages, symbols, moves.astype(np.int32), own[0].astype(np.int32), own[1])


UNSEEN = "\U000f0000"  # a private character: no letter


def collapse(symbols: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks count once; also where each kept symbol was. edge: where texts begin."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
    if edge is not None:
        keep[edge[edge < len(symbols)]] = True
    at = np.flatnonzero(keep)
    return symbols[at], at


def phrases(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by text and language, symbols and letters by text."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    raw, at = flat(lowered)
    cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    edge = points[at]
    letters = np.diff(np.concatenate(([0], np.cumsum(classes()[cp] == LETTER)))[edge])
    symbols, place = collapse(model.symbols[cp], edge[:-1])
    begin = np.searchsorted(place, edge)
    size = np.diff(begin)
    lanes = -(-size // LANE)
    owner = np.repeat(np.arange(len(size)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = begin[:-1][owner] + nth * LANE
    length = np.minimum(size[owner] - nth * LANE, LANE)
    order = np.argsort(-length, kind="stable")
    first, length, owner = first[order], length[order], owner[order]
    out = np.zeros((len(model.languages), len(size)), np.int64)
    n_langs = len(model.languages)
    padded = np.concatenate((symbols, np.zeros(LANE, symbols.dtype)))
    count = np.zeros((n_langs, len(owner)), np.int32)
    state = np.repeat(model.roots, len(owner), axis=1)
    alive = np.searchsorted(-length, -np.arange(1, LANE + 1), side="right")  # lanes that reach each step
    for step in range(int(length.max(initial=0))):
        n = int(alive[step])
        move = model.step(state[:, :n], padded[first[:n] + step])
        count[:, :n] += move & 1
        state[:, :n] = move >> 1
    for k in range(n_langs):
        out[k] = np.bincount(owner, count[k] + 1, minlength=len(size))
    return out.T, size, letters


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1: how many fewer bits the winner needs than the runner-up, as a share) and
    phrase_rate (the winner's phrases for each symbol). Columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the model has no language.
    With one language alone the score is 1. Ties go to the first language in order.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())])
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    names = [*keep, *added.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at, part in chunks(b.column("text_to_parse")):
                found, size, letters = phrases(own, part)
                n = len(size)
                und = letters == 0
                if own.languages:
                    bits = found * np.log2(own.lengths + 1)
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(n), best]
                    second = np.partition(bits, 1, axis=1)[:, 1] if len(own.languages) > 1 else np.full(n, np.inf)
                    score = 1 - low / np.maximum(second, 1)
                    rate = found[np.arange(n), best] / np.maximum(size, 1)
                    lang = np.array(own.languages, object)[best]
                else:
                    score, rate, lang, und = np.zeros(n), np.zeros(n), np.full(n, UNDETERMINED, object), np.ones(n, bool)
                lang[und], score[und], rate[und] = UNDETERMINED, 0.0, 1.0
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, n) for c in keep), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rate)], names)

    schema = T.StructType([docs.schema[c] for c in keep] + added.fields)
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("text_to_parse")).mapInArrow(freed(work), schema)


def train(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled documents that aren't held out."""
    model = fit([(r["lang"], r["excerpt"]) for r in excerpts(docs).orderBy("lang", "n").collect()])
    give_back(docs.sparkSession)
    return model


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, by a model of those that aren't held out."""
    model = train(docs.select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(slim, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
