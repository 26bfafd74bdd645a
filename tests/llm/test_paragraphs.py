import random

import numpy as np
import pyarrow as pa

from roadloom.llm import paragraphs as P

from .conftest import SF


def sentence(rng, n=None):
    return (" ".join("v" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(n or rng.randint(3, 16))) + rng.choice(".!?")).capitalize()


def prose(rng, n_words):
    out = []
    while sum(len(s.split()) for s in out) < n_words:
        out.append(sentence(rng))
    return rng.choice((" ", "\n")).join(out)


def corpus(rng):
    """Documents, and which of them share a passage with another."""
    passages = [prose(rng, n) for n in (51, 60, 60, 80, 150, 300)]
    rows, planted = [], {}
    for k in range(260):
        parts = [prose(rng, rng.randint(5, 200)) for _ in range(2)]
        if k % 3 == 0:
            p = (k // 3) % len(passages)
            planted.setdefault(p, []).append(k)
            words = passages[p].split(" ")
            if k % 5 == 1 and p > 3:  # a near copy
                words[len(words) // 2] = "another"
            parts.insert(rng.randrange(3), " ".join(words))
        rows.append((k, rng.choice((" ", "\n")).join(parts)))
    return rows, planted, passages


def test_sentences():
    texts = ["One two. Three\nfour!  Five", None, "", " \n ", "é x?y z. ", "tail"]
    s = P.Sentences(pa.array(texts))
    got = [[s.raw[s.start[s.unit[u]] : s.end[s.unit[u] + s.length[u] - 1]].decode() for u in range(s.text_unit[t], s.text_unit[t + 1])] for t in range(len(texts))]
    assert got == [["One two.", "Three", "four!", "Five"], [], [], [], ["é x?y z."], ["tail"]]
    same = P.Sentences(pa.array(["a b c d e. f", "x. A  B\tc d E. "]))
    assert same.name[0] == same.name[3]


def test_bands():
    n, rows = P.bands()
    assert 1 - (1 - 0.75**rows) ** n >= P.RECALL and n * rows <= 64


def test_pieces():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (30, 45, 300)] + ["\n".join(sentence(rng, 4) for _ in range(40)), "a b c\n" + " ".join(sentence(rng, 12) for _ in range(5))]
    s = P.Sentences(pa.array(texts))
    found = [P.blocks(s, t) for t in range(len(texts))]
    size = lambda a, z: int(s.length[a:z].sum())
    assert not found[0] and all(size(*x) >= P.MIN_WORDS for f in found for x in f)
    assert [size(*x) for x in found[3]] == [40] * 4 and [size(*x) for x in found[4]] == [60]
    assert all(a[1] <= b[0] for f in found for a, b in zip(f, f[1:]))


def test_windows():
    """Any SURE words in a row hold the same window, whatever surrounds them."""
    rng = random.Random(3)
    plain = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(50):
        shared = plain(P.SURE)
        texts = [plain(rng.randrange(90)) + shared + plain(rng.randrange(90)) for _ in range(3)]
        flat, counts = P.words(pa.array([" ".join(t) for t in texts]))
        h = P.word_hashes(flat)
        at = P.chosen(h, counts)
        owner = np.repeat(np.arange(3), counts)[at]
        names = [set(P.rolling(h, P.MIN_WORDS)[at[owner == k]].tolist()) for k in range(3)]
        assert names[0] & names[1] & names[2]
    flat, counts = P.words(pa.array(["one two " * 200, " ".join(plain(39)), " ".join(plain(45))]))
    assert len(P.chosen(P.word_hashes(flat), counts)) == 1  # only the last


def test_passages(spark):
    rng = random.Random(5)
    rows, planted, passages = corpus(rng)
    clean = {k for k, _ in rows} - {k for ks in planted.values() for k in ks}
    odd = [(900, None), (901, ""), (None, rows[0][1]), (902, "one. " * 2000), (903, rows[3][1]), (903, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string").selectExpr("*", "'x' AS body", "length(text) AS n_chars").repartition(5)
    got = P.repeated_passages(df).collect()
    text = dict(rows) | {903: rows[3][1]}
    assert not {r.doc_id for r in got} & (clean | {901, 902})
    assert {(r.doc_id, r.component_id, r.n_words) for r in got if r.removed and r.doc_id in (None, 903) and r.first == 0} >= {(None, 0, len(rows[0][1].split())), (903, 3, len(rows[3][1].split()))}
    for p, ks in planted.items():
        kept = [r for r in got if r.doc_id in ks and not r.removed]
        assert {r.doc_id for r in got if r.removed} >= set(sorted(ks)[1:]), p
        assert kept
    for r in got:
        if r.doc_id is not None:
            assert len(text[r.doc_id][r.first : r.last].split()) == r.n_words
    cut = {r.doc_id: r for r in P.without_repeats(df).collect() if r.doc_id is not None}
    assert all(cut[k].text == text[k] for k in clean) and 900 in cut and 901 in cut and cut[902].text == "one. " * 2000
    for p, ks in planted.items():
        said = sum(1 for k in ks if k in cut and " ".join(passages[p].split()[8:44]) in " ".join(cut[k].text.split()))
        assert said <= 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.values())
    assert P.without_repeats(df.limit(0)).count() == 0 and P.without_repeats(df).columns == df.columns


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.repeated_passages(docs)
    assert got.count() == got.select("doc_id", "first").distinct().count()


def found_in(spark, rows):
    """The documents with a removed passage, and those with any."""
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id for r in got if r.removed}, {r.doc_id for r in got}


def test_near_copies_without_a_run_of_shared_sentences(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, 150)) for k in range(20)]
    for k, lengths in enumerate(((30, 28), (18, 18, 18))):
        passage = " ".join(sentence(rng, n) for n in lengths)
        words = passage.split()
        words[1] = "another"
        rows += [(100 + k, "\n".join((prose(rng, 60), passage, prose(rng, 60)))), (200 + k, "\n".join((prose(rng, 60), " ".join(words), prose(rng, 60))))]
    assert found_in(spark, rows) == ({200, 201}, {100, 101, 200, 201})


def test_passages_of_an_odd_cut(spark):
    rng = random.Random(8)
    plain = lambda n: " ".join("w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage, three = plain(51), " ".join(sentence(rng, 17) for _ in range(3))
    rows = [(1, f"{plain(70)} {passage} {plain(70)}"), (2, f"{plain(33)} {passage} {plain(90)}"), (3, f"{plain(50)} {three} {plain(50)}"), (4, f"{plain(44)} {three} {plain(61)}")]
    got = {r.doc_id: r for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: (dict(rows)[k][r.first : r.last], r.n_words, r.component_id, r.removed) for k, r in got.items()} == {1: (passage, 51, 1, False), 2: (passage, 51, 1, True), 3: (three, 51, 3, False), 4: (three, 51, 3, True)}


def test_passages_whose_parts_are_elsewhere(spark):
    rng = random.Random(9)
    part, stock = [sentence(rng, 20) for _ in range(2)], sentence(rng, 15)
    x, y = (" ".join(sentence(rng, 15) for _ in range(4)) for _ in range(2))
    rows = [(k, f"{prose(rng, 30)} {part[0]} {stock} {part[1]} {prose(rng, 30)}") for k in range(3)]
    rows += [(100 + k, f"{prose(rng, 50)} {stock} {prose(rng, 50)}") for k in range(40)]
    rows += [(200 + k, f"{prose(rng, 50)} {p} {prose(rng, 50)}") for k, p in enumerate((f"{x} {y}", x, y))]
    assert found_in(spark, rows) == ({1, 2, 201, 202}, {0, 1, 2, 200, 201, 202})


def test_passages_of_short_lines(spark):
    rng = random.Random(10)
    menu = "\n".join(sentence(rng, 3 + k % 2) for k in range(20))
    rows = [(k, "\n".join((prose(rng, 60), menu, prose(rng, 60)))) for k in range(3)] + [(9, prose(rng, 200))]
    assert found_in(spark, rows) == ({1, 2}, {0, 1, 2})


def test_near_copies_with_every_sentence_edited(spark):
    """No 40 words in a row are equal, so that only bands of natural paragraphs can find them. Where an edit makes or moves the
    cut of a long line, its parts are too unlike."""
    rng = random.Random(11)
    rows = [(k, prose(rng, 150)) for k in range(20)]
    for k in range(15):
        sentences = [sentence(rng, 40) for _ in range(3)]
        changed = []
        for said in sentences:
            words = said.split()
            words[20] = f"other{k}"
            changed.append(" ".join(words))
        rows += [(100 + k, "\n".join((prose(rng, 60), " ".join(sentences), prose(rng, 60)))), (200 + k, "\n".join((prose(rng, 60), " ".join(changed), prose(rng, 60))))]
    removed, found = found_in(spark, rows)
    assert removed <= set(range(200, 215)) and found == removed | {k - 100 for k in removed} and len(removed) >= 13


def test_against_brute_force(spark):
    """Every stretch of 51 words that two documents share is in what is reported; and what is reported holds 40 words that two
    documents share. Passages stand anywhere, inside lines and across them; a common line and junk make no passages."""
    rng = random.Random(12)
    word = lambda: "w" + "".join(rng.choices("abcdefgh", k=5))
    passages = [[word() for _ in range(n)] for n in (51, 51, 55, 60, 75, 90, 140, 200)]
    common = " ".join(word() for _ in range(13))
    rows = []
    for k in range(160):
        words = [word() for _ in range(rng.randrange(20, 250))]
        for _ in range(rng.randrange(3) if k % 2 else 0):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        for at in range(len(words) - 1, 0, -11):
            words[at] += rng.choice(("", "", ".", "\n", f"\n{common}\n"))
        rows.append((k, " ".join(words)))
    rows += [(500 + k, "tick tock " * (40 + k)) for k in range(5)]
    split = {d: t.split() for d, t in rows}

    def shared(n):
        by = {}
        for d, ws in split.items():
            for i in range(len(ws) - n + 1):
                by.setdefault(tuple(ws[i : i + n]), set()).add(d)
        return {g: ds for g, ds in by.items() if len(ds) > 1}

    found = {}
    for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect():
        found.setdefault(r.doc_id, []).append((r.first, r.last))
    spans = {}
    for d, t in rows:
        at, spans[d] = 0, []
        for w in split[d]:
            at = t.index(w, at)
            spans[d].append((at, at + len(w)))
            at += len(w)
    sure, maybe = shared(51), shared(40)
    missed = total = 0
    for d, ws in split.items():
        for i in range(len(ws) - 50):
            if d < 500 and tuple(ws[i : i + 51]) in sure:
                total += 51
                missed += sum(not any(a <= spans[d][j][0] and spans[d][j][1] <= b for a, b in found.get(d, [])) for j in range(i, i + 51))
    assert total > 1000 and missed <= 0.002 * total, (missed, total)
    assert set(found) <= {d for d, ws in split.items() if d < 500 and any(tuple(ws[i : i + 40]) in maybe for i in range(len(ws) - 39))}
