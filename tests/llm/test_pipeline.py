import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

from roadloom.llm import mixing

from .conftest import SF
from .test_jaccard import brute

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as C  # noqa: E402


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_against_brute_force(spark, documents):
    docs = documents.drop("ids")
    columns = docs.columns
    one = C.language_id(spark, docs, SF).cache()
    assert one.columns == columns
    gone = rows(docs) - rows(one)
    assert all(not any(c.isalpha() for c in r[1] or "") for r in gone) and sum(gone.values()) >= 4

    two = C.jaccard_join(spark, one, SF).cache()
    found = Counter(c for _, _, c in brute([(r.doc_id, r.text) for r in one.collect()]))
    assert two.columns == columns and not rows(two) - rows(one)
    assert sorted(str(r.doc_id) for r in two.collect()) == sorted(found)

    three = C.substring_dedup(spark, two, SF).cache()
    before = {r.doc_id: r.text for r in two.collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} <= set(before)
    cut = [r for r in three.collect() if r.text != before[r.doc_id]]
    assert all(r.n_chars == len(r.text) < len(before[r.doc_id]) for r in cut)

    four = C.mix_sources(spark, three, SF).cache()
    want = Counter({d: n for d, n in ((r.doc_id, r.taken // r.size) for r in mixing.taken(three).collect() if r.size) if n})
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == want

    five = C.encode(spark, four, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.ids == tok.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in five)
    assert Counter(r.doc_id for r in five) == want


def test_odd_rows_through_all_stages(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "same words here and there again", "en", None, 1), (None, "same words here and there again", "en", None, 1), (2, "", "xx", "s", 0), (2, "same words here and there again", "en", "s", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (odd, odd.limit(0)):
        for name, stage in C.STAGES[:-1]:
            after = stage(spark, docs, SF).cache()
            assert after.columns == odd.columns
            if "mixing" not in name:  # each stage but that only leaves out, or cuts
                assert {(r.doc_id, r.lang, r.source) for r in after.collect()} <= {(r.doc_id, r.lang, r.source) for r in docs.collect()}
            docs = after
        last = C.STAGES[-1][1](spark, docs, SF).collect()
        assert len(last) == docs.count() and all(r.n_tokens == len(r.ids) > 0 for r in last)
    assert not last  # an empty table stays empty


def test_near_copies_go(spark):
    assert C.jaccard_join(spark, spark.createDataFrame([(2, "one two three four five six", "en", "a", 1), (1, "One two  three four five six", "en", "a", 1), (3, "", "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), SF).select("doc_id").orderBy("doc_id").collect() == [(1,), (3,)]


def test_run(spark):
    out = C.run(spark, SF)
    assert out.count() > 100 and "ids" in out.columns
