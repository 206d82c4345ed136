"""The pipeline's stages against brute-force versions of their decisions."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from presssignal.llm import mixing, near_dedup, quality_crf
from presssignal.llm.support import stored, table
from tests.llm.test_near_dedup import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, out = table(spark, SF, "documents"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.schema == stages[0].schema or docs.columns == stages[0].columns


def test_rejected_documents_go(spark, stages):
    scores = quality_crf.classify(stages[0], table(spark, SF, "labels")).collect()
    want = sorted(r.doc_id for r in scores if r.predicted)
    assert sorted(r.doc_id for r in stages[1].select("doc_id").collect()) == want
    assert 0 < len(want) < len(scores)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = sorted(d for d, _, c in brute_components(rows) if d == c)
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_mix_and_packing(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix(stages[2]).collect()}
    words = dict.fromkeys(taken, 0)
    for r in stages[3].collect():
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert words == taken
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in stages[3].collect():
        ids = np.array(plain.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        want += [(r.doc_id, at, zlib.crc32(ids[at : at + 4096].tobytes()), len(ids)) for at in range(0, len(ids), 4096)]
    got = stages[4].collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_representatives_of_odd_rows(documents):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (None, "x y z"), (4, ""), (5, None), (6, "other")]
    kept = near_dedup.representatives(documents(rows).selectExpr("*", "7 AS row", "8 AS fingerprint")).collect()
    assert sorted((repr(r.doc_id), r.text or "") for r in kept) == [("1", "a b c d e"), ("4", ""), ("6", "other"), ("None", "x y z")]
    assert {(r.row, r.fingerprint) for r in kept} == {(7, 8)}
    chain = quality_crf.Chain(np.zeros(quality_crf.FEATURES), 0.0, np.zeros((2, 2)), 0.2)
    assert sorted(r.text or "" for r in quality_crf.accepted(documents(rows), chain).collect() if r.doc_id in (4, 5, 6)) == ["other"]


def test_empty_documents(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
