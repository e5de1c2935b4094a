"""The pipeline's stages by themselves and in order, against plain Python."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from feedforge.llm.common import shared_folder
from tests.llm.conftest import SMALL, odd_rows
from tests.llm.test_operators import brute_classes, brute_repeats


def test_stages(spark, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == odd.columns
        assert stage(spark, none, SMALL).count() == 0
    packing = corpus_pipeline.STAGES[-1][1]
    assert packing(spark, none, SMALL).count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    whole = packing(spark, odd, SMALL).filter("start = 0")
    assert sorted(r.doc_tokens for r in whole.collect()) == want


def test_odd_rows_in_each_stage(spark, odd):
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert set(ids(stage["quality_rules"](spark, odd, SMALL))) <= {0, 5, 6, 7, 8, 9}
    lined = stage["line_dedup"](spark, odd, SMALL)
    assert ids(lined) == ids(odd) and lined.filter("text is null").count() == 2
    assert ids(stage["near_dedup"](spark, odd, SMALL)) == [0, 0, 1, 2, 3, 5, 9, 10, 11, 12]
    suffixed = {r.doc_id: r.text for r in stage["suffix_dedup"](spark, odd, SMALL).collect() if r.doc_id}
    assert suffixed[1] is None and suffixed[2] == "" and suffixed[3] == "Solo" and suffixed[7] == "" and suffixed[10] == ""


def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        steps.append(docs.toPandas())
        assert name == "packing" or docs.columns == columns
    quality, lined, near, suffixed, packed = steps
    assert set(lined.doc_id) == set(quality.doc_id)
    texts = dict(zip(lined.doc_id, lined.text, strict=True))
    assert set(near.doc_id) == {i for i, c in brute_classes(texts, 80)[1].items() if i == c}
    removed = {i: n for i, (_, n, _, _) in zip(near.doc_id, brute_repeats(near.text.tolist()), strict=True)}
    kept = dict(zip(suffixed.doc_id, suffixed.text, strict=True))
    for i, t in zip(near.doc_id, near.text, strict=True):
        assert len(t.encode()) - removed[i] - len(kept[i].encode()) in range(0, 8)  # parts of a cut character go
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == want
    again = corpus_pipeline.run(spark, SMALL).toPandas()
    assert np.array_equal(np.sort(again.ids_crc32), np.sort(packed.ids_crc32))
    assert not [x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith(("pipeline-", "token-ids-"))]
