"""The pipeline's stages, each on what its predecessor kept, against what they should do."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import prose
from .test_operators import shingles

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    item = prose(500, 30)
    texts = {k: f"{prose(k, 80)}\n{prose(1000 + k, 40)}" for k in range(40)}
    texts[40] = texts[3]
    words = texts[5].replace("\n", " ").split()
    texts[41] = " ".join(words[:60] + ["changed"] + words[61:])
    texts[42] = f"{prose(300, 20)} {item} {prose(301, 20)}"
    texts[43] = "*** 12345 !!! ###"
    texts[44] = None
    texts[45] = f"{prose(310, 50)}\n{texts[7].split(chr(10))[1]}\n\nend of it"
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages_one_by_one(spark, sf_dir):
    path, texts = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == NAMES
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(kept["language"]) == {43, 44}
    assert set(kept["language"]) - set(kept["lines"]) == {40}
    assert kept["lines"][45].text == f"{prose(310, 50)}\n\nend of it" and all(r.n_chars == len(r.text) for r in kept["lines"].values())
    assert all(kept["lines"][i].text == texts[i] for i in range(40))
    before, after = kept["lines"], kept["near_duplicates"]
    assert set(before) - set(after) == {41} and len(shingles(before[5].text) & shingles(before[41].text)) > 100
    assert set(after) - set(kept["decontamination"]) == {42}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    for r in packed:
        ids = tokenizer.encode(kept["decontamination"][r.doc_id].text, add_special_tokens=False).ids + [1]
        assert (r.start, r.length, r.ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    run = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, packed))


def test_stages_of_an_empty_table(spark, sf_dir):
    path, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
