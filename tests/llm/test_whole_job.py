"""Cases that were once cut: what an operator must find on the whole input."""

from __future__ import annotations

import os
from collections import defaultdict

import corpus_pipeline
from tidemill.llm import common, odd_minhash, paragraph_dedup

from .conftest import prose
from .test_operators import shingles, split


def test_short_lines_repeat(make):
    texts = {k: f"{prose(k, 50)}\n{prose(100 + k, 12)}\nline {k}" for k in range(1, 9)}
    texts[2] += "\nOf to on oust."
    texts[5] = "of TO  on oust.\n" + texts[5]
    seven = prose(900, 18).split()
    texts[3] += "\n" + " ".join(seven)
    texts[6] += "\n\n" + " ".join([*seven, "more"])
    texts[7] += "\n" + " ".join([*seven[:9], "other", *seven[10:]])  # 9 shingles of 19: no link
    texts[8] += "\n \t\n \t\ntwice here\ntwice here"
    got = {(r.doc_id, r.at, r.kept) for r in paragraph_dedup.repeated_paragraphs(make(texts)).collect()}
    assert got == {(2, 3, True), (5, 0, False), (3, 3, True), (6, 4, False), (8, 5, True), (8, 6, False)}


def test_line_signatures_of_equal_and_similar_sets():
    sign = paragraph_dedup._line_signer(paragraph_dedup.PARAGRAPHS)
    lines = [prose(k % 60, n) for k in range(120) for n in (1, 4, 7, 8, 30)] + ["", " "] + [prose(1, 9000), prose(1, 9000).upper()]
    n, k1, k2, bands, odd = sign([x.encode() for x in lines])
    assert [len(shingles(x)) for x in lines] == list(n)
    sets, keys = defaultdict(set), defaultdict(set)
    for i, x in enumerate(lines):
        if split(x):
            sets[frozenset(shingles(x))].add(i)
            keys[k1[i], k2[i]].add(i)
        assert (bands[i] is not None) == (odd[i] is not None) == (n[i] >= 4)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, keys.values()))
    alone = [sign([x.encode()]) for x in lines]
    for i, x in enumerate(alone):
        assert (x[1][0], x[2][0], x[4][0]) == (k1[i], k2[i], odd[i]) and (bands[i] is None or list(x[3][0]) == list(bands[i]))


def test_signatures_are_on_disk_once_and_only_until_buckets_are_known(make, spark, monkeypatch):
    texts = {k: prose(k, 60) for k in range(40)}
    texts |= {50: prose(3, 60) + " more", 51: prose(4, 60), 52: "short", 53: "SHORT", 54: "lone", 55: None}
    begin, signed, stage_table = len(common._staged), [], common.stage_table

    def tables():
        return [spark.read.parquet(p) for p in common._staged[begin:] if os.path.exists(p.removeprefix("file://"))]

    def watched(df, name):
        out = stage_table(df, name)
        signed.append(sum("bands" in t.columns for t in tables()))
        return out

    monkeypatch.setattr(odd_minhash, "stage_table", watched)
    got = odd_minhash.near_duplicates(make(texts)).collect()
    assert max(signed) == 1 and not any("bands" in t.columns for t in tables())
    # classes that meet no other are in no table that is joined
    assert [t.count() for t in tables() if "copies" in t.columns] == [4]
    assert {(r.doc_id, r.component_id) for r in got if r.grouped} == {(3, 3), (50, 3), (4, 4), (51, 4), (52, 52), (53, 52)}
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(shingles(t or "")) for k, t in texts.items()}


def test_pipeline_drops_near_copies_from_a_similarity_of_80(make, spark):
    texts = {k: prose(k, 90) for k in range(5)}
    for first, n, changed in ((10, 100, (30, 70)), (20, 89, (30, 60))):
        words = prose(first, n).split()
        texts[first] = " ".join(words)
        texts[first + 1] = " ".join("changed" if i in changed else w for i, w in enumerate(words))
    likeness = [len(a & b) / len(a | b) for a, b in ((shingles(texts[i]), shingles(texts[i + 1])) for i in (10, 20))]
    assert 0.8 < likeness[0] < 0.82 and 0.78 < likeness[1] < 0.8
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(texts), "").collect()} == set(texts) - {11}
