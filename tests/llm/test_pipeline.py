from __future__ import annotations

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from shelf.llm import bpe, quality, queries, toxicity

from .conftest import ODD, prose
from .test_exact_and_lines import line_truth
from .test_sketches import component_truth
from .test_tokens import check_pieces


def test_stages_match_brute_force_on_what_each_is_given(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "lines", "near", "packing"]
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    good = stages["quality"](spark, docs, sf_dir)
    score = quality.scorer(quality.train(docs, labels))
    assert good.columns == columns and rows(good) == [r for r in rows(docs) if score(r[1].encode()) >= 0.3]
    clean = stages["toxicity"](spark, good, sf_dir)
    judge = toxicity.Scorer(toxicity.train(good, labels))
    assert clean.columns == columns and rows(clean) == [r for r in rows(good) if judge(r[1])[0] < 0.5]
    lines = stages["lines"](spark, clean, sf_dir)
    before, after = rows(clean), rows(lines)
    assert lines.columns == columns and [d for d, _ in before] == [d for d, _ in after]
    import hashlib

    assert [hashlib.sha256(t.encode()).hexdigest() for _, t in after] == [x[3] for x in line_truth(before)]
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = stages["near"](spark, lines, sf_dir)
    truth = component_truth(after)
    assert near.columns == columns and rows(near) == [r for r in after if truth[r[0]] == r[0]]
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    pieces = stages["packing"](spark, near, sf_dir).collect()
    assert check_pieces(rows(near), pieces, lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 2048) == 0

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert np.sum([p.length for p in whole]) == np.sum([p.length for p in pieces])


def test_the_pipeline_of_odd_rows_and_of_none(clash, spark, tmp_path):
    odd = ODD + [(20, prose(4, 300)), (21, prose(4, 300) + " tail"), (24, prose(4, 300)), (22, "a line that repeats\n" + prose(5, 80)), (23, "a line that repeats\n" + prose(6, 80))]
    labels = spark.createDataFrame([(None, 1, 1), (4, None, 0), (5, 1, None), (777, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", clash(odd)), ("none", clash(odd).limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # Nothing is rejected without labels that tell. 7 and 21 are near 4 and 20; 4 is there twice, and both rows stay; 24
    # has lost its only line to 20 before, and empty texts are near nothing.
    want = Counter(d for d, _ in odd if d not in (7, 21))
    assert Counter(p.doc_id for p in got if p.start == 0) == want
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert {p.doc_tokens for p in got if p.doc_id in (22, 23)} == {size("a line that repeats\n" + prose(5, 80)), size(prose(6, 80))}
    assert [p.doc_tokens for p in got if p.doc_id == 24] == [1]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_all_twelve_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 13))
