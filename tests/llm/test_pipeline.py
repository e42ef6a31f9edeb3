"""Each stage on the smallest tables against plain Python over the rows that the stage before it kept."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from seglume.llm import mixing, quality, tokenfile
from seglume.llm.registry import token_params
from seglume.session import table
from tests.llm.test_simhash import similar_groups

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, D, "documents"), []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, D)
        out.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_names_and_columns(spark, kept):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    columns = set(table(spark, D, "documents").columns)
    assert all(set(r) == columns for rows in kept[:4] for r in rows)


def test_quality_stage_keeps_what_the_classifier_predicts(spark, kept):
    docs = table(spark, D, "documents")
    assert ids(kept[0]) == sorted(r.doc_id for r in quality.classify(docs, table(spark, D, "labels")).where("predicted = 1").collect())
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len(set(good) & set(ids(kept[0]))) >= 0.97 * len(good)


def test_dedup_stage_keeps_the_least_id_of_each_group(kept):
    rows = kept[0]
    roots = similar_groups([r["text"] for r in rows])
    assert ids(kept[1]) == sorted({min(r["doc_id"] for r, x in zip(rows, roots) if x == root) for root in set(roots)})


def test_leak_stage_drops_documents_with_a_whole_item(spark, kept):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    items = [f" {' '.join(words(r.text))} " for r in table(spark, D, "benchmark").collect()]
    whole = {r["doc_id"] for r in kept[1] if any(i in f" {' '.join(words(r['text']))} " for i in items)}
    dropped = set(ids(kept[1])) - set(ids(kept[2]))
    assert whole <= dropped and len(dropped) <= len(whole) + 2


def test_mix_stage_takes_what_the_operator_says(spark, kept):
    docs = spark.createDataFrame(kept[2])
    took = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = Counter()
    for r in kept[3]:
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert {k: v for k, v in took.items() if v} == got
    text = {r["doc_id"]: r for r in kept[2]}
    for r in kept[3]:
        whole = text[r["doc_id"]]
        assert r["text"] == whole["text"] or r["text"].split(" ") == [w.decode() for w in whole["text"].encode().split()][: len(r["text"].split(" "))]
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (whole["lang"], whole["source"])


def test_token_stage_reads_back_what_the_tokenizer_says(kept):
    enc, at, want = tokenfile.encoder(token_params()).tokenizer, 0, []
    for r in sorted(kept[3], key=lambda r: (r["doc_id"], r["text"].encode())):
        ids_ = [*enc.encode(r["text"], add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids_), zlib.crc32(np.array(ids_, "<u4").tobytes())))
        at += len(ids_)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in kept[4]), key=lambda r: r[1]) == want


def test_run_equals_the_stages(spark, kept):
    got = sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, D).collect())
    assert got == sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in kept[4])


def test_run_on_no_documents(spark, tmp_path):
    """An empty table goes through all stages, whatever labels and benchmark hold."""
    for name in ("documents", "labels", "benchmark"):
        rows = table(spark, D, name)
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() == 0 and "ids_crc32" in got.columns
