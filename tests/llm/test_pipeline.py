"""Every stage of the pipeline on what the stage before it kept, against plain Python."""

import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from scrubwell.functions.storage import fresh_path
from scrubwell.llm import mixing, toxicity
from scrubwell.llm.words import split_words

from test_text_queries import near_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as the driver makes them."""
    corpus_pipeline.reach_workers(spark)
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["toxicity", "minhash near-dedup", "decontamination", "mixing", "token files"]
    assert all(after.columns == COLUMNS for name, (_, after) in stages.items() if name != "token files")


def test_toxicity_removes_what_is_scored_toxic(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.predictions(toxicity.score(before, toxicity.train(before, labels)))
    assert texts(after).keys() == {r.doc_id for r in scored.filter("predicted = 0").collect()}
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()} & texts(before).keys()
    assert len(clean - texts(after).keys()) <= 0.01 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = (texts(x) for x in stages["minhash near-dedup"])
    assert after.keys() == set(near_groups(before).values())


def test_leaks_are_removed(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = split_words(r.text.encode())
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))}
    assert all(len(w) == 10 for w in windows)

    def leaks(text):
        words = split_words(text.encode())
        return any(tuple(words[k : k + 10]) in windows for k in range(len(words)))

    assert after.keys() == {i for i, t in before.items() if not leaks(t)} and len(after) < len(before)


def test_the_mix_repeats_documents_as_planned(stages):
    before, after = stages["mixing"]
    planned = {r.doc_id: r.copies for r in mixing.mixing_plan(before).select("row.doc_id", "copies").collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == planned
    assert max(planned.values()) <= 3 and after.join(before, COLUMNS, "left_anti").count() == 0


def test_tokens_of_every_document_in_order(stages):
    from tokenizers import Tokenizer

    before, after = stages["token files"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows = sorted(after.collect(), key=lambda r: r.start)
    wanted = before.orderBy("doc_id", F.xxhash64("text")).collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in wanted]
    for r, doc in zip(rows, wanted, strict=True):
        ids = [*tokenizer.encode(doc.text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_run_equals_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages["token files"][1].collect())
