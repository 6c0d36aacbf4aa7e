"""The pipeline against plain versions of its stages, on a part of the given documents."""

import os
import shutil

import pytest

import corpus_pipeline
from plumbline.durable import shared_dir
from plumbline.llm import toxicity
from plumbline.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.test_packing import expected

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given tables, with odd rows added to the documents."""
    target = str(tmp_path_factory.mktemp("tables"))
    for name in ("labels", "benchmark"):
        shutil.copyfile(f"{FOLDER}/{name}.parquet", f"{target}/{name}.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "Short.", "en", "s", 6)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{target}/documents.parquet")
    return target


def rows(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_and_run(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = rows(docs)
    stages = dict(corpus_pipeline.STAGES)
    base = f"{shared_dir(spark)}/pipeline-test"

    def step(name, frame):
        out = stages[name](spark, frame, folder)
        out.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    scores = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    docs = step("toxicity", docs)
    assert docs.columns == columns
    texts = {d: t for d, t in texts.items() if d not in toxic}
    assert rows(docs) == texts

    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    groups = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    docs = step("simhash_near_dedup", docs)
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    assert docs.columns == columns and rows(docs) == texts

    cut = brute.removed(list(texts.items()))
    docs = step("suffix_array_dedup", docs)
    texts = {r[0]: None if texts[r[0]] is None else r[5].decode(errors="ignore") for r in cut}
    assert docs.columns == columns and rows(docs) == texts

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = brute.contamination(list(texts.items()), items)
    docs = step("decontamination", docs)
    texts = {d: t for d, t in texts.items() if not found[d][1]}
    assert docs.columns == columns and rows(docs) == texts

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    lengths = {d: len(expected(tokenizer, t)) for d, t in texts.items()}
    for packed in (step("packing", docs).collect(), corpus_pipeline.run(spark, folder).collect()):
        sums = {}
        for r in packed:
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        assert sums == lengths
        assert len({r.sequence_id for r in packed}) <= -(-sum(lengths.values()) // 1024) + 2
