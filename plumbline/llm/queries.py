"""Registered queries of this package: name -> function of (spark, folder), and their SQL."""

from __future__ import annotations

import uuid

from plumbline.durable import shared_dir
from plumbline.llm import decontaminate, embeddings, html_text, mixing, packing, phrases, repair, simhash, suffix_dedup, suffix_tree, toxicity, url_filter, warc
from plumbline.llm.common import table
from plumbline.llm.oracles import ORACLES  # noqa: F401

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op2_warc(spark, folder):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, folder, "pages"), path)
    return warc.read_summary(spark, path)


def op3_decontamination(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_suffix_tree(spark, folder):
    return suffix_tree.score(table(spark, folder, "documents"))


def op5_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_html_extraction(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op7_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op8_toxicity(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_embeddings(spark, folder):
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op10_url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), rules)


def op11_conversation_repair(spark, folder):
    return repair.damage_report(table(spark, folder, "conversations"))


def op12_collocations(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


def op13_mixing(spark, folder):
    return mixing.taken(table(spark, folder, "documents"))


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_simhash": op5_simhash,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_embeddings": op9_embeddings,
    "op10_url_filters": op10_url_filters,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}
