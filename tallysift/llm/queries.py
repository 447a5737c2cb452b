"""Registered queries of the operators, with SQL where SQL can say the same."""

import public_tokenizers
from pyspark.sql import functions as F

from tallysift.llm import (backoff_lm, block_labeller, decontaminate, lexical_search, line_dedup, packing, perspectives,
                            prefix_trie, quality_classifier, quality_rules, simhash, substrings, warc)
from tallysift.llm.common import table
from tallysift.llm.oracles import ORACLES  # noqa: F401

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                       keep=["doc_id", "lang"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_decontaminate(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", *(f"found.{c}" for c in (
        "n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


@query
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


@query
def op5_substrings(spark, sf_dir):
    cut = substrings.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"], rest_as=None)
    return cut.select("doc_id", *(f"cut.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


@query
def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path, kind = warc.archive(pages), pages.schema["page_id"].dataType
    full = warc.read(spark, path).where("record_type = 'response'").select(
        "headers", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"))
    again = warc.read(spark, path, payload=False).where("record_type = 'revisit'").select(
        "headers", "record_type", F.col("payload_length").alias("payload_bytes"), "payload_digest")
    return full.union(again).select(
        F.col("headers")["X-Page-Id"].cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("headers")["X-Refers-To-Page"].cast(kind).alias("refers_to"))


@query
def op10_perspectives(spark, sf_dir):
    views = perspectives.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m[0].cast("string"), m[1].cast("string"))), ",")
    return views.select("conv_id", "participant", "chunk", "part", "n_turns", "n_own", "rendered", mask.alias("mask"))


@query
def op4_main_text(spark, sf_dir):
    found = block_labeller.extract(table(spark, sf_dir, "pages"), name="text", keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_quality_classifier(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), quality_classifier.held_out()
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~out)
    scored = quality_classifier.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_backoff_lm(spark, sf_dir):
    out = backoff_lm.held_out()
    scored = backoff_lm.score(table(spark, sf_dir, "documents"), ~out, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), *(f"lm.{c}" for c in (
        "n_tokens", "n_known", "train_tokens", "base_score", "score")))


@query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_prefix_trie(spark, sf_dir):
    turns, members = prefix_trie.shared_beginnings(prefix_trie.conversation_turns(table(spark, sf_dir, "conversations")))
    nodes, _ = prefix_trie.trie(turns, members)
    return nodes.drop("node_1", "node_2")


@query
def op13_line_dedup(spark, sf_dir):
    lines = line_dedup.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"], rest=False)
    return lines.select("doc_id", *(f"lines.{c}" for c in ("n_lines", "n_dropped", "kept_sha256")))
