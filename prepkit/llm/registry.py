"""The subpackage's queries: opN_<name> applies operator N with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepkit.llm import jaccard, linededup, secretscan, topk, trie, warc
from prepkit.llm.bpe import vocabulary_path
from prepkit.llm.common import table, tuned
from prepkit.llm.lattice import sample_segmentations
from prepkit.llm.packing import best_fit_pack
from prepkit.llm.pitmanyor import pitman_yor_scores
from prepkit.llm.quality import quality_rules
from prepkit.llm.tokencount import token_counts
from prepkit.llm.toxicity import toxicity
from prepkit.llm.whitening import whiten


def op1_line_dedup(spark, sf_dir):
    """Digest of the operator's rows: counts and the md5 of the text that is left (empty for null)."""
    out = linededup.drop_repeated_chunks(table(tuned(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "lines_removed", "chunks_removed", "chunk_lines",
                      F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op2_warc(spark, sf_dir):
    out = warc.warc_round_trip(table(tuned(spark), sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sentencepiece_sampling(spark, sf_dir):
    """Digest of the operator's rows: the number of pieces and a hash of the ids."""
    out = sample_segmentations(table(tuned(spark), sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))
    return out.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")


def op4_best_fit_packing(spark, sf_dir):
    return best_fit_pack(table(tuned(spark), sf_dir, "documents"), vocabulary_path())


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(tuned(spark), sf_dir, "documents"))


def op6_secret_scans(spark, sf_dir):
    return secretscan.secret_scan(table(tuned(spark), sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    tuned(spark)
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op8_exact_topk(spark, sf_dir):
    return topk.top_inner_products(table(tuned(spark), sf_dir, "embeddings"))


def op9_token_counts(spark, sf_dir):
    return token_counts(table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op10_quality_rules(spark, sf_dir):
    tuned(spark)
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op11_embedding_whitening(spark, sf_dir):
    return whiten(table(tuned(spark), sf_dir, "embeddings"))


def op12_lm_scoring(spark, sf_dir):
    return pitman_yor_scores(table(tuned(spark), sf_dir, "documents"))


def op13_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(tuned(spark), sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (
    op1_line_dedup, op2_warc, op3_sentencepiece_sampling, op4_best_fit_packing, op5_ngram_jaccard, op6_secret_scans, op7_toxicity, op8_exact_topk, op9_token_counts, op10_quality_rules,
    op11_embedding_whitening, op12_lm_scoring, op13_conversation_trie)}
ORACLES = {"op1_line_dedup": linededup.SQL, "op2_warc": warc.SQL, "op5_ngram_jaccard": jaccard.SQL, "op6_secret_scans": secretscan.SQL, "op8_exact_topk": topk.SQL, "op13_conversation_trie": trie.SQL}
