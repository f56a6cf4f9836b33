"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from cartula.llm import ann, chat, codes, decontam, hilbert, idcoder, langid, linedup, mixing, resample, simhash, substring, toxicity
from cartula.llm.common import small_batches, table


def op1_toxicity_grammar(spark, sf_dir):
    """Score of each document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_mixing_ids(spark, sf_dir, tokenizer=None):
    """Place, number and checksum of each document's token ids, from the files; tokenizer is a path."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return idcoder.digest(table(spark, sf_dir, "documents"), str(tokenizer))


def op3_hilbert_sharding(spark, sf_dir):
    """All documents in shards 0 to 7 by the law ``bytes``."""
    return hilbert.shard(table(spark, sf_dir, "documents"), 8)


def op5_level_wise_substring_dedup(spark, sf_dir):
    """Words that each document keeps."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op6_block_matrix_neighbours(spark, sf_dir):
    """The five nearest of each query vector."""
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op7_reply_tree_chat(spark, sf_dir):
    """Digest of each formatted conversation."""
    return chat.digest(table(spark, sf_dir, "conversations"))


def op8_deletion_neighbourhood_lines(spark, sf_dir):
    """Lines that each document loses."""
    return linedup.digest(table(spark, sf_dir, "documents"))


def op9_weighted_fair_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("n_copies")


def op4_bit_sliced_simhash(spark, sf_dir):
    """Fingerprint and component of each document."""
    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_suffix_automaton_decontamination(spark, sf_dir):
    """Words of each document that test items hit."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark, sf_dir):
    """Weight of each document, and the rank of those drawn towards the benchmark's texts."""
    return resample.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_annular_vector_codes(spark, sf_dir):
    """Code and error of each vector."""
    return codes.digest(table(spark, sf_dir, "embeddings"))


def op13_string_kernel_languages(spark, sf_dir):
    """Language of each document."""
    return langid.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_grammar, op2_context_mixing_ids, op3_hilbert_sharding, op4_bit_sliced_simhash, op5_level_wise_substring_dedup, op6_block_matrix_neighbours, op7_reply_tree_chat,
        op8_deletion_neighbourhood_lines, op9_weighted_fair_mixing, op10_suffix_automaton_decontamination, op11_importance_resampling, op12_annular_vector_codes, op13_string_kernel_languages,
    )
}
ORACLES = {
    "op11_importance_resampling": resample.SQL, "op12_annular_vector_codes": codes.SQL,
    "op5_level_wise_substring_dedup": substring.SQL, "op7_reply_tree_chat": chat.SQL, "op10_suffix_automaton_decontamination": decontam.SQL, "op9_weighted_fair_mixing": mixing.SQL,
}
