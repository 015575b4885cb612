"""Queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, language, licenses, mixing, packing, phrases, sharding, shingles, sql, substrings, tokens, tries, vectors, warc
from .store import tidy


def queries() -> dict:
    runs = {
        "op1_hilbert_shards": sharding.op1_hilbert_shards,
        "op2_grouped_prefix_join": shingles.op2_grouped_prefix_join,
        "op3_rotation_codes": vectors.op3_rotation_codes,
        "op4_wu_manber": decontaminate.op4_wu_manber,
        "op5_kneser_ney": language.op5_kneser_ney,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_rabin_karp": substrings.op7_rabin_karp,
        "op8_license_rules": licenses.op8_license_rules,
        "op9_viterbi_counts": tokens.op9_viterbi_counts,
        "op10_warc_round_trip": warc.op10_warc_round_trip,
        "op11_prefix_trie": tries.op11_prefix_trie,
        "op12_swap_packing": packing.op12_swap_packing,
        "op13_pair_naming": phrases.op13_pair_naming,
    }
    return {name: tidy(f) for name, f in runs.items()}


def oracle_sql() -> dict[str, str]:
    """Hilbert shards, hash-shuffled queues, trained models, rule tables and tokenizers have no SQL form."""
    return {
        "op2_grouped_prefix_join": sql.SHINGLES,
        "op3_rotation_codes": sql.VECTORS,
        "op4_wu_manber": sql.CONTAMINATION,
        "op7_rabin_karp": sql.REPEATS,
        "op10_warc_round_trip": sql.ARCHIVE,
        "op11_prefix_trie": sql.TRIE,
        "op13_pair_naming": sql.PHRASES,
    }
