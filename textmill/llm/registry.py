"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from textmill.llm import bloom_lm, chat_format, decontam, lattice, license_scan, minhash, pii, quality, sentencepiece_codec, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_lattice_dedup": lattice.op2_lattice_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bloom_lm": bloom_lm.op5_bloom_lm,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_minhash_dedup": minhash.op7_minhash_dedup,
    "op8_pii": pii.op8_pii,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_kneser_ney": quality.op10_kneser_ney,
}

ORACLES = {
    "op2_lattice_dedup": lattice.oracle(),
    "op3_license_scan": license_scan.oracle(),
    "op9_chat_format": chat_format.oracle(),
}
