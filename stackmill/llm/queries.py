"""The registered queries of this subpackage and the SQL of those that SQL can say."""

from __future__ import annotations

from stackmill.llm import compression, dartminhash, decontamination, fertility, langid, maxent, mixing, periodic, pii, separators, suffix_groups, toxicity, whitening

QUERIES = {
    "op1_fertility": fertility.op1,
    "op2_suffix_groups": suffix_groups.op2,
    "op3_separators": separators.op3,
    "op4_toxicity": toxicity.op4,
    "op5_dartminhash": dartminhash.op5,
    "op6_mixing": mixing.op6,
    "op7_langid": langid.op7,
    "op8_pii": pii.op8,
    "op9_maxent": maxent.op9,
    "op10_decontamination": decontamination.op10,
    "op11_whitening": whitening.op11,
    "op12_periodic": periodic.op12,
    "op13_compression": compression.op13,
}

SQL = {
    "op6_mixing": mixing.SQL,
    "op10_decontamination": decontamination.SQL,
}
