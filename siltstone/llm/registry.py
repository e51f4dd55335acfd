"""The queries of this subpackage and their SQL, for the entry module."""

from siltstone.llm import caps, language_model, mixing, neardup, packing, pii, repetition, sharding, substrings, tokenfiles

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_sharding": sharding.op2_sharding,
    "op3_tokenfiles": tokenfiles.op3_tokenfiles,
    "op4_caps": caps.op4_caps,
    "op5_substrings": substrings.op5_substrings,
    "op6_language_model": language_model.op6_language_model,
    "op7_neardup": neardup.op7_neardup,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_repetition": repetition.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op4_caps": caps.ORACLE,
    "op5_substrings": substrings.ORACLE,
    "op7_neardup": neardup.ORACLE,
}
