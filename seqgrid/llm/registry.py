"""Queries of the training-data operators, and SQL with the same results where SQL can say it."""

import corpus_pipeline
from seqgrid.llm import alignment, chat, decontaminate, fingerprints, licenses, manifest, mixing, neardup, passages, pitman_yor, quality, substrings, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_warc": warc.op2_warc,
        "op3_licenses": licenses.op3_licenses,
        "op4_pitman_yor": pitman_yor.op4_pitman_yor,
        "op5_mixing": mixing.op5_mixing,
        "op6_chat": chat.op6_chat,
        "op7_neardup": neardup.op7_neardup,
        "op8_passages": passages.op8_passages,
        "op9_suffix": substrings.op9_suffix,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_alignment": alignment.op11_alignment,
        "op12_fingerprints": fingerprints.op12_fingerprints,
        "op13_manifest": manifest.op13_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_quality": quality.SQL,
        "op2_warc": warc.SQL,
        "op5_mixing": mixing.SQL,
        "op6_chat": chat.SQL,
        "op7_neardup": neardup.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op13_manifest": manifest.SQL,
    }
