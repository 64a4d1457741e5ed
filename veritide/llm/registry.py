"""Queries of this subpackage and what SQL can say about them."""

from __future__ import annotations

import corpus_pipeline

from . import embeddings, filter_audit, lines, packing, pages, pieces, pii, quality_model, quality_rules, secrets, simhash, sql, suffix_dedup, vector_codes


def queries() -> dict:
    return {
        "op1_quality_nbsvm": quality_model.op1_quality_nbsvm,
        "op2_embedding_dedup": embeddings.op2_embedding_dedup,
        "op3_secrets": secrets.op3_secrets,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_pack": packing.op7_pack,
        "op8_simhash": simhash.op8_simhash,
        "op9_pii": pii.op9_pii,
        "op10_main_text": pages.op10_main_text,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
