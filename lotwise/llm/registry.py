"""Queries of the corpus operators and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from lotwise.llm import alignment, bpe, decontaminate, embeddings, jaccard, language, lines, pii, quality, ranking, records, toxicity, wrappers

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html_extraction": wrappers.op2_html_extraction,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_embedding_dedup": embeddings.op4_embedding_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_pii": pii.op6_pii,
    "op7_language_id": language.op7_language_id,
    "op8_quality": quality.op8_quality,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_token_records": records.op10_token_records,
    "op11_ranked_search": ranking.op11_ranked_search,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.oracle(),
    "op6_pii": pii.oracle(),
    "op11_ranked_search": ranking.oracle(),
    "op12_line_dedup": lines.oracle(),
}
