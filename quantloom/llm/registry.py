"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quantloom.llm import alignment, bpe, chat, collocations, jaccard, language, media, neighbours, oracles, packing, quality, simhash, substring, urls


def queries() -> dict:
    return {
        "op1_url_filters": urls.op1_url_filters,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_media": media.op4_media,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_language": language.op10_language,
        "op11_collocations": collocations.op11_collocations,
        "op12_alignment": alignment.op12_alignment,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": oracles.SUBSTRING, "op6_ngram_jaccard": oracles.JACCARD, "op9_chat_formatting": chat.ORACLE, "op11_collocations": collocations.ORACLE}
