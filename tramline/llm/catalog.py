"""The queries of this folder and their check SQL."""

from tramline.llm import (
    chat, extraction, imatch, langid, mixing, packing, partenum, pii, quality, ranked_search, relative_lz,
    repair, suffixes,
)

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_imatch": imatch.op2_imatch,
    "op3_html_extraction": extraction.op3_html_extraction,
    "op4_suffix_passages": suffixes.op4_suffix_passages,
    "op5_chat_format": chat.op5_chat_format,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_quality": quality.op7_quality,
    "op8_partenum_join": partenum.op8_partenum_join,
    "op9_language_id": langid.op9_language_id,
    "op10_packing": packing.op10_packing,
    "op11_relative_lz": relative_lz.op11_relative_lz,
    "op12_auction_repair": repair.op12_auction_repair,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

SQL = {
    "op4_suffix_passages": suffixes.SQL,
    "op5_chat_format": chat.SQL,
    "op6_mix_sources": mixing.SQL,
    "op8_partenum_join": partenum.SQL,
    "op11_relative_lz": relative_lz.SQL,
    "op12_auction_repair": repair.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
