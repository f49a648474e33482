"""The queries of these operators, and the SQL that DuckDB runs for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, exactdedup, langid, packing, simhash, tokenfile, urlfilter, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_warc_writer": warc.op3_warc_writer,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_language_id": langid.op5_language_id,
    "op6_chat_format": chat.op6_chat_format,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_simhash_forest": simhash.op8_simhash_forest,
    "op9_exact_dedup": exactdedup.op9_exact_dedup,
    "op10_token_output": tokenfile.op10_token_output,
}
ORACLE_SQL = {"op6_chat_format": chat.SQL, "op7_url_filter": urlfilter.SQL, "op9_exact_dedup": exactdedup.SQL}
