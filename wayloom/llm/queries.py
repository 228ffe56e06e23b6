"""The production queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, ann, chat_format, decontaminate, language_id, mixing, periodic_runs, private_data, secret_scan, simhash, token_counts, toxicity, url_filter

QUERIES = {
    "op4_nearest": ann.op4_nearest,
    "op1_token_counts": token_counts.op1_token_counts,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_mixing": mixing.op7_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_url_filter": url_filter.op9_url_filter,
    "op11_alignment": alignment.op11_alignment,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_private_data": private_data.op13_private_data,
}
SQL = {
    "op4_nearest": ann.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
