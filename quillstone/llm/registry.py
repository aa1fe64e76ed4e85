"""The training-data queries and, where SQL can express one, its SQL."""

from quillstone.llm import queries as q
from quillstone.llm import pareto, url_tree

QUERIES = {
    "op1_pareto_mix": q.op1_pareto_mix,
    "op2_token_file": q.op2_token_file,
    "op3_language_mixture": q.op3_language_mixture,
    "op4_quality": q.op4_quality,
    "op5_boosted_pii": q.op5_boosted_pii,
    "op6_piece_codec": q.op6_piece_codec,
    "op7_paragraph_sketch": q.op7_paragraph_sketch,
    "op8_url_tree": q.op8_url_tree,
    "op9_simhash": q.op9_simhash,
    "op10_telephony_audio": q.op10_telephony_audio,
}

ORACLES: dict[str, str] = {
    "op1_pareto_mix": pareto.oracle(),
    "op8_url_tree": url_tree.oracle(),
}
