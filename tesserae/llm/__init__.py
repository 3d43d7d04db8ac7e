"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from . import bpe, chat, embeddings, lm, mixing, quality, sharding, simhash, token_files, urls

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_token_files": token_files.op3_token_files,
    "op4_sharding": sharding.op4_sharding,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filter": urls.op7_url_filter,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_quality": quality.op9_quality,
    "op10_chat_format": chat.op10_chat_format,
}

SQL = {"op7_url_filter": urls.OP7_SQL, "op8_embeddings": embeddings.OP8_SQL, "op9_quality": quality.OP9_SQL, "op10_chat_format": chat.OP10_SQL}
