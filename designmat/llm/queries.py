"""Queries of the training-data operators, and their SQL where SQL can express them."""

from designmat.llm import bpe, decontam, embeddings, licenses, quality, secrets, sharding, simhash, tokencount, warc

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_licenses": licenses.op2_licenses,
    "op3_secrets": secrets.op3_secrets,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality": quality.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc,
    "op10_decontaminate": decontam.op10_decontaminate,
}
ORACLE_SQL = {"op2_licenses": licenses.ORACLE_SQL, "op3_secrets": secrets.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL}
