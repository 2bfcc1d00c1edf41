"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from . import chat, decontam, jaccard, packing, product_codes, quality, spelling, token_store, toxicity, unigram, vectors, warc


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_token_counts": unigram.op3_token_counts,
        "op4_embedding_dedup": vectors.op4_embedding_dedup,
        "op5_chat": chat.op5_chat,
        "op6_quality": quality.op6_quality,
        "op7_sentencepiece": unigram.op7_sentencepiece,
        "op8_warc": warc.op8_warc,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_token_store": token_store.op10_token_store,
        "op11_packing": packing.op11_packing,
        "op12_spelling": spelling.op12_spelling,
        "op13_vector_codes": product_codes.op13_vector_codes,
    }


def oracle_sql():
    return {"op2_jaccard_join": jaccard.OP2_SQL, "op9_decontamination": decontam.OP9_SQL, "op4_embedding_dedup": vectors.OP4_SQL, "op5_chat": chat.OP5_SQL, "op8_warc": warc.OP8_SQL, "op12_spelling": spelling.OP12_SQL, "op13_vector_codes": product_codes.OP13_SQL}
