"""The corpus operators' registered queries and their SQL."""

from . import classlm, decontaminate, license, merkle, minhash, mixing, negatives, quality, suffix, tokencount, tokenids, toxicity, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "pipeline": pipeline,
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_class_lm": classlm.op3_class_lm,
        "op4_mixing": mixing.op4_mixing,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_minhash": minhash.op6_minhash,
        "op7_warc": warc.op7_warc,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality": quality.op9_quality,
        "op10_token_ids": tokenids.op10_token_ids,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_merkle": merkle.op12_merkle,
        "op13_license": license.op13_license,
    }


def oracle_sql():
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_quality": quality.OP9_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_merkle": merkle.OP12_SQL,
    }
