"""The corpus pipeline: five stages from raw documents to token ids, each written and read again as the next one's input."""

from barline.llm import common, decontam, jaccard, quality, toxicity, unigram

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontam.stage),
    ("sentencepiece", unigram.stage),
]

#: Learned scores cannot be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
