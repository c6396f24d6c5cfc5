"""A corpus pipeline: five stages, each on all that its predecessor kept.

quality      rejects documents that the classifier scores below its threshold
near_copies  keeps the document with the smallest doc_id of each group of near-duplicates (five words, similarity 0.8)
benchmark    drops documents that hold a benchmark item or a near copy of one
secrets      masks secrets inside texts
encode       token counts and digests of ids and decoded texts
"""

from __future__ import annotations

import public_tokenizers

from corvina.llm import bpe, decontaminate, jaccard_join, quality, secret_scan
from corvina.llm._common import through_storage


def judge_quality(spark, docs, sf_dir):
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark, docs, sf_dir):
    return jaccard_join.first_of_each(docs, 5, 80)


def drop_benchmark(spark, docs, sf_dir):
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark, docs, sf_dir):
    return secret_scan.redact(docs, secret_scan.train(secret_scan.samples(spark)))


def encode(spark, docs, sf_dir):
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", judge_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("secrets", mask_secrets), ("encode", encode)]
#: Trained models and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = through_storage(docs, f"pipeline-{name}")
    return docs
