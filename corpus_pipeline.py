"""A training-data pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it again as the next stage's docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from sieve.llm import bpe, decontaminate, ngram_join, quality_rules, suffix_dedup
from sieve.llm._jobs import materialise
from sieve.llm.queries import tokenizer


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, tokenizer("piece_bpe_32k.model"))


def near_duplicates(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 of their five-word shingles, directly or through others, the first stays."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def repeated_passages(spark, docs, sf_dir):
    """Strings of 100 bytes that also start earlier go, n_chars follows; documents of which nothing is left go."""
    return suffix_dedup.remove_repeats(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a window of ten words of a benchmark item (or a whole shorter one) go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark, docs, sf_dir):
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_encoding", token_ids),
]

#: SQL can't express the tokenisers' verdicts and ids; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, from the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
