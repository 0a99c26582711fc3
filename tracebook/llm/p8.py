"""Problem 8: a mixture of the corpus in which every source has its weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracebook.llm.mixing import curriculum_mixture
from tracebook.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Textbooks and glossaries lean to the begin of the run, examinations and reports to its end.
TILTS = {"textbook_pages": -0.4, "glossaries": -0.6, "exam_preparation": 0.8, "site_reports": 0.3}


def tokenizer(vocabulary: str | None, pattern: str | None) -> tuple[str, str]:
    """A rank file and the pattern that splits text before it. Unless given,
    those of the installed package `public_tokenizers`, which lists vocabulary
    files of public tokenizers; it is needed for nothing else."""
    if vocabulary is not None and pattern is not None:
        return vocabulary, pattern
    import public_tokenizers

    return vocabulary or str(public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN


def mixture_and_shares(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    vocabulary, pattern = tokenizer(vocabulary, pattern)
    return curriculum_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), key="doc_id", text="text", source="source", vocabulary=vocabulary, pattern=pattern, tilts=TILTS)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy_no, n_tokens, position, sorted by position."""
    return mixture_and_shares(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source of mix_targets reached."""
    return mixture_and_shares(spark, sf_dir)[1]
