"""Queries over the standard tables, one an operator, and their SQL."""

from axisweave.llm import classifier, decontaminate, language_model, lines, mixing, ngram_join, quality, secrets, sharding, substring
from axisweave.llm.common import table


def _docs(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": _docs(mixing.query),
    "op2_substring_dedup": _docs(substring.query),
    "op3_line_dedup": _docs(lines.query),
    "op4_decontaminate": lambda spark, sf_dir: decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_quality_rules": _docs(quality.query),
    "op6_ngram_join": _docs(ngram_join.query),
    "op7_shard": _docs(sharding.query),
    "op8_secret_scan": _docs(secrets.query),
    "op9_language_model": _docs(language_model.query),
    "op10_quality_classifier": lambda spark, sf_dir: classifier.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}
SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_substring_dedup": substring.SQL,
    "op3_line_dedup": lines.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_quality_rules": quality.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op8_secret_scan": secrets.SQL,
    "op9_language_model": language_model.SQL,
}
