"""The registered queries of this subpackage and, where SQL can tell them, their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .decontaminate import leaks
from .html_main import main_texts
from .language import predicted_languages
from .masked_lm import pseudo_likelihoods
from .mixing import mixed_sizes
from .partenum import near_duplicates
from .periodic_runs import periodic_runs, run_digests, with_planted_runs
from .pseudonyms import KINDS, pseudonymised
from .quality import quality
from .resampling import resampled
from .secret_scan import KINDS as SECRET_KINDS
from .secret_scan import listed, secrets
from .sharding import sharded
from .toxicity import fit_toxicity, toxicity

# The queries' own key; a real one comes from the caller.
PSEUDONYM_KEY = "surveytab-example-key"

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers started for it find this package, wherever they start."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{paths}".rstrip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _how_many(values: Column, value) -> Column:
    return F.size(F.filter(values, lambda v: v == F.lit(value))).cast("bigint")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and how many finds of each kind were replaced."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, kinds = pseudonymised(documents, PSEUDONYM_KEY)
    return found.select("doc_id", "text", *[_how_many(F.col(kinds), n).alias(f"n_{n}") for n in KINDS])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    found = secrets(table(spark, sf_dir, "documents"))
    counts = [_how_many(F.col("base.kind"), k).alias(f"n_{kind}") for k, kind in enumerate(SECRET_KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(documents, fit_toxicity(documents, labels))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_sharding": op11_sharding,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op4_ngram_jaccard_join": oracle.NGRAM_JACCARD_JOIN,
    "op9_mixing": oracle.MIXING,
    "op12_importance_resampling": oracle.IMPORTANCE_RESAMPLING,
}
