"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, lookalike, markup, quality, repetition, sentences, stuffing, tokenizer


#: Rows named in a sample up to which their names are broadcast; about 60 MB.
MOST_NAMED = 1_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half is readable running sentences."""
    return quality.found(_read(spark, sf_dir, "corpus_docs"), "corpus_id", "text")


def p2_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document, beside the size and type it was delivered with."""
    docs = _read(spark, sf_dir, "corpus_docs").select("corpus_id", F.trim(F.lower("corpus_type")).alias("corpus_type"), "char_count", "text").distinct()
    rows = quality.measured(docs, "text")
    return rows.withColumn("count_is_length", F.col("char_count") == F.length("text")).drop("text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structures that stand as markup in each document or line with markup."""
    return markup.found(_corpus_and_lines(spark, sf_dir, "text"), ["src_table", "row_id"], "text")


def p3_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every document and line."""
    return markup.rendered(_corpus_and_lines(spark, sf_dir, "text"), ["src_table", "row_id"], "text").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quarter or more of repeated content, and findings whose related lines say the same."""
    docs, findings = _read(spark, sf_dir, "corpus_docs"), _read(spark, sf_dir, "lint_findings")
    again = repetition.repetitive(docs, "corpus_id", "text").select(F.lit("corpus_docs").alias("src_table"), "row_id")
    same = repetition.same_lines(findings, docs).select(F.lit("lint_findings").alias("src_table"), "row_id")
    return again.unionByName(same)


def p4_same_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at least half of whose other related lines say the same as their own line."""
    return repetition.same_lines(_read(spark, sf_dir, "lint_findings"), _read(spark, sf_dir, "corpus_docs"))


def p4_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document."""
    docs = _read(spark, sf_dir, "corpus_docs").select("corpus_id", "text").distinct()
    return repetition.measured(docs, "text").drop("text")


def _corpus_and_lines(spark: SparkSession, sf_dir: str, line_text: str) -> DataFrame:
    """(src_table, row_id, text) of all documents and of all prepared or raw lines."""
    docs = _read(spark, sf_dir, "corpus_docs").select(F.lit("corpus_docs").alias("src_table"), F.col("corpus_id").alias("row_id"), "text")
    lines = _read(spark, sf_dir, "doc_sentences").select(F.lit("doc_sentences").alias("src_table"), F.col("sentence_id").alias("row_id"), F.col(line_text).alias("text"))
    return docs.unionByName(lines)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the rows that split_sample names."""
    named = _read(spark, sf_dir, "split_sample").select("src_table", "row_id").distinct()
    # sent to every task while it is small; beyond that both sides are shuffled
    named = F.broadcast(named) if named.count() <= MOST_NAMED else named.hint("merge")
    rows = _corpus_and_lines(spark, sf_dir, "raw_text").join(named, ["src_table", "row_id"], "left_semi")
    return sentences.spans(rows, ["src_table", "row_id"], "text")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document and line; a row delivered twice counts once."""
    rows = _corpus_and_lines(spark, sf_dir, "raw_text").dropDuplicates(["src_table", "row_id"])
    return sentences.sentences(rows, ["src_table", "row_id"], "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents or of findings that look the same but are written with other characters."""
    return lookalike.pairs(_looked_at(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without pairs: each such row with the class it looks like and the class of its characters."""
    return lookalike.classes(_looked_at(spark, sf_dir)).drop("n")


def _looked_at(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {
        "corpus_docs": (_read(spark, sf_dir, "corpus_docs"), "corpus_id", "text"),
        "lint_findings": (_read(spark, sf_dir, "lint_findings"), "finding_id", "excerpt"),
    }


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every excerpt."""
    return lookalike.forms(_read(spark, sf_dir, "lint_findings"), "finding_id", "excerpt").select("finding_id", "form").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that hold at least twelve consecutive words of a test passage, and the item."""
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word spans to remove."""
    return leakage.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails whose own content is mostly a list of keywords, links or product tags."""
    return stuffing.found(_read(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees' score of every mail with content, its host's rate and the smoothed score."""
    return stuffing.scores(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_measures": p2_measures,
        "p3_found": p3_found,
        "p3_rendered": p3_rendered,
        "p4_found": p4_found,
        "p4_same_lines": p4_same_lines,
        "p4_measures": p4_measures,
        "p5_found": p5_found,
        "p5_sentences": p5_sentences,
        "p6_found": p6_found,
        "p6_classes": p6_classes,
        "p6_forms": p6_forms,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p9_found": p9_found,
        "p9_scores": p9_scores,
    }
