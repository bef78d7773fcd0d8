"""From raw documents to packed sequences, stage by stage.

Each stage works on all rows that the one before it kept. The first four return the columns
that came in: what they reject is gone, what they change is changed. The last one returns
the pieces of all remaining documents with their sequences and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.llm import exact_dedup, language, line_rules, near_dedup, packing
from cordwood.llm.queries import WORD_TOKENIZER, is_held_out
from cordwood.llm.shared import Scratch, cleared, small_batch_settings, small_batches, table, with_package


def prepared(spark: SparkSession) -> SparkSession:
    """The session for a stage with Python tasks: whole texts go to them few at a time.

    Rows of a stage are computed after its function has returned, so the setting stays when a
    stage is called by itself; ``run`` sets back what there was.
    """
    for name, value in small_batch_settings().items():
        spark.conf.set(name, value)
    return with_package(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language isn't clear."""
    prepared(spark)
    model = language.fit(docs.where(~is_held_out()))
    return language.identify(docs, docs.columns, model).where("accepted").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes common lines from texts, and drops documents that fail the rules or are
    depleted by that. ``n_chars`` follows a changed text."""
    judged = line_rules.judge(docs, docs.columns).where("kept")
    changed = F.col("n_common_lines") > 0
    held = {name: F.col(f"row.`{name}`") for name in docs.columns}
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return judged.select(
        *(F.when(changed, new[n]).otherwise(c).alias(n) if n in new else c.alias(n) for n, c in held.items())
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest ``doc_id`` stays."""
    return exact_dedup.exact_groups(docs, docs.columns).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, 0.8) the row with the smallest ``doc_id`` stays."""
    prepared(spark)
    return near_dedup.thinned(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 2048 ids, with the ids."""
    prepared(spark)
    return packing.pack_documents(docs, WORD_TOKENIZER, capacity=2048, end_id=0, keep_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: SQL can express neither the compressor nor the tokenizer; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written and read again."""
    scratch = Scratch(with_package(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        with cleared(spark, "stage"), small_batches(spark):
            last, docs = docs, scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if number:
            scratch.drop(last)
    return docs
