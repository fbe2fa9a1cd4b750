"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes every stage's result as Parquet to the shared folder and
reads it back for the next one. All but the last return the columns of
documents, with n_chars brought up to date where the text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolodyne.llm import lines, packing, quality, repeats, simhash
from rolodyne.llm.common import intermediate, materialize, read_table, tune


def _apart(docs: DataFrame, inputs: list[str]) -> DataFrame:
    """The text and the other inputs of an operator, and all columns but the text
    in one, so that whatever they are called they can't clash with its own."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")
    return docs.select("text", *inputs, row)


def _together(changed: DataFrame, docs: DataFrame) -> DataFrame:
    size = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*(F.col("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Null and empty texts
    and null metadata are judged like any others; repeated rows alike. Without
    labels of both classes all documents stay."""
    tune(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_documents(_apart(docs, ["source", "lang", "n_chars"]), model).where("score >= 0.5")
    return scored.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the earliest stays. No document goes; a
    text may end up empty, a null one stays null. Rows without an id come last."""
    tune(spark)
    return _together(lines.dedup_lines(_apart(docs, ["doc_id"])), docs)


#: The near-duplicate stage: shingles of so many words; whole fingerprints are looked up within so many of 64 bits.
SHINGLE_WORDS, NEAR_BITS = 5, 2


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, and of those without a word
    one. Shingles have five words; texts that share 0.8 of them are linked. They
    meet by fingerprints of the whole text within two bits, or by an equal
    fingerprint of one of 16 parts of their shingles, which finds nine in ten of
    the pairs at 0.8 at the least (measured: all of those tested) and more of those
    more alike; every link is then checked. Rows are judged by their texts, whether
    or not they share an id or have none."""
    tune(spark)
    return simhash.drop_near_duplicates(docs, SHINGLE_WORDS, NEAR_BITS, simhash.SIMILAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of repeats.RUN words and more that an earlier document holds are
    cut out. No document goes; a null text stays null."""
    tune(spark)
    return _together(repeats.drop_repeats(_apart(docs, ["doc_id"]), run=repeats.RUN), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024. Every document takes part; a null text is empty."""
    tune(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Learned and iterative stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with intermediate() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir)))
    return docs
