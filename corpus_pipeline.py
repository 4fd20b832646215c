"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``. All but the last return the columns
of ``docs``, whatever they are. Nulls, empty texts, repeated rows and empty
tables have the results that the operators' docstrings define; rows without
text pass the first three stages.

ORACLE_SQL is None: seeded sampling, learned models and tokens have no SQL form;
tests compare the stages with brute force on small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.llm import mixing, ngram_join, packing, quality, suffix_dedup
from gridwright.llm._common import checked, materialize, release, spent, whole_rows

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    model = quality.fit(docs.select("doc_id", "text"), quality.good_labels(spark, sf_dir))
    return quality.resample(docs, model, name="pipeline-quality").where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, that with the smallest id stays.

    Of rows with one id and words one stays, that with the least text.
    """
    found = ngram_join.similar(docs.select(F.col("doc_id").alias("id"), "text"), NEAR_WORDS, NEAR_PERCENT, "pipeline-near")
    found = materialize(found, "pipeline-near")
    gone = materialize(found.where("component_id <> id").select(F.col("id").alias("doc_id")).distinct(), "pipeline-near-gone")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(checked(gone), "doc_id", "left_anti").select(*columns)
    twice = found.where("n_shingles > 0 and id is not null").groupBy(F.col("id").alias("doc_id")).count().where("count > 1").select("doc_id")
    twice = materialize(twice, "pipeline-near-twice")
    if not twice.head(1):
        return kept
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    same = whole_rows(kept.join(checked(twice), "doc_id", "left_semi"), "doc_id", "text").withColumn("nth", nth).where("nth = 1").select("row.*")
    return kept.join(checked(twice), "doc_id", "left_anti").select(*columns).unionByName(same)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings are cut out; documents of which nothing is left go.

    A character that a cut would split goes as a whole; n_chars follows the text.
    """
    rows = suffix_dedup.keyed(whole_rows(docs, "doc_id", "text"))
    spans = suffix_dedup.repeated_spans(rows, name="pipeline-suffix")
    joined = rows.drop("text").join(spans.hint("merge"), ["d", "e"], "left")  # as in op 7: the spans grow with the documents

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for columns in batches:
                rows = zip(*(c.to_pylist() for c in columns), strict=True)
                yield pa.array([None if s is None else suffix_dedup.kept_bytes(t.encode(), s, e).decode("utf-8", "ignore") for t, s, e in rows], pa.string())
        finally:
            release()

    hit = F.col("starts").isNotNull()
    left = joined.withColumn("left", cut(F.when(hit, F.col("row.text")), "starts", "ends")).where("left is null or left <> ''")
    short = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        short = short.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    out = left.select("d", "e", F.when(hit, short).otherwise(F.col("row")).alias("row"))
    twice = rows.where(F.octet_length("text") >= suffix_dedup.LENGTH).groupBy("d", "e").count().where("count > 1").select("d", "e")
    twice = materialize(twice, "pipeline-suffix-twice")
    if twice.head(1):  # of rows repeated as a whole, one stays
        again = out.join(checked(twice), ["d", "e"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("d", "e").orderBy("d"))
        out = out.join(checked(twice), ["d", "e"], "left_anti").unionByName(again.withColumn("nth", nth).where("nth = 1").drop("nth"))
    return out.select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and sampled whole, so that sources meet their targets.

    The document in which a source's target ends is taken if that ends at least as near the target as leaving it.
    """
    rows = whole_rows(docs, "doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(rows)
    times = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("row.size")), 1).otherwise(0)
    return mixed.where(times > 0).select("row.row", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    parts = materialize(packing.pieces(docs.select("doc_id", "text")), "pipeline-pieces")
    return packing.pack(parts, name="pipeline-pack").select("doc_id", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
            if i:
                spent(before)
    return docs
