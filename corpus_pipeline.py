"""Corpus preparation in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last one returns the packed
pieces. ``run`` writes each stage's rows to the shared folder before the next, and
deletes what the stage and its predecessor wrote there.

Odd rows: a null text is an empty one. Empty texts have a score like others, are
one group of copies, near copies of nothing, and one end id for the packing.
Rows with a null id are scored and packed like others; of equal texts one with an
id goes before them, and near copies don't concern them. Rows that repeat id and
text stay together, being one document; rows that share an id alone are judged
each by its own text, but where one of them is a near copy its id goes. Of ties the
largest id stays among exact copies and the smallest among near ones. Texts of any
length are read whole. Columns beyond those of ``documents`` are dropped, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import quality_model
from quillspark.llm.common import discard, materialise, scope, session, table
from quillspark.llm.exact_dedup import exact_dedup, may_hold, value_filter
from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.packing import pack
from quillspark.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score lower are rejected.
LEAST_SCORE = 0.3
#: Of the near-duplicate stage: words in a shingle, least Jaccard similarity.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the ids in ``dropped``; rows that a bounded Bloom filter of
    these ids clears don't shuffle."""
    session(docs)
    packed, segments = value_filter(dropped.select(F.xxhash64("doc_id").alias("h")), dropped.count(), least=1)
    maybe = may_hold(docs.sparkSession.sparkContext.broadcast(packed), segments)
    docs = docs.withColumn("__maybe", F.coalesce(maybe.asNondeterministic()(F.xxhash64("doc_id")), F.lit(False)))
    rest = docs.where("__maybe").join(dropped, "doc_id", "left_anti")
    return docs.where("not __maybe").unionByName(rest).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs, words=SHINGLE_WORDS, share=SIMILARITY).where("not kept").select("doc_id")
    return without_ids(docs.select(*COLUMNS), materialise(dropped, "near-copies"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs.select(*COLUMNS)).withColumn("text", F.col("cut.kept_text"))
    return cut.where((F.length("text") > 0) | (F.col("cut.n_removed") == 0)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]
#: SQL can't express the classifier, the suffix sort or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        discard(*before)
        before = [docs]
    return docs
