"""From raw documents to token files: toxic documents and near copies go, then those with test items; the rest is mixed by source and encoded.

No stage asks for unique ids, but stages that decide by doc_id decide for all rows of it. Any column may be null, columns beside those of
documents pass through whatever their names, and an empty table gives an empty one with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clipgrove.llm import decontaminate, minhash, mixing, tokenfiles, toxicity
from clipgrove.llm.queries import MIX_BLOCK, TOKENS, mix_weights, scratch, table
from clipgrove.llm.words import free_name
from clipgrove.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from all labelled documents that are left.

    Null and empty texts score by the bias of the model alone. Repeated rows have one score each and stay or go together. A null doc_id has no
    label and is scored like any other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    score = free_name(docs, "_toxicity")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of documents linked by a similarity of 0.8 on sets of five words.

    Texts without words are linked with nothing and stay. Rows with a null doc_id take no part and stay. Repeated rows of one id and
    text stay or go together."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item aligns.

    Null and empty texts, and rows with a null doc_id, stay. All rows of an id with an aligned passage go."""
    gone = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: over the files, and within each.

    Nothing is dropped. A null source counts as the empty name, null ids come first in their source; texts are not looked at. Rows of one id
    lie together, at the place of any of them."""
    mixed = cut(mixing.mix(docs, mix_weights(docs), MIX_BLOCK).select("doc_id", "slot", "offset").dropDuplicates(["doc_id"]))
    slots = (mixed.agg(F.max("slot")).first()[0] or 0) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own, slot, offset = (free_name(docs, c) for c in ("_id", "_slot", "_offset"))
    placed = docs.join(mixed.select(F.col("doc_id").alias(own), F.col("slot").alias(slot), F.col("offset").alias(offset)), F.col("doc_id").eqNullSafe(F.col(own)))
    part = F.expr(f"cast({slot} * {parts} div {slots} as int)")
    return placed.repartitionById(parts, part).sortWithinPartitions(slot, offset).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents lie in their files; doc_id, start, n_tokens, ids_crc32 from reading them back.

    Null and empty texts are the end id alone. Every row is a document of its own, repeated or with a null id."""
    path = scratch(spark, "tokens")
    part = F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as bigint)"), F.lit(0))
    placed = docs.select((F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias("position"), "doc_id", "text")
    tokenfiles.write_tokens(placed, path, TOKENS())
    return tokenfiles.token_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources", mix_sources),
    ("token files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained model, alignments and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
