"""A corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and reread as the next one's docs. All stages but
the last return the columns of ``documents``. ``run`` applies them to the table
``documents`` of a folder.

Cases, in every stage: an empty table gives none; null and empty texts are clean (the
toxicity model scores them as no words), stay, and get no token ids; repeated rows and
rows that share an id are judged alike where their texts are alike, stay together in
``near_duplicates`` (what leaves is every row of an id whose group has a smaller id),
and a row without an id is never dropped for its copies; benchmark passages are judged
row by row, by the row's own text, with an id or without; further columns pass through all stages but the last, whatever their names;
very long texts are taken whole.

SQL cannot express the toxicity model or the tokenizer, so ``ORACLE_SQL`` is None
and the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofeat.llm import bpe, decontaminate, secrets, similar, toxicity
from geofeat.llm.common import read, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the toxicity model does not reject."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = "_" + max(docs.columns, key=len)  # longer than any name there
    return toxicity.scored(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar documents; documents without words stay."""
    found = similar.similar_components(docs)
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which hold no window of a benchmark item."""
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("places") > 0).select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["h_id"]) & (decontaminate.key_of(docs["text"]) == hit["h_key"])
    return docs.join(hit, same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and the count of characters brought up to date."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe.encode(texts, ranks, public_tokenizers.PATTERN).drop("text")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
