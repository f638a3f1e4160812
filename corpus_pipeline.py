"""From raw documents to token ids, in five stages.

``run(spark, sf_dir)`` applies the stages in turn; each writes its result as
Parquet to the shared folder, and the next one reads it back. Stages that send
texts to Python send them in short batches, a setting that the session keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.line_dedup import dedup_lines
from barloom.llm.mixing import mixed_documents
from barloom.llm.parts import send_short
from barloom.llm.queries import piece_model, read
from barloom.llm.scratch import keep
from barloom.llm.sentencepiece_codec import encode_documents
from barloom.llm.shingle_dedup import keep_first_of_similar
from barloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold.

    A null text scores as an empty one; rows without an id, or under one id,
    are judged one by one. Without labels of both kinds the share of toxic
    labels is every score. An empty table stays empty.
    """
    send_short(spark)
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that resemble an earlier line; ``n_chars`` is the new length.

    Earlier is by id, null ids first, then by line; rows of one id go by their
    texts, and equal rows are one document. A null text stays null and has a
    null length; a text whose lines all go becomes empty. An empty table stays empty.
    """
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at Jaccard similarity 0.8 or more.

    The first by id stays, rows without an id last. Shorter texts are one
    shingle; null, empty and wordless texts are near duplicates of each other.
    Equal rows are one group. An empty table stays empty.
    """
    send_short(spark)
    return keep_first_of_similar(docs, words=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated as often as it takes them.

    A null source is a source of its own, last in the order of weights; null
    and wordless texts bring no words and get the whole passes of their
    source. Ties among documents of one length are drawn by a seeded hash. An
    empty table stays empty.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix.

    Null and empty texts have no ids; rows without an id and repeated rows are
    kept as they are. An empty table stays empty.
    """
    send_short(spark)
    return encode_documents(docs, piece_model(), n=4)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("SentencePiece encoding", encoding),
]

#: No stage but the mix has a SQL form; tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
