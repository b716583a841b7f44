"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs; all but the last return the columns of docs, further ones included, whatever their names.
Every stage takes an empty table and gives one back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from corpusloom.llm.common import free_name, stash, sweep, table

#: SQL can't express the stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.

    A null text is scored like an empty one, any length whole; rows are looked at one by one, so repeated rows, equal texts
    and null ids fare alike.  A score at the limit counts as toxic.
    """
    labels = table(spark, sf_dir, "labels").filter(toxicity.remainder(3) != 1)
    model = toxicity.train(docs, labels, "toxic", toxicity._fit_bytes)
    name = free_name(docs, "score")
    return toxicity.score(docs, model, name=name).filter(F.col(f"`{name}`") < toxicity.DECISION).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null and empty texts are a group, as are repeated rows; of ties in the smallest id one row stays.  A group whose ids
    are all null keeps one row too.
    """
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of long strings that repeat; characters cut in two go, n_chars follows.

    Every row stays, null ids and repeated rows included; a repeated row is an occurrence more, so long texts that repeat end
    up empty.  Null texts stay null and short ones whole.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    # the other columns travel as one struct, so none of them can clash with the operator's
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), "text")
    done = suffix_dedup.remove_repeats(rows, columns=("_row", "text"), characters=True)
    whole = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    done = done.select("_row", whole.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"_row.`{c}`") if c in rest else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass that takes words of a document, with those words as its text; n_chars follows.

    Documents of which nothing is taken, null and empty texts among them, have no row.  A null source is a source of its own;
    repeated rows are taken one by one.
    """
    return mixing.documents_of(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and decoded text; a null text is empty, rows are mapped one by one."""
    both = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text")))
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage has written down goes as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        sweep(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
