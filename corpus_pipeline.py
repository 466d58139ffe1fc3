"""From raw documents to token ids in five stages, each an operator of ``locusframe.llm``.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read as the next
one's ``docs``.  It must be written before the next stage is called, which deletes the tables that
the one before has left in the shared folder.  All but the last return the columns of ``documents``.
Every stage works on an empty table and on null or empty texts: such a text has no language and
leaves at the first stage, unless no row has a language label.  Rows of one doc_id are documents of
their own until near-duplicates go, where all rows of an id stay or go together; equal rows are copies of one
another.  Ties: of equally likely languages the first by name, of similar lines and near-duplicates the one of
the smallest doc_id.  Texts of any length are read whole.  Other columns pass through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import byte_bpe, language, lines, minhash, mixing
from locusframe.llm._common import discard, materialise, read_table, tracked, unpacked

_left: list[DataFrame] = []


def _stage(work: Callable) -> Callable:
    """A stage that first deletes the intermediate tables of the one before."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*[t for t in _left if t.sparkSession == spark])
        _left.clear()
        with tracked() as tables:
            out = work(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, in whatever languages the others are; where nothing could be learnt all stay."""
    model = language.learn(docs)
    if not model.languages:
        return docs
    return language.predict_rows(docs, model).where(F.col("lang_pred") != "und").select(*unpacked(docs.columns))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line go; a document goes if lines were removed and no words are left."""
    rest = lines.reduced(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rest.select(*unpacked(docs.columns, **changed))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; rows without doc_id stay."""
    ids = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return docs.join(ids.where("not kept"), "doc_id", "left_anti").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows repeat, and the last one of a source may be cut short."""
    return mixing.repeated(docs)


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every row."""
    import public_tokenizers as P

    return byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Language models, MinHash components and BPE merges have no SQL form; tests/llm holds the rows of ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
