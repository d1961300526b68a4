"""Documents to a training mixture: quality rules, near-dedup, substring dedup, mixing, encoding.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``; the
last returns the encoded documents with their places in the mixture. ``run`` writes each stage as Parquet in the shared folder
and reads it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compoundry.llm import common as C
from compoundry.llm.pfair_mix import mix
from compoundry.llm.piece_nbest import default_model, encode_nbest, piece_weights
from compoundry.llm.quality_rules import judge
from compoundry.llm.sketch_dedup import near_duplicates
from compoundry.llm.substring_words import remove_repeated_windows
from compoundry.plans.registry import ship_package

#: Words of a shingle, least similarity in percent, words of a repeated passage, and how far
#: the target weights of the sources lean from their own shares (1) to equal weights (0).
SHINGLE, SIMILAR, PASSAGE, TEMPER = 5, 80, 50, 0.7


def _shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no operator uses, and those names: extra columns cannot clash."""
    names = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _with_text(rows: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """The columns of the documents with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")}
    return rows.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that their whole source shares."""
    rows, at = _shielded(docs)
    judged = judge(rows, id_col=at["doc_id"], text_col=at["text"], host_col=at["source"], with_text=True)
    return _with_text(judged.where("_kept"), at, "_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, once.

    Every row is judged by its own text, whether or not others share its id: rows of the same id and
    text are one document, whose number is a hash of both. Of a group the smallest id stays, null
    ids first, then the smallest number. Only these numbers outlive the search; the texts move once, for
    the rows that stay.
    """
    rows, at = _shielded(docs)
    number = F.xxhash64(at["doc_id"], at["text"])
    with C.scratch(spark):
        numbered = rows.select(number.alias("doc"), F.col(at["doc_id"]).cast("long").alias("id"), F.col(at["text"]).alias("text"))
        near = near_duplicates(numbered, SHINGLE, SIMILAR, id_col="doc")
        ids = numbered.select("doc", F.coalesce("id", F.lit(C.NULL_ID)).alias("id")).distinct()
        first = near.join(ids, F.col("_doc") == F.col("doc")).groupBy("_component").agg(F.min(F.struct("id", "doc")).alias("first"))
        kept = C.write_once(first.select(F.col("first.doc").alias("_number")), "kept", outlive=True)
    out = rows.withColumn("_number", number).join(kept, "_number", "left_semi").dropDuplicates(["_number"])
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage stays where it stands first; documents of which nothing is left go."""
    rows, at = _shielded(docs)
    cut = remove_repeated_windows(rows, PASSAGE, id_col=at["doc_id"], text_col=at["text"])
    return _with_text(cut.where("_n_removed < _n_words or _n_words = 0"), at, "_kept")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: its files hold the sources in their target weights."""
    rows, at = _shielded(docs)
    placed = mix(rows, temper=TEMPER, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"])
    order = [F.col("_slot").asc_nulls_last(), F.col(at["doc_id"]).asc_nulls_first()]
    placed = placed.repartitionByRange(C.groups_for(spark, 1), *order).sortWithinPartitions(*order)
    return placed.select(*[F.col(n).alias(c) for c, n in at.items()])


def _position(docs: DataFrame) -> Column:
    """The place of a row in the order of its files: by the number of the file, then by the row in it.

    Spark may read files in any order and in parts; names and row numbers stay. Null for rows from no file.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.lit(None).cast("long")
    name = F.col("_metadata.file_name")
    part, piece = (F.coalesce(F.regexp_extract(name, x, 1).try_cast("long"), F.lit(0)) for x in (r"^part-(\d+)", r"-c(\d+)\."))
    # a partition's rows go on in further files where Spark limits the rows of a file
    return F.shiftleft(part, 40) + F.shiftleft(piece, 28) + F.col("_metadata.row_index")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its three best segmentations.

    ``mix_position`` is the document's place in the mixture: sorted by it, the rows hold the sources
    in their target weights.
    """
    out = encode_nbest(docs.withColumn("_position", _position(docs)), default_model(), 3, form="best", with_text=False,
                       weights=piece_weights(docs, default_model()))
    return out.select("doc_id", "lang", "source", "n_chars", F.col("_n_pieces").alias("n_pieces"), F.col("_ids").alias("ids"),
                      F.col("_scores").alias("scores"), F.col("_round").alias("round_trip"), F.col("_position").alias("mix_position"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Near-dedup and the N-best encoding cannot be stated in SQL; brute-force tests take its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = C.documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = C.write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
