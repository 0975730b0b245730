"""A corpus pipeline: language, exact copies, near copies, personal data, packing. Counted as part of quarrylane.llm."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import exact_dedup, language_id, near_copies, packing, pii
from quarrylane.session import ship, table


def _places(docs: DataFrame) -> DataFrame | None:
    """Files that docs reads (path, file: their number by path), if it is just Parquet files, each read once; else None."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty():
        return None
    try:
        place = docs.metadataColumn("_metadata")
        files = docs.groupBy(place["file_path"].alias("path")).agg(F.count("*").alias("n"), F.max(place["row_index"]).alias("last")).collect()
    except AnalysisException:  # no files, or none whose rows have a place
        return None
    if not files or len(files) > 1 << 22 or any(f.n != f.last + 1 for f in files):
        return None
    paths = sorted(f.path for f in files)  # as an Arrow table: a list of rows would start Python workers of its own in each executor
    return docs.sparkSession.createDataFrame(pa.table({"path": pa.array(paths, pa.string()), "file": pa.array(range(len(paths)), pa.int64())}))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that stays (identifiers may be null or repeated), in a column of that name.

    Rows of Parquet files have their file's number and their place in it, so that no text is written again; others are
    written once with numbers of their own.
    """
    row, path, file, at = (exact_dedup.unused(docs, x) for x in ("stage_row", "stage_path", "stage_file", "stage_place"))
    files = _places(docs)
    if files is None:
        return table(docs.withColumn(row, F.monotonically_increasing_id())), row
    place = docs.metadataColumn("_metadata")
    placed = docs.withColumns({path: place["file_path"], at: place["row_index"]}).join(F.broadcast(files.toDF(path, file)), path)
    return placed.withColumn(row, F.call_function("shiftleft", F.col(file), F.lit(40)) + F.col(at)).drop(path, file, at), row


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: those without letters, or of no clear or no learned language, go.

    Null and empty texts go; texts are judged whole; repeated rows and those with one identifier are judged each; where
    no row has a label nothing can be recognised and all go; an empty table stays empty. Further columns stay.
    """
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null as empty, A-Z lower-cased), the one that comes first.

    Rows are told apart by a number of their own, so that of repeated rows, and of rows with one or no identifier, one
    stays, and other texts under the same identifier stay too. An empty table stays empty; further columns stay.
    """
    ship(spark)
    own, row = _numbered(docs)
    groups = exact_dedup.exact_dedup(own, id_col=row)
    return exact_dedup.drop_ids(own, groups.where("not kept").select(F.col(row).alias("id")), row).drop(row)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8 or more alike), the one with the smallest doc_id.

    Operator 9's search proposes, MinHash bands beside it what four bits don't reach; exact similarity decides.

    Texts without words (null, empty, blank) are one group; null identifiers come last, of ties the first row stays.
    Texts are compared whole. An empty table stays empty; further columns stay.
    """
    ship(spark)
    own, row = _numbered(docs)
    groups = near_copies.near_copies(own, row)
    return exact_dedup.drop_ids(own, groups.where("row <> keep").select(F.col("row").alias("id")), row).drop(row)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind; n_chars is that of the new text.

    Null texts stay null, empty ones empty; texts are read whole and rows treated each; an empty table stays empty.
    """
    ship(spark)
    clean = pii.redact_table(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1,024 ids; see quarrylane.llm.packing.

    Null and empty texts are one id, the end's; rows with null or repeated identifiers are packed each; texts are cut
    wherever a window ends, none is dropped; an empty table gives no rows.
    """
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identified),
    ("exact deduplication", unique),
    ("near deduplication", dissimilar),
    ("personal data", redacted),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
