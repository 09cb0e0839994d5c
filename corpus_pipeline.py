"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.bpe import encode_documents
from quaymark.llm.common import documents, shared_dir, table
from quaymark.llm.exact_dedup import exact_dedup
from quaymark.llm.language import identify, train
from quaymark.llm.minhash import near_duplicates
from quaymark.llm.mixing import mix

#: A text is rejected when no language has at least this share of its words.
LEAST_SHARE = 0.4
#: Numbers the rows from the first stage to the mix, which repeats rows: ids may be null or shared, so stages go by rows.
ROW = "__row"


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ROW. The number of a row is written before any use, so that all later reads agree on it."""
    return docs if ROW in docs.columns else table(docs.withColumn(ROW, F.monotonically_increasing_id()), shared_dir(spark), "numbered")


def _with_letters(docs: DataFrame) -> DataFrame:
    """Rows with a letter in their text; null texts have none."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one prevailing language, numbered. Where there is no language to learn, those with letters.

    Null, empty and letterless texts go; repeated rows and null ids are judged row by row; an empty table stays empty. Extra
    columns stay as they are, whatever their names.
    """
    model = train(docs)
    if not model.labels:
        return _with_letters(docs).select("*", F.monotonically_increasing_id().alias(ROW))
    labelled = identify(docs, model, docs.columns, prefix="__language_")
    return labelled.where((F.col("__language_lang_pred") != "und") & (F.col("__language_score") >= LEAST_SHARE)).select(*docs.columns, F.monotonically_increasing_id().alias(ROW))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, as exact_dedup() chooses it; null and empty texts are one group.

    Rows are removed by their numbers, so rows that share an id, or have none, are judged each by itself.
    """
    rows = _numbered(spark, docs)
    gone = exact_dedup(rows, keep=(ROW,)).where("not kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates. Texts without words, and null ones, are linked with nothing and stay."""
    rows = _numbered(spark, docs)
    gone = near_duplicates(rows, row_col=ROW).where("not kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: words taken by its size, rounded up or down by a fixed draw.

    Rows without words stay once. A null source is a source of its own. The same rows give the same mix, however they are read.
    """
    numbered = _numbered(spark, docs)
    rows, _, _ = mix(numbered, keep=(ROW,))
    seed = F.xxhash64(F.lit("copies"), "doc_id", "text")
    draw = F.pmod(seed, F.lit(1 << 20)) / F.lit(float(1 << 20))
    taken = rows.select(ROW, F.col("size").alias(f"{ROW}_size"), F.col("taken").alias(f"{ROW}_taken"))
    size, times = F.col(f"{ROW}_size"), F.floor(F.col(f"{ROW}_taken") / F.col(f"{ROW}_size") + draw)
    joined = numbered.join(taken, ROW).withColumn(f"{ROW}_times", F.when(size == 0, 1).otherwise(times).cast("int")).where(f"{ROW}_times > 0")
    names = [c for c in docs.columns if c != ROW]
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col(f"{ROW}_times"))).alias(f"{ROW}_copy")).select(*names)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix with its ids; null and empty texts have none."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_dedup", near_stage),
    ("mixing", mix_stage),
    ("byte_bpe", encode_stage),
]

#: The language model, the permutations and the merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written, so what follows starts from files that all executors can read."""
    at = shared_dir(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), at, name)
    return docs
