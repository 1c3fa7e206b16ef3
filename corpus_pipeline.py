"""From raw documents to packed training sequences.

Each stage reads the documents that the one before it has written and keeps; its
decisions take effect. All stages but the last return the columns of documents.

Defined cases, in every stage: a null text is an empty one (the quality rules
reject it); an empty table gives an empty one; extra columns, whatever their
names, are kept as they are up to packing, which drops them; repeated rows are
judged alike and all stay or all go. Rows of one id with different texts: the
quality rules and the repeated passages judge each by its own text; near
duplicates and decontamination take them as one document. A row of null id is a
document of its own: nothing is its near duplicate, it neither gives nor loses
repeated passages, and it goes if it leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm import _shared
from cartolex.llm.decontam import clean
from cartolex.llm.jaccard import similarity_components
from cartolex.llm.packing import pack
from cartolex.llm.quality import apply_policy, ledger
from cartolex.llm.suffixdedup import remove_repeats, row_key


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def _fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality policy rejects go, each judged by its own text."""
    own = _fresh("own", docs)
    book = apply_policy(ledger(docs.select(F.struct(*docs.columns).alias(own), "text"), id_col=own))
    # A numbered row holds the filter back: below the rules it would evaluate their expressions again.
    numbered = book.select(F.col("doc_id").alias(own), "kept", F.monotonically_increasing_id().alias("number"))
    return numbered.where("kept and number >= 0").select(*(F.col(own)[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, that of the smallest id stays."""
    groups = similarity_components(docs)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    # By a merge at any size, so that small tables run the plan of large ones, whose ids no broadcast holds.
    return _like(docs, docs.join(gone.hint("merge"), docs["doc_id"] == gone["doc_id"], "left_anti"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat 50 bytes of a document of a smaller id are cut out of the text; a character cut in two goes whole."""
    with _shared.scratch(spark):
        cut = remove_repeats(docs, with_text=True).where("n_removed > 0").select("row", "kept")
        cut = _shared.materialize(cut.dropDuplicates(["row"]), "cut", release=True, keep=True)  # rows alike in id and text lose the same
    key, new = _fresh("row", docs), _fresh("kept", docs)
    cut = cut.select(F.col("row").alias(key), F.col("kept").alias(new))
    joined = docs.withColumn(_fresh("own", docs), row_key()).join(cut, F.col(_fresh("own", docs)) == F.col(key), "left")
    lost = F.col(key).isNotNull()
    out = joined.withColumn("text", F.when(lost, F.col(new)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _like(docs, out)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return _like(docs, clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what is left."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The suffix arrays, the latent search and the dynamic programme are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _shared.materialize(docs, name)
    return docs
