"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

1. toxicity: rows that the subword-bag classifier, trained on ``labels``, predicts toxic go.
2. exact_dedup: of texts equal but for white space, the row with the smallest id stays.
3. near_dedup: of texts linked by five-word shingles at a similarity of 0.8, one row stays.
4. mixing: rows are repeated or left out so that sources have their target weights.
5. packing: texts are tokenised and cut into sequences of at most 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm.common import store
from loomery.llm.exact_dedup import drop_exact_duplicates
from loomery.llm.mixing import mix
from loomery.llm.near_dedup import drop_near_duplicates
from loomery.llm.packing import pack
from loomery.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. Null and empty texts stay; an empty table stays empty; without labels
    of both kinds nothing goes. Columns stay, whatever their names."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays, the one of the smallest id (null ids last). Null equals empty;
    repeated rows count as copies; an empty table stays empty. Columns stay, whatever their names."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, one of its smallest id. Rows without words or id stay; rows that
    repeat with id and text go together; an empty table stays empty. Columns stay, whatever their names."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated up to three times or left out, by source and size. Null is a source of its own;
    texts without words stay once; repeated rows are taken one by one; an empty table stays empty."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is its end token alone; repeated rows are packed
    each; a null id stays null; an empty table gives no pieces. Columns are those of the pieces."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Training, signatures and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
