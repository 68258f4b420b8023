"""The corpus pipeline: documents in, encoded training text out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surecal.llm import mixing, pieces, secrets
from surecal.llm import toxicity as toxic
from surecal.llm.common import shielded, table, written
from surecal.llm.ngram_join import ngram_join, one_of_each
from surecal.llm.queries import PIECES, labelled_languages

# Languages weigh as a power of their tokens; no document is taken less than once.
LANGUAGE_POWER = 0.9


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; null and empty texts are scored like others."""
    model = toxic.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    plain, back = shielded(docs, ("doc_id", "text"))
    return toxic.score(plain, model).where("toxic_predicted = 0").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return one_of_each(docs, ngram_join(docs.select("doc_id", "text")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, ``n_chars`` follows the text."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages short of their target are repeated; none goes."""
    fitted = mixing.fit_rates(
        docs.select("doc_id", "text"), labelled_languages(spark, docs, sf_dir), LANGUAGE_POWER, least=1.0
    )
    return mixing.mixed(docs, fitted)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they give it back."""
    vocabulary = pieces.Vocabulary.read(PIECES)
    encoded = pieces.encode_documents(docs.select("doc_id", "text"), vocabulary)
    return pieces.decode_documents(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("restored"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix),
    ("pieces", encode),
]
# The toxicity model and the mix are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each one's result written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
