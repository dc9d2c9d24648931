"""The corpus pipeline: five stages over the documents, each written before the next one reads it.

Every stage but the last returns the columns of its input. Toxicity drops documents whose score reaches the operator's
threshold; the n-gram Jaccard join keeps the document with the smallest id of each class; decontamination drops documents that hold
a benchmark window; the PII stage masks every span it finds and counts ``n_chars`` anew where the text changed; mixing
returns one row for each copy of a document in the mix.

In every stage: a null or empty text passes as it is (mixing takes it in whole epochs), rows that repeat an id and a text are judged
alike (near-duplicates keep one of them), an empty table stays empty, and extra columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdprism.llm import contamination, jaccard, mixing, pii, toxicity
from cmdprism.llm.common import Aside, crc_bucket, table
from cmdprism.sources.tables import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, and all without text.

    A score at the threshold is dropped. Labels that repeat a document weigh as often in the fit.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 4) != 2)
    text = F.col("text")
    return docs.where(text.isNull() | (text == "") | (model.score(text) < toxicity.THRESHOLD))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; all documents without words stay."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; those without words hold none."""
    aside = Aside(docs)
    found = contamination.find_contamination(aside.rows, table(spark, sf_dir, "benchmark"), text_col=aside["text"], out_col="hits")
    return found.where("size(hits.spans) = 0").select(*aside.back())


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; of overlapping spans one mark is left.

    ``n_chars`` changes only where the text does.
    """
    aside = Aside(docs)
    text, n_chars = aside["text"], aside["n_chars"]
    found = aside.rows.withColumn("masked", pii.masked(pii.fit(docs), F.col(text)))
    same = F.col("masked").eqNullSafe(F.col(text))
    counted = F.when(same, F.col(n_chars)).otherwise(F.length("masked").cast("long"))
    return found.withColumns({text: F.col("masked"), n_chars: counted}).select(*aside.back())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every copy of a document in the temperature mix of the sources; no document is lost."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]
#: No SQL twin: the first, second and fourth stage rest on trained models and sampled paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
