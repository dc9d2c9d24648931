"""TF-IDF: a relational long form without any vocabulary limit, and the sparse-vector form for models."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cmdprism.functions.text import WORD_CHAR, text_or_empty
from cmdprism.plans.prefix import rank_in_order
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import COMMAND, ROW_ID, scratch_path
from cmdprism.sources.tables import materialize

# Fixed value: a term is a run of two or more word characters.
TOKEN_PATTERN = f"[{WORD_CHAR}]{{2,}}"
#: Terms of a vocabulary that the driver holds, and bytes of their texts; a larger vocabulary is a table.
DRIVER_TERMS = 1 << 18
DRIVER_BYTES = 16 << 20


@cache
def accent_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose decomposition without marks is one character, with that one; marks, which map to nothing, come last. And
    the characters that become several."""
    single, bases, marks, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if not plain:
            marks.append(char)
        elif plain != char:
            if len(plain) == 1:
                single.append(char)
                bases.append(plain)
            else:
                several[char] = plain
    return "".join(single + marks), "".join(bases), several


@cache
def expansion_tables() -> list[tuple[str, str]]:
    """For each place of an expansion the characters that have one there, with it, followed by those that are shorter and map to nothing."""
    several = accent_table()[2]
    out = []
    for place in range(max(map(len, several.values()))):
        longer = [c for c, plain in several.items() if len(plain) > place]
        shorter = [c for c, plain in several.items() if len(plain) <= place]
        out.append(("".join([*longer, *shorter]), "".join(several[c][place] for c in longer)))
    return out


def expand(c: Column) -> Column:
    """Ligatures, fractions, Hangul syllables and the like by the several characters they stand for, by table look-up."""
    tables = expansion_tables()
    # A character of the first table maps to nothing here: that finds the texts and the characters to expand.
    every = tables[0][0]

    def several(char: Column) -> Column:
        return F.concat(*[F.translate(char, source, target) for source, target in tables])

    held = F.length(F.translate(c, every, "")) < F.length(c)
    expanded = F.array_join(F.transform(F.split(c, ""), lambda char: F.when(F.translate(char, every, "") == "", several(char)).otherwise(char)), "")
    return F.when(held, expanded).otherwise(c)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without marks, character by character; plain ASCII texts are left alone."""
    source, target, _ = accent_table()
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(expand(c), source, target))


def tokens(c: Column, accents: bool = True) -> Column:
    """The words of a cleaned text; white space is in no word, so its runs may stay as they are."""
    cleaned = F.lower(text_or_empty(c))
    return F.regexp_extract_all(strip_accents(cleaned) if accents else cleaned, F.lit(TOKEN_PATTERN), 0)


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined by a blank."""
    runs = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = words if n == 1 else F.slice(words, 1, runs)
    for skip in range(1, n):
        out = F.zip_with(out, F.slice(words, skip + 1, runs), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def with_terms(df: DataFrame, text: str = COMMAND, ngram_range: tuple[int, int] = (1, 2), accents: bool = True) -> DataFrame:
    """Add the array of all terms (1- and 2-grams by default)."""
    low, high = ngram_range
    staged = df.withColumn("_tokens", tokens(F.col(text), accents))
    return staged.withColumn("terms", F.concat(*[ngrams(F.col("_tokens"), n) for n in range(low, high + 1)])).drop("_tokens")


def count_terms(terms: Column) -> Column:
    """Array of (term, tf): equal terms stand side by side once sorted, so the starts of their runs give the counts."""
    # Not array_sort, which calls a comparing lambda for every two words.
    ordered = F.sort_array(F.coalesce(terms, F.array().cast("array<string>")))

    def starts(words: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def runs(words: Column) -> Column:
        def counted(begins: Column) -> Column:
            ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(words)))
            return F.zip_with(
                begins, ends, lambda a, b: F.struct(F.element_at(words, a + 1).alias("term"), (b - a).cast("bigint").alias("tf"))
            )

        return F.element_at(F.transform(F.array(starts(words)), counted), 1)

    # The lambdas bind the sorted array and the starts, so both are computed once per row.
    return F.element_at(F.transform(F.array(ordered), lambda words: F.when(F.size(words) > 0, runs(words))), 1)


def term_counts(df: DataFrame, row_id: str = ROW_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, term, tf) and the columns in ``keep``, counted within the row: nothing is shuffled."""
    counted = df.select(row_id, *keep, F.explode_outer(count_terms(F.col("terms"))).alias("t"))
    return counted.where(F.col("t").isNotNull()).select(row_id, *keep, "t.term", "t.tf")


def fit_tfidf(counts: DataFrame, n_rows: int, min_df: int = 1, max_features: int | None = None, times: str | None = None) -> DataFrame:
    """Vocabulary table (term, df, corpus_tf, idf) with smooth idf ``ln((1+n)/(1+df)) + 1``.

    ``times`` names a column with the number of equal rows that a row stands for.
    """
    df, tf = (F.count("*"), F.sum("tf")) if times is None else (F.sum(times), F.sum(F.col("tf") * F.col(times)))
    vocabulary = counts.groupBy("term").agg(df.alias("df"), tf.alias("corpus_tf"))
    if min_df > 1:
        vocabulary = vocabulary.where(F.col("df") >= min_df)
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.col("corpus_tf").desc(), "term").limit(max_features)
    idf = F.log(F.lit(1.0 + n_rows) / (1.0 + F.col("df").cast("double"))) + 1.0
    return vocabulary.withColumn("idf", idf)


def weigh_terms(
    counts: DataFrame, vocabulary: DataFrame, row_id: str = ROW_ID, keep: tuple[str, ...] = (), out: str = "weight"
) -> DataFrame:
    """(row, term, tf, weight as ``out``) and the vocabulary's columns in ``keep``, before rows are scaled. Frequent terms do not skew the join.

    The vocabulary is read more than once and should be a written table.
    """
    sized = vocabulary.select("term", "df", "idf", *keep)
    weighted = attach_group_values(counts, sized, "term", "df", ["idf", *keep], spread_by=row_id)
    return weighted.where(F.col("idf").isNotNull()).select(row_id, "term", "tf", (F.col("tf") * F.col("idf")).alias(out), *keep)


def transform_tfidf(counts: DataFrame, vocabulary: DataFrame, row_id: str = ROW_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, term, tf, tfidf) and the vocabulary's columns in ``keep``, each row scaled to unit length."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(row_id)))
    return weigh_terms(counts, vocabulary, row_id, keep).select(row_id, "term", "tf", (F.col("weight") / norm).alias("tfidf"), *keep)


def summarize_tfidf(counts: DataFrame, vocabulary: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """(row, n_terms, total, top) of the values of :func:`transform_tfidf`: sums per row are scaled, so no row's terms have to meet."""
    weighted = weigh_terms(counts, vocabulary, row_id)
    sums = weighted.groupBy(row_id).agg(
        F.count("*").alias("n_terms"), F.sum("weight").alias("_sum"), F.max("weight").alias("_max"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm")
    )
    return sums.select(row_id, "n_terms", (F.col("_sum") / F.col("_norm")).alias("total"), (F.col("_max") / F.col("_norm")).alias("top"))


def vector_entries(vector: Column) -> Column:
    """Array of (pos, x) of a vector's entries other than 0, so that columns can be summed by rows and no task holds them all."""
    v = F.unwrap_udt(vector)
    sparse = F.zip_with(v["indices"], v["values"], lambda i, x: F.struct(i.alias("pos"), x.alias("x")))
    dense = F.transform(v["values"], lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    return F.filter(F.when(v["type"] == 0, sparse).otherwise(dense), lambda e: e["x"] != 0)


def vocabulary_size(terms: DataFrame, min_df: int = 1, max_features: int | None = None, times: str | None = None) -> int | None:
    """Number of terms of the vocabulary, or None where the driver can't hold it."""
    if max_features is not None and max_features <= DRIVER_TERMS:
        return max_features
    counted = terms.select("terms", (F.lit(1) if times is None else F.col(times)).alias("_times"))
    per_row = counted.select("_times", F.explode_outer(F.array_distinct("terms")).alias("t")).where("t IS NOT NULL")
    held = per_row.groupBy("t").agg(F.sum("_times").alias("n")).where(F.col("n") >= min_df)
    n, size = held.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    return n if n <= DRIVER_TERMS and (size or 0) <= DRIVER_BYTES else None


@dataclass
class TableVectorizer:
    """Terms to unit-length sparse TF-IDF vectors where the vocabulary (term, df, idf, pos) is a written table of ``size`` rows."""

    vocabulary: DataFrame
    size: int

    def transform(self, terms: DataFrame) -> DataFrame:
        """Add ``features``. The rows are written once under numbers of their own, so no key is needed."""
        rows = materialize(terms.withColumn("_row", F.monotonically_increasing_id()), "vector-rows")
        weighted = weigh_terms(term_counts(rows, "_row"), self.vocabulary, "_row", ("pos",))
        entries = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("weight").alias("x"))))
        found = weighted.groupBy("_row").agg(entries.alias("e"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        every = rows.select("_row").join(found, "_row", "left")
        empty = F.array().cast("array<struct<pos:int,x:double>>")
        scaled = F.transform(F.coalesce("e", empty), lambda e: F.struct(e["pos"].alias("pos"), (e["x"] / F.col("norm")).alias("x")))
        parts = every.select("_row", scaled.alias("e")).select(
            "_row",
            F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.size).alias("size"), F.col("e.pos").alias("indices"), F.col("e.x").alias("values")).alias("features"),
        )
        # The file holds the parts of a vector as Spark stores it, so it can be read as one.
        path = scratch_path(terms.sparkSession, "vectors")
        parts.write.parquet(path)
        vectors = terms.sparkSession.read.schema(StructType([parts.schema["_row"], StructField("features", VectorUDT())])).parquet(path)
        return rows.join(vectors, "_row").select(*terms.columns, "features")


def fit_table_vectorizer(terms: DataFrame, min_df: int = 1, max_features: int | None = None, times: str | None = None) -> TableVectorizer:
    """The vectorizer whose vocabulary is a table; terms take their places by a hash."""
    counted = terms.select("terms", (F.lit(1) if times is None else F.col(times)).cast("bigint").alias("_times"))
    n_rows = counted.agg(F.sum("_times")).first()[0] or 0
    fitted = fit_tfidf(term_counts(counted, "_times"), n_rows, min_df, max_features, "_times").select("term", "df", "idf")
    digest = F.xxhash64("term")
    ranked = rank_in_order(fitted.withColumn("_all", F.lit(0)), ["_all"], [digest, F.col("term")], key=digest)
    vocabulary = materialize(ranked.select("term", "df", "idf", F.col("_rank").cast("int").alias("pos")), "vocabulary")
    return TableVectorizer(vocabulary, vocabulary.count())


def vocabulary_table(spark: SparkSession, model: PipelineModel | TableVectorizer) -> DataFrame:
    """(pos, term) of a vectorizer's vocabulary."""
    if isinstance(model, TableVectorizer):
        return model.vocabulary.select("pos", "term")
    return spark.createDataFrame(list(enumerate(model.stages[0].vocabulary)), "pos INT, term STRING")


def fit_vectorizer(
    terms: DataFrame, min_df: int = 1, max_features: int | None = None, times: str | None = None, size: int | None = None
) -> PipelineModel | TableVectorizer:
    """Terms to unit-length sparse TF-IDF vectors in ``features``, all on the JVM.

    A vocabulary that the driver can hold makes a pipeline of MLlib's stages, a larger one a :class:`TableVectorizer`. ``times`` names
    a column with the number of equal rows that a row stands for; ``size`` is what :func:`vocabulary_size` gives, where it is known.
    """
    size = vocabulary_size(terms, min_df, max_features, times) if size is None else size
    if size is None:
        return fit_table_vectorizer(terms, min_df, max_features, times)
    counted = terms.select("terms", (F.lit(1) if times is None else F.col(times)).cast("bigint").alias("_times"))
    # Where every term is taken, equal rows need not be counted apart.
    every = counted if times is None or min_df <= 1 and max_features is None else counted.select("terms", F.explode(F.sequence(F.lit(1), "_times")))
    counter = CountVectorizer(inputCol="terms", outputCol="_tf", minDF=float(min_df), vocabSize=max(size, 1)).fit(every)
    entries = counter.transform(counted).select("_times", F.explode(vector_entries(F.col("_tf"))).alias("e"))
    held = entries.groupBy("e.pos").agg(F.sum("_times").alias("n")).toPandas()
    n_rows = counted.agg(F.sum("_times")).first()[0] or 0
    df = np.zeros(len(held))  # every term of the vocabulary is in some row
    df[held["pos"].to_numpy(np.int64)] = held["n"].to_numpy(np.float64)
    idf = np.log((n_rows + 1.0) / (df + 1.0)) + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    return PipelineModel([counter, scale, Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")])
