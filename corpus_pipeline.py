"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import decontam, jaccard, langid, linededup, mixing
from panelworks.llm.common import fresh, recorded, stored, take_back
from panelworks.llm.queries import SHARES, TOTAL

#: A language is rejected where no letter was found, or where another is about as likely.
LEAST_LANG_SCORE = 0.4
#: Lines found in this many documents lose all but their first occurrence: long ones (10 words or 50 code points), short ones.
LONG_LINE_DOCS, LINE_DOCS = 2, 10
#: A document is contaminated if it holds this many consecutive words of a benchmark item, or a shorter item whole.
WINDOW = 10


#: What the latest stage has sent out and stored on its way.
_held: list = []


def stage(f):
    """A stage begins by taking back what the stage before had sent out and stored on its way, as that one's result has been written."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        take_back(spark, _held)
        with recorded(_held):
            return f(spark, docs, sf_dir)

    return call


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned stay; texts without a letter, or between languages, go.

    NULL and empty texts have no letter and go; very long ones are read whole; repeated rows share a fate; an empty table stays empty.
    """
    model, name = langid.fit(docs), fresh("found", docs)
    out = docs.withColumn(name, langid.predict(model, spark, F.col("text")))
    return out.filter((F.col(f"{name}.lang") != langid.UND) & (F.col(f"{name}.score") >= LEAST_LANG_SCORE)).select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that any two documents share, and short ones that many share, stay in the first of them only; a text of such lines alone goes whole.

    NULL and empty texts, and rows with a NULL id, stay as they are; the first is by id, text's hash and position; rows that repeat id and text keep the same lines.
    ``n_chars``, if there, follows the text.
    """
    maps = linededup.bitmaps(docs, min_docs=LINE_DOCS, keep="first", long_docs=LONG_LINE_DOCS)
    dropped = fresh("dropped", docs)
    out = linededup.with_bitmaps(docs, maps, dropped)
    kept = fresh("kept", out)
    out = out.withColumn(kept, F.array_join(linededup.kept_lines(F.col("text"), F.col(dropped)), "\n"))
    out = out.filter(F.col(dropped).isNull() | (F.btrim(kept, F.lit(linededup.SPACE)) != ""))
    text = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.col(kept))
    chars = {"n_chars": F.when(F.col(dropped).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": text} | chars).select(*docs.columns)


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays the same, and that column's name."""
    name = fresh("row", docs)
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the row with the smallest id stays, of rows with one id the first of the table; NULL ids come last.

    Rows are judged one by one: rows that share an id but have other texts stay both. Texts without words are near nothing and stay.
    """
    rows, name = _with_row(docs)
    found = jaccard.classes(rows.select(F.col(name).alias("doc_id"), "text"), k=5, percent=80)
    ids = rows.select(F.col(name).alias("r"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(name).alias("row")).alias("key"))
    stay = found.join(ids, F.col("doc_id") == F.col("r")).groupBy("component_id").agg(F.min("key").alias("k")).select(F.col("k.row").alias(name))
    return rows.join(stored(stay), name, "left_semi").select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any ``WINDOW`` consecutive words of a benchmark item, or an item of fewer words whole, go; op 5 calls the same ones contaminated.

    Each row is judged by itself, also one of several with the same id or with none. Texts without words stay.
    """
    rows, name = _with_row(docs)
    found = decontam.matches(rows.select(F.col(name).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW)
    bad = stored(decontam.summary(found).filter("contaminated").select(F.col("doc_id").alias(name)))
    return rows.join(bad, name, "left_anti").select(*docs.columns)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and whole copies in the mix; those with no copy go.

    NULL and empty texts have no tokens and a rate like others; rows that share an id share the hash that rounds their rate. The columns ``n_tokens``, ``posterior``, ``rate``
    and ``copies`` are new; input columns of these names go.
    """
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "posterior", "rate", "copies")])
    _, domains, rates = mixing.mix(docs, labels, SHARES, TOTAL)
    out = domains.with_posteriors(docs, n="n_tokens", p="posterior").withColumn("rate", rates.rate())
    return out.withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).filter("copies > 0").select(*docs.columns, "n_tokens", "posterior", "rate", "copies")


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("ngram_jaccard_join", jaccard_join), ("decontamination", decontaminate), ("mixing", mix)]

#: Language ID and mixing are learned models; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stored(step(spark, docs, sf_dir))
    return docs
