"""Term statistics: TF-IDF in long form, top terms, surface forms, key phrases."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as X
from ..plans.lineage import stored
from ..plans.skew import lookup
from ..plans.topk import top


def term_lists(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``doc, terms, tf``: the different terms of each document that has any. A document that is several rows has their sum."""

    def run(frames):
        for f in frames:
            known, terms, tfs = X.Stems(), [], []
            for t in f.column("text").to_pylist():
                c = Counter(known.of(t))
                terms.append([*c])
                tfs.append([*c.values()])
            yield pa.RecordBatch.from_arrays([f.column("doc"), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc", "terms", "tf"])

    some = docs.select(F.col(doc).alias("doc"), text.alias("text"))
    rows = stored(some.mapInArrow(run, f"doc {dict(some.dtypes)['doc']}, terms array<string>, tf array<int>").filter(F.size("terms") > 0), "term-lists")
    several = stored(rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("same")), "repeated-documents")
    if several.isEmpty():
        return rows
    same = F.col("doc").eqNullSafe(F.col("same"))
    each = rows.join(several, same, "left_semi").select("doc", F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy("doc", F.col("x.terms").alias("term")).agg(F.sum("x.tf").cast("int").alias("tf"))
    one = each.groupBy("doc").agg(F.collect_list(F.struct("term", "tf")).alias("x")).select("doc", F.col("x.term").alias("terms"), F.col("x.tf").alias("tf"))
    return stored(rows.join(several, same, "left_anti").unionByName(one), "term-lists")


def term_counts(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``doc, term, tf``; read from ``term_lists``, so a text is parted once."""
    return term_lists(docs, doc, text).select("doc", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("doc", F.col("x.terms").alias("term"), F.col("x.tf").cast("long").alias("tf"))


def tfidf(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``doc, term, tf, df, weight``: tf x (ln((N + 1) / (df + 1)) + 1), each document scaled to length 1. Empty documents have no rows."""
    tf = term_counts(docs, doc, text)
    df = stored(tf.groupBy("term").agg(F.count("*").alias("df")), "term-documents").withColumn("uses", F.col("df"))
    n, total = docs.count(), df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    # terms that very many documents hold are broadcast and their rows stay spread over the documents
    known = lookup(tf, df, ["term"], ["df"], "uses", max(total, 1), F.col("doc"))
    raw = known.select("doc", "term", "tf", "df", (F.col("tf") * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", "tf", "df", (F.col("w") / norm).alias("weight"))


def top_terms(weights: DataFrame, k: int = 5) -> DataFrame:
    return top(weights, ["doc"], [F.round("weight", 9).desc(), F.col("term")], k)


def surface_forms(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``term, form, n``: the most frequent word behind each stem (ties: the first in the alphabet)."""
    raw = docs.select(F.explode(X.raw_tokens(text)).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    forms = raw.select(X.stemmed(F.col("form")).alias("term"), "form", "n")
    return forms.groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("m"), "form")).alias("x")).select("term", "x.form", (-F.col("x.m")).alias("n"))


def keyphrases(docs: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """``phrase, n``: runs of two or three words that are not stop words, at least ``least`` times."""
    grams = X.let(X.raw_tokens(text), lambda w: F.concat(X.runs_of_words(w, 2), X.runs_of_words(w, 3)))
    return docs.select(F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def entity_counts(docs: DataFrame, text: Column, least: int = 1, most: int = 4) -> DataFrame:
    return docs.select(F.explode(F.transform(X.entities(text, least, most), lambda e: F.lower(F.regexp_replace(e, r"\s+", " ")))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def grade_content(score: Column) -> Column:
    return X.grade(score, dims.CONTENT_GRADES)
