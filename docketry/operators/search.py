"""Lexical index and search with BM25, every term required."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import index_terms
from docketry.session import cut

#: BM25's constants (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders of a stored index, and files that the postings of one folder are spread over.
BUCKETS, SPREAD = 64, 4


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def query_terms(query: str) -> list[str]:
    """Terms of a query, as often as they are given; raises where there are none."""
    terms = re.findall(r"[^\W_]+", query.casefold())
    if not terms:
        raise ValueError("query holds no term")
    return terms


@dataclass
class LexicalIndex:
    """Postings (term, id, dl, tf) with each document's size, and totals (n_docs, avgdl), of a set of texts."""

    postings: DataFrame
    totals: DataFrame

    def written(self) -> LexicalIndex:
        """The index as tables in the shared checkpoint folder, for many searches."""
        return LexicalIndex(cut(self.postings), cut(self.totals))

    def save(self, path: str) -> None:
        """Store the index: postings in folders by hash of their term, sorted by it, so a search reads only its terms.

        A term's postings are spread over ``SPREAD`` files, so a term of nearly all documents is no single task.
        """
        spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
        self.postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))

    def of_terms(self, terms: DataFrame | list[str]) -> DataFrame:
        """The postings of some terms: a list, or a table (term) that is joined."""
        if isinstance(terms, DataFrame):
            if "bucket" in self.postings.columns:
                terms = terms.withColumn("bucket", _bucket(F.col("term")))
            return self.postings.join(terms, terms.columns, "left_semi").drop("bucket")
        rows = self.postings
        if "bucket" in rows.columns:
            spark = rows.sparkSession
            wanted = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(wanted)).drop("bucket")
        return rows.where(F.col("term").isin(*terms))


def build(docs: DataFrame, key: str, text: str) -> LexicalIndex:
    """Index of all non-blank texts; one row per term and document, counted where the document lies."""
    rows = docs.where(F.trim(text) != "").select(F.col(key).alias("id"), index_terms(text).alias("terms"))
    postings = rows.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    return LexicalIndex(postings, rows.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avgdl")))


def search(index: LexicalIndex, query: str, limit: int) -> DataFrame:
    """(id, score): the best documents that hold every term; lower is better, ties by id.

    A term given twice counts twice. A term in more than half of the documents still counts a little.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    times: dict[str, int] = {}
    for t in query_terms(query):
        times[t] = times.get(t, 0) + 1
    wanted = F.create_map(*(x for t, n in times.items() for x in (F.lit(t), F.lit(n))))
    # read twice, for the terms' frequencies and for the scores
    hits = cut(index.of_terms(list(times)))
    weights = _weights(hits, index).withColumn("w", F.col("w") * F.element_at(wanted, F.col("term")))
    scored = hits.join(F.broadcast(weights), "term").groupBy("id").agg(F.count("*").alias("n"), F.sum(_part()).alias("s"))
    return scored.where(F.col("n") == len(times)).select("id", (-F.col("s")).alias("score")).orderBy("score", "id").limit(limit)


def _weights(hits: DataFrame, index: LexicalIndex) -> DataFrame:
    """(term, avgdl, w): the inverse document frequency of each term of ``hits``; the totals are one row."""
    df = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(index.totals))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", "avgdl", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)).alias("w"))


def _part() -> Column:
    return F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def search_many(index: LexicalIndex, cases: DataFrame, limit: int) -> DataFrame:
    """(case_id, id, score, rank): the ``limit`` best documents of each query of ``cases`` (case_id, query), in one plan.

    As ``search``, every term required; a query without terms finds nothing; an empty input gives no row.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    asked = cases.select("case_id", F.explode(index_terms("query")).alias("term")).groupBy("case_id", "term").agg(F.count("*").alias("times"))
    asked = cut(asked)
    hits = cut(index.of_terms(asked.select("term").distinct()))
    need = asked.groupBy("case_id").agg(F.count("*").alias("need"))
    weighted = asked.join(cut(_weights(hits, index)), "term").withColumn("w", F.col("w") * F.col("times"))
    scored = hits.join(weighted, "term").groupBy("case_id", "id").agg(F.count("*").alias("n"), (-F.sum(_part())).alias("score"))
    best = Window.partitionBy("case_id").orderBy("score", "id")
    full = scored.join(need, "case_id").where("n = need").select("case_id", "id", "score")
    return full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def snippet(text: Column, terms: Column, words: int = 24, before: int = 8) -> Column:
    """``words`` words around the first that is one of ``terms``, matches in brackets, an ellipsis where text is left out."""
    every = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(index_terms(w), terms)

    def cut_out(all_words: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(all_words, hit), True), F.lit(1)).cast("int")
        start = F.greatest(first - before, F.lit(1))
        shown = F.array_join(F.transform(F.slice(all_words, start, words), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
        return F.concat(F.when(start > 1, "… ").otherwise(""), shown, F.when(start + words - 1 < F.size(all_words), " …").otherwise(""))

    return F.get(F.transform(F.array(every), cut_out), F.lit(0))


def document_frequencies(index: LexicalIndex) -> DataFrame:
    """(term, df, cf): in how many documents a term stands, and how often in all."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
