"""BM25 over white-space tokens; k1 = 1.5, b = 0.75, and a quarter of the mean idf in place of negative ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.runtime import cut

K1, B, FLOOR = 1.5, 0.75, 0.25


def _terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull()).select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")).alias("term"))


def bm25(documents: DataFrame, queries: DataFrame, top: int, group: str, seed_terms: bool = True) -> DataFrame:
    """The top documents of each group for every query (query_id, text); documents have doc_id, text and group.

    Only terms that some query has are scored, so the join is over the queries' terms.
    """
    asked = _terms(queries, "query_id", "query_text").distinct()
    # the texts are taken apart once; lengths, document counts and weights all come from the postings
    postings = cut(_terms(documents, "doc_id", "text").groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "postings")
    length = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    stats = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("idf", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    idf = raw.join(asked.select("term").distinct(), "term", "left_semi").select("term", F.when(F.col("idf") < 0, FLOOR * mean).otherwise(F.col("idf")).alias("idf"))
    tf = postings.join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    scored = tf.join(idf, "term").join(length, "doc_id").select("doc_id", "term", weight.alias("w")).join(asked, "term")
    total = scored.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score")).join(documents.select("doc_id", group), "doc_id")
    w = Window.partitionBy("query_id", group).orderBy(F.round("score", 9).desc(), "doc_id")
    return total.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
