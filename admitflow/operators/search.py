"""Full-text ranking over an inverted index (TXT7, JON4, SRT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.functions import rules
from admitflow.functions import vocab as V
from admitflow.functions.dialect import SPARK
from admitflow.plans.shared import materialise


#: Bytes of a stored table whose documents are dealt to one task, so that its pairs of queries and documents fit in memory.
DEALT_BYTES = 4 << 20


def _dealt(docs: DataFrame) -> DataFrame:
    """docs by key; texts are the smallest form of documents, so they are what is shuffled."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:  # unknown
        return docs.repartition("key")
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, size // DEALT_BYTES), "key")


def postings(docs: DataFrame, key: str, columns: list[str], wanted: DataFrame) -> DataFrame:
    """(col, token, key, length, tf) of the wanted tokens, and a row with empty column and token for each document.

    length counts the tokens of all columns together. Rows lie by key from the tokens to the end: nothing wider than
    a document is shuffled, and what is grouped by key and more isn't shuffled again (where the wanted tokens can be broadcast).
    """
    dealt = _dealt(docs.select(F.col(key).alias("key"), *columns))
    toks = dealt.select("key", *[F.expr(rules.tokens(SPARK, c)).alias(c) for c in columns])
    toks = toks.withColumn("length", sum(F.coalesce(F.size(c), F.lit(0)) for c in columns))
    listed = F.map_from_arrays(F.array(F.lit(""), *map(F.lit, columns)), F.array(F.array(F.lit("")), *columns))
    each = toks.select("key", "length", F.explode(listed).alias("col", "list")).select("key", "length", "col", F.explode("list").alias("token"))
    each = each.join(wanted.select("token"), "token", "left_semi")
    return each.groupBy("col", "token", "key", "length").agg(F.count(F.lit(1)).alias("tf"))


def top_k(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, columns: list[str], k: int = 50) -> DataFrame:
    """query_id, rank, key, score: the k lowest scores of each query (a bm25 score is better the lower it is), ties by key.

    Queries and postings meet on tokens, where the postings lie by document; scores are summed there, and the ranking's
    window keeps k rows per query of each task before it shuffles. Documents are tokenised twice, for the frequencies and
    for the scores, so that no table of postings is written. `fulltext.FullTextIndex` gives the same ranking from postings that are kept.
    """
    spark = queries.sparkSession
    asked = materialise(queries.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(F.expr(rules.tokens(SPARK, query_text)))).alias("token")), "asked")
    # the empty token is each document's own row
    wanted = materialise(asked.select("token").distinct().unionByName(spark.createDataFrame([("",)], "token string")), "wanted")
    post = postings(docs, key, columns, wanted)
    lists = post.groupBy("col", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"), F.sum(F.col("length") * F.col("tf")).alias("lengths"))
    lists = materialise(lists, "lists")
    total = lists.filter("col = ''").select(F.col("n").alias("n_docs"), (F.col("lengths") / F.col("n")).alias("avg_length"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(V.LEAST_IDF)).otherwise(idf)
    # one row of totals, so the broadcast is bounded
    known = lists.filter("col <> ''").crossJoin(F.broadcast(total)).select("col", "token", idf.alias("idf"), "avg_length")
    known = materialise(asked.join(known, "token"), "asked-lists")
    weight = -F.col("idf") * F.col("tf") * (V.K1 + 1) / (F.col("tf") + V.K1 * (1 - V.B + V.B * F.col("length") / F.col("avg_length")))
    met = post.join(known, ["col", "token"]).groupBy("query_id", "key").agg(F.round(F.sum(weight), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "key"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
