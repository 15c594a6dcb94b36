"""BM25 over a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: str) -> F.Column:
    """Lower-cased runs of letters, marks, digits and low lines; ASCII is tried first."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9_\p{L}\p{M}\p{Nd}]+"), F.lit(0))


#: Terms of all queries together up to which they are broadcast to the texts; more are joined by a shuffle.
MOST_TERMS = 200_000
#: Bytes of input for each core up to which its few row groups wouldn't keep the cores busy.
FEW_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores, for work that costs far more than a shuffle of it. A large one has row groups enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < FEW_BYTES * cores else df


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", top: int = 10) -> DataFrame:
    """query_id, key, score, share (of the query's best) and place of each query's best texts. queries: query_id, query.

    One aggregate over the texts' distinct terms, combined within tasks, gives the document frequencies. Of the words themselves only
    those that queries hold are dealt, with their text's length beside them, by text: scores add up where the counts are made, and of these
only each task's best are shuffled. The other words of the corpus are never shuffled. Terms in more than half of
    the texts get EPSILON times the mean idf, as the usual variant has it; that mean is over all terms of the corpus.
    """
    words = spread(docs.select(key, text)).select(F.col(key), tokens(text).alias("_w"))
    words = words.select(key, "_w", F.size("_w").cast("double").alias("_len"))
    asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    few = asked.count() <= MOST_TERMS
    # explode_outer, for Spark would put a filter on the array's size before explode, and tokenise for it once more.
    # The empty term stands in every text: its row counts the texts and their lengths. All uses of df ask for the same columns of the same rows, so
    # Spark plans one exchange for them and reads it again.
    seen = words.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("_w"))).alias("term"), "_len").filter("term is not null")
    df = seen.groupBy("term").agg(F.array(F.count("*").cast("double"), F.sum(F.when(F.col("term") == "", F.col("_len")).otherwise(0.0))).alias("_seen"))
    n = F.element_at("_seen", 1)
    docs_of, length_of = F.max(F.when(F.col("term") == "", n)), F.max(F.when(F.col("term") == "", F.element_at("_seen", 2)))
    total = df.agg(docs_of.alias("_docs"), (length_of / docs_of).alias("_mean"))  # one row
    idf = F.ln(F.col("_docs") - n + 0.5) - F.ln(n + 0.5)
    mean = df.join(F.broadcast(total)).agg(F.avg(F.when(F.col("term") != "", idf)).alias("_mean_idf"), F.max("_docs").alias("_docs"), F.max("_mean").alias("_mean"))  # one row
    idf = F.when(idf < 0, EPSILON * F.col("_mean_idf")).otherwise(idf)
    wanted = df.join(F.broadcast(asked) if few else asked, "term").join(F.broadcast(mean)).select("query_id", "term", "times", idf.alias("idf"), "_mean")
    own = words.select(key, "_len", F.explode_outer("_w").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
    # Dealt by text once: counts of terms, and then sums over a query's terms, need no shuffle of their own.
    own = own.repartition(key).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("_len").alias("_len"))
    hits = own.join(F.broadcast(wanted) if few else wanted, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    scores = hits.groupBy("query_id", key).agg(F.round(F.sum(part), 8).alias("score"))
    w = Window.partitionBy("query_id")
    ranked = scores.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), key))).filter(F.col("place") <= top)
    return ranked.withColumn("share", F.col("score") / F.max("score").over(w))
