"""Keyword, vector and hybrid retrieval, and rule-based routing.

An index is three tables: postings (doc_id, term, tf), documents (doc_id, len) and terms
(term, df).  At scale, write postings bucketed or partitioned by term, so that a query reads
its terms alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..tables import scratch

K1, B = 1.5, 0.75
RRF_K = 60


@dataclass
class Bm25Index:
    postings: DataFrame
    docs: DataFrame


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Bm25Index:
    """docs: one row per id; rows without any term count as documents of length 0."""
    cut = scratch(docs.select(F.col(doc_id).alias("doc_id"), T.terms(F.coalesce(text, F.lit(""))).alias("terms")), "bm25-terms")
    postings = cut.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return Bm25Index(postings, cut.select("doc_id", F.size("terms").cast("long").alias("len")))


def replace_documents(index: Bm25Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Bm25Index:
    """The index with these documents added, or put in place of those with the same id."""
    new = index_documents(docs, doc_id, text)
    ids = docs.select(F.col(doc_id).alias("doc_id")).distinct()
    return Bm25Index(index.postings.join(ids, "doc_id", "left_anti").unionByName(new.postings), index.docs.join(ids, "doc_id", "left_anti").unionByName(new.docs))


def bm25(docs: DataFrame, query: str, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), best first, ties by id, straight from texts.

    One pass over the texts: each row counts the query's terms in its own term array, so nothing
    is exploded or shuffled.  The narrow counts are written, since both the sums and the scores
    need them (and a filter on them would else be pushed below the tokenizer, which would run
    once a term).  Terms repeated in the query count twice.
    """
    wanted = query_terms(docs, query)
    if not wanted:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    counts = scratch(term_counts(docs, list(wanted), doc_id, text), "bm25-counts")
    sums = corpus_sums(counts, list(wanted))
    scored = counts.where(any_of(f"t{i} > 0" for i in range(len(wanted)))).join(F.broadcast(sums))  # one row
    parts = [weight(F.col(f"t{i}"), F.col(f"df{i}")) * n for i, n in enumerate(wanted.values())]
    return scored.select("doc_id", sum(parts[1:], parts[0]).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def query_terms(docs: DataFrame, query: str) -> dict[str, int]:
    """A query's terms with their counts, by the same tokenizer as the documents'."""
    row = docs.sparkSession.range(1).select(T.terms(F.lit(query)).alias("t")).first()
    return dict(Counter(row.t))


def any_of(conditions) -> str:
    return " or ".join(conditions)


def term_counts(docs: DataFrame, terms: list[str], doc_id: str, text: str) -> DataFrame:
    """(doc_id, len, t0, t1, ...): length and count of each term, by document."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), T.terms(F.coalesce(text, F.lit(""))).alias("terms"))
    count = lambda t: F.size(F.filter("terms", lambda x: x == t))
    return cut.select("doc_id", F.size("terms").alias("len"), *[count(t).alias(f"t{i}") for i, t in enumerate(terms)])


def corpus_sums(counts: DataFrame, terms: list[str]) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])


def weight(tf: Column, df: Column) -> Column:
    """A term's part of the score; needs columns n, len and avgdl."""
    n, dl, avg = F.col("n"), F.col("len"), F.col("avgdl")
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.coalesce(F.try_divide(idf * tf * (K1 + 1), tf + K1 * (1 - B + B * F.try_divide(dl, avg))), F.lit(0.0))


def bm25_indexed(index: Bm25Index, query: str, k: int) -> DataFrame:
    """(doc_id, score) from the index: postings of the query's terms alone are read."""
    wanted = query_terms(index.docs, query)
    spark = index.docs.sparkSession
    q = spark.createDataFrame(list(wanted.items()), "term string, qtf int")
    hits = index.postings.join(F.broadcast(q), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sums = index.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    joined = hits.join(F.broadcast(df), "term").join(index.docs, "doc_id").join(F.broadcast(sums))
    score = F.sum(weight(F.col("tf"), F.col("df")) * F.col("qtf")).alias("score")
    return joined.groupBy("doc_id").agg(score).orderBy(F.desc("score"), "doc_id").limit(k)


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", vec_id: str = "vec_id") -> DataFrame:
    """(id, distance, score): exact nearest rows by l2 or cosine, ties by id; each task keeps its k best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    distance = V.l2(F.col("embedding"), q) if metric == "l2" else 1 - V.cosine(F.col("embedding"), q)
    found = vectors.select(F.col(vec_id).alias("id"), distance.alias("distance")).orderBy("distance", "id").limit(k)
    return found.withColumn("score", V.search_score(F.col("distance")))


#: Queries that are held at once.
QUERY_BLOCK = 10_000


def knn_matrix(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id") -> DataFrame:
    """(query_id, id, distance, rank): k nearest rows by l2 for many queries, in numpy.

    Queries are taken in blocks of ``QUERY_BLOCK``, each a pass over the vectors.  A task
    multiplies its batches with the block's matrix and keeps k rows per query and batch; a
    window then keeps k per query.
    """
    placed = scratch(ranked_whole(queries.select("query_id", "embedding"), F.col("query_id")), "knn-queries")
    blocks = [_knn_block(vectors, placed.where(f"rank > {at} and rank <= {at + QUERY_BLOCK}"), k, vec_id) for at in range(0, max(placed.count(), 1), QUERY_BLOCK)]
    near = blocks[0]
    for b in blocks[1:]:
        near = near.unionByName(b)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_block(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str) -> DataFrame:
    """(query_id, id, distance): k nearest rows in each batch for each query of a block."""
    import numpy as np
    import pandas as pd

    rows = queries.orderBy("query_id").collect()  # at most QUERY_BLOCK
    ids, m = [r.query_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}

    def run(batches):
        for b in batches:
            if not len(b) or not len(ids):
                continue
            x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            d = np.sqrt(np.maximum((m * m).sum(1)[:, None] - 2 * m @ x.T + (x * x).sum(1)[None, :], 0))
            own = b[vec_id].to_numpy()
            for i, q in enumerate(ids):
                best = np.lexsort((own, d[i]))[:k]
                yield pd.DataFrame({"query_id": q, "id": own[best], "distance": d[i][best]})

    return vectors.select(vec_id, "embedding").mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds[vec_id]}, distance double")


def similar(vectors: DataFrame, own: object, query: list[float], n: int = 3, vec_id: str = "vec_id") -> DataFrame:
    """The n most similar rows without the row itself (of the n + 1 nearest)."""
    return knn(vectors, query, n + 1, vec_id=vec_id).where(F.col("id") != F.lit(own)).orderBy("distance", "id").limit(n)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """1-based ``rank`` of a short, cut list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def ranked_whole(rows: DataFrame, *order: Column) -> DataFrame:
    """1-based ``rank`` of a list of any length, without one task that sorts it all.

    The rows are dealt out by range and written; then each range counts its own and starts
    after those before it.  ``order`` must leave no ties.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("__part", (F.sum("c").over(Window.orderBy("__part")) - F.col("c")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("rank", F.col("__own") + F.col("before")).drop("__part", "__own", "before")


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) of rankings (ranking, id, rank): the sum of 1 / (k + rank)."""
    return rankings.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hybrid(keyword: DataFrame, vector_tables: list[DataFrame], k: int, scope: str | None = None) -> DataFrame:
    """(id, score, source): reciprocal rank fusion of a keyword and a vector ranking.

    keyword: (id, score), the top 3k over all scopes, cut to the scope afterwards;
    vector_tables: (id, distance) of the top 2k of each table, ranked one table after the other.
    """
    own = keyword.orderBy(F.desc("score"), "id").limit(3 * k)
    own = own.where(F.col("id").startswith(scope + ":")) if scope else own
    kw = ranked(own, F.desc("score"), F.col("id")).select(F.lit(0).alias("ranking"), "id", "rank")
    parts = [t.orderBy("distance", "id").limit(2 * k).withColumn("t", F.lit(i)) for i, t in enumerate(vector_tables)]
    both = kw
    if parts:
        vec = parts[0]
        for p in parts[1:]:
            vec = vec.unionByName(p)
        vec = ranked(vec, F.col("t"), F.col("distance"), F.col("id")).select(F.lit(1).alias("ranking"), "id", "rank")
        both = kw.unionByName(vec)
    label = F.when(F.count_distinct("ranking") > 1, "hybrid").when(F.max("ranking") == 1, "vector").otherwise("bm25")
    fused = both.groupBy("id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), label.alias("source"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


# Openings of questions, and words that ask for relations.
QUESTIONS = ("how does", "how do", "how is", "what is", "what are", "what does", "why does", "why is", "explain")
RELATION_WORDS = (
    "call", "calls", "import", "imports", "depend", "depends", "dependency", "dependencies", "reference", "references", "caller", "callers", "callee", "callees",
)


def route(query: Column) -> Column:
    """struct(strategy, confidence, scope) of a query, by three rules; several make it hybrid."""
    q = F.trim(query)
    symbol = q.rlike("^[A-Z][a-zA-Z0-9]*$") | q.contains("::")
    question = q.rlike(rf"(?i)^({'|'.join(QUESTIONS)})\b")
    graph = q.rlike(rf"(?i)\b({'|'.join(RELATION_WORDS)})\b")
    hits = symbol.cast("int") + question.cast("int") + graph.cast("int")
    mean = (symbol.cast("int") * 0.95 + question.cast("int") * 0.8 + graph.cast("int") * 0.7) / hits
    made = lambda s, c, scope: F.struct(F.lit(s).alias("strategy"), c.alias("confidence"), F.lit(scope).alias("scope"))
    return (
        F.when(hits == 0, made("vector_search", F.lit(0.6), "all"))
        .when(hits > 1, made("hybrid", F.least(F.lit(1.0), mean), "all"))
        .when(symbol, made("exact_symbol", F.lit(0.95), "symbols"))
        .when(question, made("feature_search", F.lit(0.8), "features"))
        .otherwise(made("graph_traversal", F.lit(0.7), "all"))
    )


def refined_scope(given: Column, routed: Column) -> Column:
    """The caller's scope, else the router's if it is sure (0.75 or more) and narrow, else all."""
    sure = (routed["confidence"] >= 0.75) & (routed["scope"] != "all")
    return F.coalesce(given, F.when(sure, routed["scope"]), F.lit("all"))


def knowledge_documents(files: DataFrame, symbols: DataFrame, features: DataFrame) -> DataFrame:
    """(doc_id, text) of all that keyword search covers; blank texts are left out."""
    parts = [
        files.select(F.concat(F.lit("file:"), "path").alias("doc_id"), F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("purpose", "detailed_purpose", "path")], F.concat_ws(" ", "exports")).alias("text")),
        symbols.select(F.concat(F.lit("symbol:"), "qualified_name").alias("doc_id"), F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "signature", "jsdoc")]).alias("text")),
        features.select(F.concat(F.lit("feature:"), "id").alias("doc_id"), F.concat_ws(" ", "name", "description").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.trim("text") != "")
