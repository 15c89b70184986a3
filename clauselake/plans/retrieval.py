"""Queries of retrieval: vectors from ``embeddings``, sparse tokens from ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.operators import answering
from clauselake.operators import postings as impact
from clauselake.operators import retrieval as R
from clauselake.operators import routing
from clauselake.sources.corpus import table, vector_corpus

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Every vector whose id is divisible by this is also a question.
ASK_EVERY = 20

_CORPUS = """corpus AS (SELECT vec_id AS chunk_id, (['P-INT', 'P-EXT', 'P-CASE'])[1 + label % 3] AS corpus_type,
  CASE WHEN vec_id % 11 = 0 THEN 'superseded' WHEN vec_id % 13 = 0 THEN 'staging' ELSE 'effective' END AS status, CAST(embedding AS DOUBLE[]) AS dense FROM embeddings WHERE embedding IS NOT NULL),
queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL),
scored AS (SELECT query_id, chunk_id, corpus_type, list_cosine_similarity(dense, q) AS score FROM corpus JOIN queries ON len(dense) = len(q) WHERE status = 'effective'),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_type ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 25),
ptok AS (SELECT vec_id % 97 AS token, vec_id AS chunk_id, 1.0 + vec_id % 5 AS weight FROM embeddings UNION ALL SELECT vec_id % 89 + 1000, vec_id, 2.0 FROM embeddings),
qtok AS (SELECT vec_id AS query_id, vec_id % 97 AS token, 1.5 AS w FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id, vec_id % 89 + 1000, 0.5 FROM embeddings WHERE vec_id % 20 = 0),
sscored AS (SELECT query_id, chunk_id, corpus_type, sum(weight * w) AS score FROM qtok JOIN ptok USING (token) JOIN corpus USING (chunk_id) WHERE status = 'effective' GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_type ORDER BY score DESC, chunk_id) AS rank FROM sscored QUALIFY rank <= 25),
fused AS (SELECT query_id, corpus_type, chunk_id, d.rank AS dr, s.rank AS sr, d.score AS cos FROM dense d FULL JOIN sparse s USING (query_id, corpus_type, chunk_id)),
moded AS (SELECT *, max(sr) OVER (PARTITION BY query_id, corpus_type) IS NOT NULL AS hybrid FROM fused),
summed AS (SELECT query_id, corpus_type, chunk_id, CASE WHEN hybrid THEN coalesce(CAST(1 AS DOUBLE) / (60 + dr), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + sr), 0) ELSE cos END AS score, CASE WHEN hybrid THEN 'hybrid' ELSE 'dense_only' END AS mode FROM moded),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_type ORDER BY score DESC, chunk_id) AS rank FROM summed QUALIFY rank <= 25),
cands AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE corpus_type WHEN 'P-INT' THEN 0 ELSE 1 END, rank, chunk_id) AS place FROM hits WHERE corpus_type <> 'P-CASE' QUALIFY place <= 8),
chunks AS (SELECT vec_id AS chunk_id, vec_id // 4 AS version_id, 'p' || (vec_id % 6) AS clause_path, vec_id % 9 + 1 AS page_start, 'text of ' || vec_id AS text FROM embeddings)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(corpus, postings, queries, how many queries)."""
    vectors = table(spark, sf_dir, "embeddings")
    corpus = vector_corpus(spark, sf_dir)
    pair = lambda token, weight: F.struct(token.alias("token"), weight.cast("double").alias("weight"))
    pairs = F.array(pair(F.col("vec_id") % 97, F.col("vec_id") % 5 + 1), pair(F.col("vec_id") % 89 + 1000, F.lit(2)))
    postings = vectors.select(F.col("vec_id").alias("chunk_id"), F.inline(pairs)).join(corpus.select("chunk_id", "corpus_type"), "chunk_id")
    asked = vectors.where(F.col("vec_id") % ASK_EVERY == 0)
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("dense"), F.create_map(F.col("vec_id") % 97, F.lit(1.5), F.col("vec_id") % 89 + 1000, F.lit(0.5)).alias("sparse"))
    return corpus, postings, queries, asked.count()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(i.alias("chunk_id"), F.floor(i / 4).alias("version_id"), F.concat(F.lit("p"), (i % 6).cast("string")).alias("clause_path"), (i % 9 + 1).alias("page_start"), F.concat(F.lit("text of "), i.cast("string")).alias("text"), F.lit(None).cast("long").alias("parent_chunk_id"), (i % 10 == 0).alias("degraded"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("vec_id") / 4)
    return table(spark, sf_dir, "embeddings").select(v.alias("version_id")).distinct().select("version_id", F.concat(F.lit("doc "), F.col("version_id").cast("string")).alias("title"), F.when(F.col("version_id") % 2 == 0, F.concat(F.lit("n"), F.col("version_id").cast("string"))).alias("doc_number"), F.lit(None).cast("date").alias("issue_date"), F.lit("effective").alias("version_status"))


@query(f"WITH {_CORPUS} SELECT query_id, corpus_type, chunk_id, rank, round(score, 6) AS score FROM dense")
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, queries, n = _inputs(spark, sf_dir)
    return R.dense_best(R.visible(corpus), queries, n, 25, ("query_id", "corpus_type")).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(f"WITH {_CORPUS} SELECT query_id, corpus_type, chunk_id, CAST(score AS DOUBLE) AS score FROM sscored")
def search_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, postings, queries, _ = _inputs(spark, sf_dir)
    return R.sparse_scores(postings.join(R.visible(corpus).select("chunk_id"), "chunk_id", "left_semi"), queries)


@query(f"WITH {_CORPUS} SELECT query_id, corpus_type, chunk_id, rank, CAST(score AS DOUBLE) AS score FROM sparse")
def search_sparse_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, postings, queries, _ = _inputs(spark, sf_dir)
    index = impact.build_index(postings, block_rows=16)
    return impact.sparse_best(index, queries, 25, R.visible(corpus)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_CORPUS} SELECT query_id, corpus_type, chunk_id, mode, round(score, 6) AS score FROM hits")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(*_inputs(spark, sf_dir), 25).withColumn("score", F.round("score", 6)).drop("rank")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve(*_inputs(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, corpus_type, mode, place, round(score, 6) AS score FROM cands")
def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).withColumns({"score": F.round("score", 6), "place": F.col("place").cast("long")})


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, round(score, 6) AS score FROM hits WHERE corpus_type = 'P-CASE'")
def search_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_cases(*_inputs(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_CORPUS}, j AS (SELECT c.*, k.version_id, k.clause_path, k.page_start FROM cands c JOIN chunks k USING (chunk_id)),
g AS (SELECT query_id, version_id, max(score) AS best, list(clause_path ORDER BY score DESC, chunk_id) AS paths, min(page_start) AS page FROM j GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, version_id) AS seq, version_id, 'doc ' || version_id AS doc_title, CASE WHEN version_id % 2 = 0 THEN 'n' || version_id ELSE '' END AS doc_no,
  array_to_string(list_filter(paths, lambda p, i: list_position(paths, p) = i), '、') AS clauses, page, 'effective' AS status FROM g""")
def answer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.listing(_candidates(spark, sf_dir), _chunks(spark, sf_dir), _versions(spark, sf_dir)).drop("score").withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH {_CORPUS}, cs AS (SELECT * FROM hits WHERE corpus_type = 'P-CASE'),
m AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) ELSE 1.0 END AS match_score FROM cands WINDOW w AS (PARTITION BY query_id)),
mc AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) ELSE 1.0 END AS match_score FROM cs WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT m.query_id, m.corpus_type, m.chunk_id, m.score, m.match_score, version_id FROM m JOIN chunks USING (chunk_id) UNION ALL SELECT mc.query_id, mc.corpus_type, mc.chunk_id, mc.score, mc.match_score, version_id FROM mc JOIN chunks USING (chunk_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_type, version_id ORDER BY score DESC, chunk_id) AS n FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus_type ORDER BY score DESC, chunk_id) AS seq FROM b WHERE n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS seq FROM j WHERE corpus_type = 'P-INT')
SELECT query_id, CASE corpus_type WHEN 'P-INT' THEN 'regulations' WHEN 'P-EXT' THEN 'regulatory_rules' ELSE 'cases' END AS tab, seq, chunk_id, version_id, 'doc ' || version_id AS title, CASE WHEN corpus_type <> 'P-EXT' THEN match_score END AS match_score FROM o
UNION ALL SELECT query_id, 'clauses', seq, chunk_id, version_id, 'doc ' || version_id, match_score FROM c""")
def answer_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir)
    return R.tabs(R.retrieve(*inputs), R.retrieve_cases(*inputs), _chunks(spark, sf_dir), _versions(spark, sf_dir)).drop("excerpt").withColumn("seq", F.col("seq").cast("long"))


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id FROM cands WHERE chunk_id % 10 <> 0")
def answer_without_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_degraded(_candidates(spark, sf_dir), _chunks(spark, sf_dir)).select("query_id", "chunk_id")


@query(f"""WITH {_CORPUS}, d AS (SELECT *, bool_or(chunk_id % 3 = 0) OVER (PARTITION BY query_id) AS any_duty FROM cands)
SELECT query_id, chunk_id, NOT any_duty AS degraded_filter FROM d WHERE chunk_id % 3 = 0 OR NOT any_duty""")
def answer_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _chunks(spark, sf_dir).where("chunk_id % 3 = 0").select("chunk_id", F.lit("is_obligation").alias("tag_type"))
    return R.obligations_only(_candidates(spark, sf_dir), tags).select("query_id", "chunk_id", "degraded_filter")


@query(f"WITH {_CORPUS}, n AS (SELECT query_id, count(*) AS hits FROM cands WHERE chunk_id % 4 = 0 GROUP BY 1) SELECT query_id, coalesce(hits, 0) AS hits, coalesce(hits, 0) >= 2 AS sufficient FROM queries LEFT JOIN n USING (query_id)")
def answer_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _inputs(spark, sf_dir)
    return R.sufficiency(inputs[2], R.retrieve(*inputs).where("chunk_id % 4 = 0"), 2)


_ASKED = ("这样做是否违规", "哪些规定要求备案", "什么是适当性", "信息披露规定", "今天天气如何", "呢", "有没有案例", "投顾办法修订了什么")
_ASKED_SQL = """asked AS (SELECT query_id, CASE WHEN k % 8 = 5 AND k % 3 = 0 THEN 'evidence' ELSE (['judgmental', 'enumerate', 'evidence', 'evidence', 'refuse', 'clarify', 'case', 'change'])[1 + k % 8] END AS route,
  k % 8 = 1 AS duties FROM (SELECT query_id, query_id // 20 AS k FROM queries))"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation for each vector that asks; every third one has said something before."""
    k = F.floor(F.col("vec_id") / 20)
    last = F.get(F.array(*map(F.lit, _ASKED)), (k % 8).cast("int"))
    said = F.when(k % 3 == 0, F.array(F.lit(_ASKED[3]), last)).otherwise(F.array(last))
    vectors = table(spark, sf_dir, "embeddings").where((F.col("vec_id") % ASK_EVERY == 0) & F.col("embedding").isNotNull())
    return vectors.select(F.col("vec_id").alias("conversation_id"), F.posexplode(said).alias("seq", "content")).select("*", F.lit("user").alias("role"), F.lit(None).cast("string").alias("route"))


@query(f"WITH {_CORPUS}, {_ASKED_SQL} SELECT query_id, route, duties FROM asked")
def questions_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.routed(answering.asked(_messages(spark, sf_dir)))


@query(f"""WITH {_CORPUS}, {_ASKED_SQL},
c AS (SELECT query_id, chunk_id, place, route, route = 'enumerate' AND duties AND NOT bool_or(chunk_id % 3 = 0) OVER (PARTITION BY query_id) AS open_, duties FROM cands JOIN asked USING (query_id)),
o AS (SELECT * FROM c WHERE CASE route WHEN 'evidence' THEN chunk_id % 10 <> 0 WHEN 'judgmental' THEN chunk_id % 10 <> 0 WHEN 'enumerate' THEN NOT duties OR open_ OR chunk_id % 3 = 0 ELSE false END),
g AS (SELECT query_id, count(*) AS hits, bool_or(open_) AS open_, list(chunk_id ORDER BY place) AS ids, list('doc ' || version_id || ' ' || clause_path ORDER BY place) AS named FROM o JOIN chunks USING (chunk_id) GROUP BY 1)
SELECT query_id, route, coalesce(hits, 0) AS hits,
  CASE route WHEN 'evidence' THEN CASE WHEN hits >= 8 THEN 'answered' ELSE 'not_covered' END WHEN 'judgmental' THEN 'review' WHEN 'enumerate' THEN CASE WHEN open_ THEN 'listed_without_filter' ELSE 'listed' END
    WHEN 'clarify' THEN 'clarify' WHEN 'refuse' THEN 'refused' ELSE 'forwarded' END AS outcome,
  coalesce(CASE WHEN route = 'evidence' THEN ids[1:3] ELSE ids END, []) AS chunk_ids, coalesce(CASE WHEN route = 'evidence' THEN named[1:3] ELSE named END, []) AS clauses
FROM asked LEFT JOIN g USING (query_id)""")
def questions_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    tags = chunks.where("chunk_id % 3 = 0").select("chunk_id", F.lit("is_obligation").alias("tag_type"))
    return answering.answers(answering.asked(_messages(spark, sf_dir)), _candidates(spark, sf_dir), chunks, _versions(spark, sf_dir), tags, min_hits=8)


@query("""WITH b AS (SELECT o_custkey AS q, o_orderkey % 50 AS c, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT o_custkey AS q, o_orderkey % 40 AS c, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 1),
f AS (SELECT q, c, min((k, ord)) AS p FROM (SELECT *, 0 AS k FROM b UNION ALL SELECT *, 1 FROM s) GROUP BY 1, 2)
SELECT q AS query_id, c AS case_id, row_number() OVER (PARTITION BY q ORDER BY p, c) AS seq FROM f QUALIFY seq <= 3""")
def answer_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = lambda odd, m: orders.where(F.col("o_orderkey") % 2 == odd).select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % m).alias("case_id"), F.col("o_orderkey").alias("ord"))
    return R.attached_cases(rows(0, 50), rows(1, 40)).withColumn("seq", F.col("seq").cast("long"))


@query("SELECT item_id AS chunk_id, w AS token, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark) GROUP BY 1, 2")
def sparse_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.token_postings(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.lit("P-INT").alias("corpus_type"), "text")).drop("corpus_type")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ['证监〔2024〕' || n || '号', '《办法' || n || '》'] WHEN 1 THEN ['《办法' || n || '》'] ELSE [] END AS named FROM (SELECT s_suppkey, s_suppkey % 10000 AS n FROM supplier)""")
def question_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pattern of a number takes four digits at most.
    k = (F.col("s_suppkey") % 10000).cast("string")
    q = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("看了证监〔2024〕"), k, F.lit("号与《办法"), k, F.lit("》"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("《办法"), k, F.lit("》的要求"))).otherwise("没有")
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.named_documents(q).alias("named"))


@query("SELECT n_nationkey AS query_id, list(r_name ORDER BY r_regionkey) AS terms FROM nation JOIN region ON contains('in ' || n_name || (SELECT string_agg(r.r_name, ' ') FROM region r WHERE r.r_regionkey <= n_regionkey), r_name) GROUP BY 1")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    upto = table(spark, sf_dir, "nation").join(regions, F.col("r_regionkey") <= F.col("n_regionkey")).groupBy("n_nationkey", "n_name").agg(F.array_join(F.collect_list("r_name"), " ").alias("_r"))
    questions = upto.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("in "), "n_name", "_r").alias("question"))
    return routing.terms_in(questions, regions.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("term")))
