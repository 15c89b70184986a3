"""Hybrid retrieval as DataFrame plans: exact cosine, sparse inner product, rank fusion, quotas, tabs.

Many questions are answered in one plan: ``queries`` is (query_id, dense, sparse). Scores
are exact. Visibility filters and the corpus partition are applied before scoring. The
best cosines come from ``vectors``, which leaves out cells that cannot hold any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

from . import containment, postings as impact, products, vectors

INTERNAL, EXTERNAL, CASE = "P-INT", "P-EXT", "P-CASE"
PARTITIONS = (INTERNAL, EXTERNAL)


@dataclass(frozen=True)
class Limits:
    topk: int = 8
    partition_topk: int = 25
    enumerate_topk: int = 50
    enumerate_partition_topk: int = 50
    attach_topk: int = 3
    rank_constant: int = 60


#: Questions scored in one plan go to every task up to this number; more must come in parts.
MOST_QUERIES = 10_000


def visible(corpus: DataFrame, *, include_superseded: bool = False) -> DataFrame:
    """Rows that may be found: in force, or also superseded; staging never shows."""
    return corpus.where(F.col("status").isin(*(("effective", "superseded") if include_superseded else ("effective",))))


def filtered(corpus: DataFrame, *, domains: tuple[str, ...] = (), entities: tuple[str, ...] = (), clauses_only: bool = True) -> DataFrame:
    """Listing filters; every value is a literal of the plan, none is SQL text."""
    any_of = lambda column, values: F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))
    out = corpus.where(F.col("chunk_type") == "clause") if clauses_only else corpus
    out = out.where(any_of("biz_domain", domains)) if domains else out
    return out.where(any_of("entity_type", entities)) if entities else out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector has length 0 or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))))


def dense_scores(corpus: DataFrame, queries: DataFrame, n_queries: int) -> DataFrame:
    """(query_id, chunk_id, corpus_type, score) of every visible chunk with a cosine."""
    if n_queries > MOST_QUERIES:
        raise ValueError(f"{n_queries} questions; pass at most {MOST_QUERIES} at a time")
    asked = F.broadcast(queries.select("query_id", F.col("dense").alias("_q"), F.sqrt(_dot(F.col("dense"), F.col("dense"))).alias("_qn")))
    held = corpus.select("chunk_id", "corpus_type", "dense", F.sqrt(_dot(F.col("dense"), F.col("dense"))).alias("_n"))
    return held.join(asked, F.size("dense") == F.size("_q")).select("query_id", "chunk_id", "corpus_type", F.try_divide(_dot(F.col("dense"), F.col("_q")), F.col("_n") * F.col("_qn")).alias("score")).where("score IS NOT NULL")


def sparse_scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, corpus_type, score): sums of products over shared tokens.

    ``postings``: (token, chunk_id, corpus_type, weight). Chunks without a shared token
    have no row. Blocks of chunks and questions meet; see ``products``.
    """
    return products.sums(postings, queries)


def best(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``k`` highest scores of each group, with ``rank`` from 1; ties to the smaller chunk id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_best(corpus: DataFrame, queries: DataFrame, n_queries: int, k: int, by: tuple[str, ...] = ("query_id",), block: int = MOST_QUERIES) -> DataFrame:
    """The ``k`` best cosines of each group of ``by``, which holds query_id, for any number of questions.

    Cells of near vectors are left out where the triangle inequality allows; see
    ``vectors``. About four thousand questions, or ``block`` if that is less, meet a pack of rows in a task.
    """
    return vectors.best_cosines(corpus, queries, k, by, query_block=min(block, 4096))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per (query, corpus); (.., score, mode).

    A query without any sparse hit in a corpus keeps its dense scores (mode dense_only).
    """
    keys = ["query_id", "corpus_type", "chunk_id"]
    part = lambda column: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(column)), F.lit(0.0))
    joined = dense.select(*keys, F.col("rank").alias("_d"), F.col("score").alias("_cos")).join(sparse.select(*keys, F.col("rank").alias("_s")), keys, "full_outer")
    hybrid = F.max(F.col("_s").isNotNull()).over(Window.partitionBy("query_id", "corpus_type"))
    scored = joined.withColumn("_hybrid", hybrid).select(*keys, F.when(F.col("_hybrid"), part("_d") + part("_s")).otherwise(F.col("_cos")).alias("score"), F.when(F.col("_hybrid"), "hybrid").otherwise("dense_only").alias("mode"))
    return best(scored, k, ("query_id", "corpus_type"))


def search(corpus: DataFrame, postings: DataFrame | impact.ImpactIndex, queries: DataFrame, n_queries: int, k: int, *, include_superseded: bool = False, constant: int = 60) -> DataFrame:
    """Hybrid hits: the ``k`` best per question and corpus partition.

    With an impact index in place of postings, lists are read no further than they matter.
    """
    shown = visible(corpus, include_superseded=include_superseded)
    by = ("query_id", "corpus_type")
    if isinstance(postings, impact.ImpactIndex):
        sparse = impact.sparse_best(postings, queries, k, shown)
    else:
        sparse = best(products.sums(postings.join(shown.select("chunk_id"), "chunk_id", "left_semi"), queries, k), k, by)
    return fuse(dense_best(shown, queries, n_queries, k, by), sparse, k, constant)


def retrieve(corpus: DataFrame, postings: DataFrame, queries: DataFrame, n_queries: int, limits: Limits | None = None, **how) -> DataFrame:
    """The final candidates of each question: internal and external quotas, merged; ties go to internal ones.

    Sub-questions share the query_id of their question: a chunk keeps its best score.
    """
    limits = limits or Limits()
    hits = search(corpus.where(F.col("corpus_type").isin(*PARTITIONS)), postings, queries, n_queries, limits.partition_topk, constant=limits.rank_constant, **how)
    return merge_candidates(hits, limits.topk)


def merge_candidates(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of a question's hits over all partitions, each chunk once at its best score."""
    place = F.when(F.col("corpus_type") == INTERNAL, 0).when(F.col("corpus_type") == EXTERNAL, 1).otherwise(2)
    merged = hits.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct("corpus_type", "score", "mode", "rank"), F.struct("score", -F.col("rank"))).alias("_b")).select("query_id", "chunk_id", "_b.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), place, "rank", "chunk_id")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("rank")


def retrieve_cases(corpus: DataFrame, postings: DataFrame, queries: DataFrame, n_queries: int, limits: Limits | None = None) -> DataFrame:
    limits = limits or Limits()
    return search(corpus.where(F.col("corpus_type") == CASE), postings, queries, n_queries, limits.partition_topk, constant=limits.rank_constant)


def drop_degraded(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    return candidates.join(chunks.where("NOT degraded").select("chunk_id"), "chunk_id", "left_semi")


def best_per_document(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each document's best candidate; ties to the smaller chunk id; documents in order of score."""
    joined = candidates.join(chunks.select("chunk_id", "version_id"), "chunk_id")
    one = joined.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "version_id").orderBy(F.desc("score"), "chunk_id"))).where("_n = 1").drop("_n")
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def match_scores(candidates: DataFrame) -> DataFrame:
    """Adds ``match_score``: the score between the question's least and greatest, to 4 digits; 1 if they are equal."""
    per = Window.partitionBy("query_id")
    low, high = F.min("score").over(per), F.max("score").over(per)
    return candidates.withColumn("match_score", F.when(high > low, F.round((F.col("score") - low) / (high - low), 4)).otherwise(F.lit(1.0)))


def citations(candidates: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Four-level anchors in candidate order; candidates without a chunk are dropped."""
    own = chunks.select("chunk_id", "version_id", "clause_path", "page_start", F.col("text").alias("chunk_text"), "parent_chunk_id")
    docs = versions.select("version_id", F.col("title").alias("doc_title"), F.col("doc_number").alias("doc_no"), F.date_format("issue_date", "yyyy-MM-dd").alias("version"), F.col("version_status").alias("status"))
    return candidates.join(own, "chunk_id").join(docs, "version_id", "left")


def parent_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, parent_text) of chunks with a parent."""
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    return chunks.where("parent_chunk_id IS NOT NULL").select("chunk_id", "parent_chunk_id").join(parents, "parent_chunk_id").select("chunk_id", "parent_text")


def listing(candidates: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """One row a document: best score, distinct clause paths in order of score, first page, documents by score."""
    cited = citations(candidates, chunks, versions)
    hits = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "chunk_id", "clause_path")))
    grouped = cited.groupBy("query_id", "version_id").agg(F.max("score").alias("score"), F.array_distinct(F.filter(F.transform(hits, lambda h: h["clause_path"]), lambda p: F.coalesce(p, F.lit("")) != "")).alias("_paths"), F.min("page_start").alias("page"), F.first("doc_title").alias("doc_title"), F.first("doc_no").alias("doc_no"), F.first("status").alias("status"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "version_id")
    return grouped.select("query_id", F.row_number().over(order).alias("seq"), "version_id", F.coalesce("doc_title", F.lit("(未知制度)")).alias("doc_title"), F.coalesce("doc_no", F.lit("")).alias("doc_no"), F.when(F.size("_paths") > 0, F.array_join("_paths", "、")).otherwise("(全文)").alias("clauses"), "page", F.coalesce("status", F.lit("")).alias("status"), "score")


def obligations_only(candidates: DataFrame, tags: DataFrame) -> DataFrame:
    """Keeps candidates tagged as obligations; a question of which none is tagged keeps all, ``degraded_filter`` true."""
    duty = tags.where("tag_type = 'is_obligation'").select("chunk_id").distinct().withColumn("_duty", F.lit(True))
    marked = candidates.join(duty, "chunk_id", "left").withColumn("_any", F.coalesce(F.max("_duty").over(Window.partitionBy("query_id")), F.lit(False)))
    return marked.where("_duty OR NOT _any").withColumn("degraded_filter", ~F.col("_any")).drop("_duty", "_any")


def tabs(candidates: DataFrame, case_candidates: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """The four result tabs as rows (query_id, tab, seq, chunk_id, version_id, title, match_score, excerpt).

    regulations and clauses come from internal candidates, regulatory_rules from external
    ones (without a match score), cases from case candidates.
    """
    scored, cases = match_scores(candidates), match_scores(case_candidates)
    internal, external = scored.where(F.col("corpus_type") == INTERNAL), scored.where(F.col("corpus_type") == EXTERNAL)
    by_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))

    def rows(tab: str, hits: DataFrame, chars: int, scored: bool = True) -> DataFrame:
        cited = hits.join(chunks.select("chunk_id", F.col("version_id").alias("_v"), F.col("text").alias("_t")), "chunk_id").join(versions.select(F.col("version_id").alias("_v"), "title"), "_v", "left")
        return cited.select("query_id", F.lit(tab).alias("tab"), "seq", "chunk_id", F.col("_v").alias("version_id"), "title", (F.col("match_score") if scored else F.lit(None).cast("double")).alias("match_score"), X.excerpt(F.col("_t"), chars).alias("excerpt"))

    return (
        rows("regulations", best_per_document(internal, chunks).drop("version_id"), 120)
        .unionByName(rows("clauses", internal.withColumn("seq", by_place), 200))
        .unionByName(rows("regulatory_rules", best_per_document(external, chunks).drop("version_id"), 120, False))
        .unionByName(rows("cases", best_per_document(cases, chunks).drop("version_id"), 120))
    )


def attached_cases(bridged: DataFrame, semantic: DataFrame, k: int = 3) -> DataFrame:
    """Cases of each question: those that cite its clauses first, then similar ones; distinct, ``k`` at most.

    Both inputs are (query_id, case_id, ord).
    """
    both = bridged.withColumn("_from", F.lit(0)).unionByName(semantic.withColumn("_from", F.lit(1)))
    first = both.groupBy("query_id", "case_id").agg(F.min(F.struct("_from", "ord")).alias("_p"))
    return first.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "case_id"))).where(F.col("seq") <= k).select("query_id", "case_id", "seq")


def sufficiency(queries: DataFrame, candidates: DataFrame, min_hits: int = 1) -> DataFrame:
    """(query_id, hits, sufficient) of every question, those without candidates included."""
    hits = candidates.groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) >= max(1, min_hits)).alias("sufficient"))


# -------------------------------------------------------------------- sparse vectors and text

# Characters of agency names in document numbers.
AGENCY = "银保监证期基金信财会计审税国家中央行人民政公安司法农业水利文化卫健环境资源应急交通住建发改委办部局厅署院教育科技工商务海关质检统综纪总直属省市县区管理团群字函令规复告电知报批"
_NUMBER = rf"[{AGENCY}]{{0,10}}[〔(\[【][12]\d{{3}}[〕)\]】]\s*第?\s*\d{{1,4}}\s*[号號]"
_TITLE = r"《[^《》]{2,40}》"


def named_documents(question: Column) -> Column:
    """Document numbers, then titles, that a question names; each once."""
    half = X.to_halfwidth(question)
    found = F.concat(*[F.regexp_extract_all(half, F.lit(f"({p})"), F.lit(1)) for p in (_NUMBER, _TITLE)])
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != ""))


def legal_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, legal_terms) for questions that hold an oral term of the dictionary (ord, oral_term, legal_terms array)."""
    hits = containment.holding(questions, terms, "question", "oral_term")
    return hits.groupBy("query_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("legal_terms").alias("l")))), lambda x: x["l"]))).alias("legal_terms"))


def boosted(base: Column, spans: Column, factor: float) -> Column:
    """A sparse vector plus ``factor`` times each vector of ``spans`` (an array of maps)."""
    add = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.lit(factor) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(spans, base, add)


def token_postings(texts: DataFrame) -> DataFrame:
    """Term counts (token, chunk_id, corpus_type, weight) of lower-cased words."""
    words = texts.select("chunk_id", "corpus_type", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("token"))
    return words.groupBy("token", "chunk_id", "corpus_type").agg(F.count("*").cast("double").alias("weight"))


def corpus_rows(chunks: DataFrame, versions: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows of the vector corpus: chunks that are no parents, with what their version says.

    ``ranks``: (version_id, issuer_level). Domains are the version's list, or else its one.
    """
    from clauselake.functions.dates import yyyymmdd

    v = versions.select("version_id", "corpus_type", "sub_type", "perm_tag", "version_status", "biz_domains", "biz_domain", "effective_date")
    one = F.when(F.coalesce("biz_domain", F.lit("")) != "", F.array("biz_domain")).otherwise(F.array().cast("array<string>"))
    return (
        chunks.where("NOT is_parent")
        .join(v, "version_id")
        .join(ranks, "version_id", "left")
        .select("chunk_id", "version_id", "corpus_type", "sub_type", F.col("version_status").alias("status"), "perm_tag", F.when(F.size("biz_domains") > 0, F.col("biz_domains")).otherwise(one).alias("biz_domain"), F.coalesce("issuer_level", F.lit(0)).alias("issuer_level"), "chunk_type", "clause_path", F.coalesce("page_start", F.lit(0)).alias("page_start"), yyyymmdd(F.col("effective_date")).alias("effective_date"), X.truncate_bytes(F.col("text"), 2000).alias("text"))
    )
