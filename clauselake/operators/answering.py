"""From messages to answers as one plan: merge, route, retrieve, judge the evidence, cite or refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval, routing

#: What becomes of the routes that need no candidates, or whose answers other operators give.
OUTCOMES = {"clarify": "clarify", "refuse": "refused", "case": "forwarded", "change": "forwarded", "statistical": "forwarded"}


def asked(messages: DataFrame) -> DataFrame:
    """(query_id, question): what the last user message of each conversation asks in full."""
    merged = routing.merged_questions(messages)
    return merged.groupBy(F.col("conversation_id").alias("query_id")).agg(F.max_by("question", "seq").alias("question"))


def routed(questions: DataFrame) -> DataFrame:
    """(query_id, route, duties) of every question, without retrieval."""
    return questions.select("query_id", routing.route(F.col("question"))["route"].alias("route"), routing.wants_duties(F.col("question")).alias("duties"))


def answers(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, versions: DataFrame, tags: DataFrame, *, min_hits: int = 1, most_cited: int = 3) -> DataFrame:
    """One row a question: query_id, route, outcome, hits, chunk_ids and clauses (title and path), by place.

    Evidence counts and cites only chunks that are not degraded: with ``min_hits`` of them
    the outcome is ``answered`` with the first ``most_cited``, else ``not_covered`` with
    the closest ones. Judgments offer all of these for ``review``. Listings keep the
    duties among their chunks if duties are asked for (``listed``), or all where none is
    tagged (``listed_without_filter``). Other routes take no candidates.
    """
    routes = routed(questions)
    mine = candidates.select("query_id", "chunk_id", "place").join(routes, "query_id")
    sound = retrieval.drop_degraded(mine.where("route IN ('evidence', 'judgmental')"), chunks).select(*mine.columns, F.lit(False).alias("degraded_filter"))
    duties = retrieval.obligations_only(mine.where("route = 'enumerate' AND duties"), tags).select(*sound.columns)
    rest = mine.where("route = 'enumerate' AND NOT duties").select("*", F.lit(False).alias("degraded_filter"))
    offered = retrieval.citations(sound.union(duties).union(rest), chunks, versions)
    clause = F.concat_ws(" ", "doc_title", "clause_path").alias("clause")
    offered = offered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", clause))).alias("_all"), F.max("degraded_filter").alias("_open"))
    hits = F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all"))
    other = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    outcome = (
        F.when(F.col("route") == "evidence", F.when(hits >= max(1, min_hits), "answered").otherwise("not_covered"))
        .when(F.col("route") == "judgmental", "review")
        .when(F.col("route") == "enumerate", F.when(F.col("_open"), "listed_without_filter").otherwise("listed"))
        .otherwise(F.element_at(other, F.col("route")))
    )
    cited = F.when(F.col("route") == "evidence", F.slice("_all", 1, most_cited)).otherwise(F.col("_all"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return (
        routes.join(offered, "query_id", "left")
        .select("query_id", "route", outcome.alias("outcome"), hits.cast("long").alias("hits"), cited.alias("_cited"))
        .select("query_id", "route", "outcome", "hits", F.coalesce("_cited.chunk_id", none(kind)).alias("chunk_ids"), F.coalesce("_cited.clause", none("string")).alias("clauses"))
    )
