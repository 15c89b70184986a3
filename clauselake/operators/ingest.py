"""A batch as one job: from parsed blocks to chunks, tags, references, states and search rows.

Every stage is a plan over the whole batch. The clause tree and the chunks are written
once, and all later tables are read from them. What a stage makes of a document is a row
(version_id, state, to_state); documents then run through their states until none can go
on. A document that fails keeps its state, with the reason in a row of its own, and
stops no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions import dates
from clauselake.sources.tables import written

from . import cases, obligations, quality, references, registry, retrieval, structure

#: Most states that a document can pass; no run of a worker has more steps.
MOST_STEPS = len(registry.TRANSITIONS)
_STEPS = "array<struct<from_state:string,to_state:string>>"


def run_until_idle(versions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs each document through its states: (version_id, pipeline_status, steps, failed_in, failure).

    ``versions``: (version_id, pipeline_status). ``outcomes``: (version_id, state, to_state,
    failure), what the stage of a state makes of a document; of several the smallest
    to_state counts, and a failure before any. A document stops where a person must act,
    where it has no outcome, at a failure, and at a step that is no edge.
    """
    one = outcomes.groupBy("version_id", "state").agg(F.min("to_state").alias("to_state"), F.min("failure").alias("failure"))
    told = one.groupBy("version_id").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("to_state", "failure")))).alias("_told"))
    legal = F.array(*[F.lit(f"{a}>{b}") for a, targets in registry.TRANSITIONS.items() for b in targets])
    none = F.lit(None).cast("string")

    def step(acc: Column, _: Column) -> Column:
        now = acc["now"]
        then = F.when(acc["failure"].isNull() & now.isin(*registry.ADVANCEABLE), F.try_element_at("_told", now))
        illegal = ~F.array_contains(legal, F.concat(now, F.lit(">"), F.coalesce(then["to_state"], F.lit("?"))))
        failure = F.coalesce(acc["failure"], then["failure"], F.when(then.isNotNull() & illegal, "illegal transition"))
        goes = then.isNotNull() & failure.isNull()
        steps = F.when(goes, F.array_append(acc["steps"], F.struct(now.alias("from_state"), then["to_state"].alias("to_state")))).otherwise(acc["steps"])
        return F.struct(F.when(goes, then["to_state"]).otherwise(now).alias("now"), steps.alias("steps"), failure.alias("failure"))

    start = F.struct(F.col("pipeline_status").alias("now"), F.array().cast(_STEPS).alias("steps"), none.alias("failure"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step)
    ran = versions.join(told, "version_id", "left").select("version_id", "pipeline_status", run.alias("_r"))
    return ran.select("version_id", F.col("_r.now").alias("pipeline_status"), F.col("_r.steps").alias("steps"), F.when(F.col("_r.failure").isNotNull(), F.col("_r.now")).alias("failed_in"), F.col("_r.failure").alias("failure"))


@dataclass(frozen=True)
class Batch:
    """The tables of a batch.

    states: (version_id, pipeline_status, version_status). events: (version_id, seq,
    from_state, to_state, error_code). queue: (version_id, queue_type, reason). failures:
    (version_id, state, failure). The others are those of their modules.
    """

    tree: DataFrame
    chunks: DataFrame
    references: DataFrame
    tags: DataFrame
    verdicts: DataFrame
    conflicts: DataFrame
    facts: DataFrame
    corpus: DataFrame
    states: DataFrame
    events: DataFrame
    queue: DataFrame
    failures: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


# What documents are queued for, and the codes of a refused parse and a failed gate.
REASONS = {"conflicts": "metadata conflict", "revision": "revision to be confirmed", "plain": "metadata to be confirmed", "gate": "quality gate", "parse": "not parsed"}
PARSE_FAILED, GATE_FAILED = "E203", "E301"


def ingest_batch(
    versions: DataFrame,
    blocks: DataFrame,
    issuers: DataFrame,
    known: DataFrame,
    aliases: DataFrame,
    *,
    today: Column,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    tables: DataFrame | None = None,
    limits: structure.ChunkLimits | None = None,
    thresholds: quality.Thresholds | None = None,
    confirm_plain: bool = False,
) -> Batch:
    """Takes the registered documents of a batch as far as they go without a person.

    ``versions``: (version_id, corpus_type, title, doc_number, issue_date, effective_date,
    issuer, supersedes_version_id, pipeline_status, degraded and the columns that
    ``retrieval.corpus_rows`` reads). ``blocks``: those of ``quality.indicator_values``.
    ``issuers``: (code, name, issuer_level). ``known`` and ``aliases``: what references across
    documents are resolved against. ``embed``: makes vectors of the chunks that are searched
    (chunk_id, version_id, text) and returns rows with the chunk_ids that have one; without
    it no document goes beyond EMBEDDING. ``tables``: as in ``structure.article_tables``.

    A document without blocks fails to parse. The gate's verdict decides about structuring;
    only documents that pass are cut into chunks, tagged, read for references and checked
    against their manifest. Then all of them are queued for a person, or with
    ``confirm_plain`` only revisions and those with conflicts. A document is indexed if every
    chunk that is searched has a vector; else it fails in INDEXING. Chunks whose ids are not
    unique make their documents fail in STRUCTURING. What is indexed is in force, or
    upcoming if its day is after ``today``.
    """
    rows = written(versions, "versions")
    entering = rows.where(F.col("pipeline_status").isin(*registry.ADVANCEABLE)).select("version_id")
    own = blocks.join(entering, "version_id", "left_semi")
    tree = written(structure.clause_tree(own), "tree")
    read = tree.select(*blocks.columns)
    parsed = tree.select("version_id").distinct()
    profiles = rows.select("version_id", "corpus_type")
    verdicts = written(quality.next_states(quality.gate(quality.indicators(quality.indicator_values(read, tree), profiles, thresholds))), "verdicts")
    passed = rows.join(verdicts.where("to_state = 'STRUCTURING'").select("version_id"), "version_id", "left_semi").select("version_id", "corpus_type", "title")
    chunks = written(structure.profile_chunks(read, passed, limits, tree, tables), "chunks")
    tags = obligations.tag_chunks(chunks)
    found = references.all_references(chunks, known, aliases)
    coded = cases.resolve_issuer(rows, issuers)
    passing = read.join(passed.select("version_id"), "version_id", "left_semi")
    extracted = cases.extracted_metadata(passing, passed.select("version_id", F.lit("").alias("title")), issuers)
    conflicts = written(cases.metadata_conflicts(extracted, coded.select("version_id", "doc_number", "issue_date", "issuer_code", "title")), "conflicts")
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    decisions = passing.join(passed.where("corpus_type = 'P-CASE'").select("version_id"), "version_id", "left_semi").where("kind <> 'table'")
    facts = cases.case_facts(decisions.groupBy("version_id").agg(F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text")).join(rows.select("version_id", "issuer"), "version_id"))

    outcome = lambda frame, state, to_state, failure=None: frame.select("version_id", F.lit(state).alias("state"), (F.lit(to_state) if isinstance(to_state, str) else to_state).cast("string").alias("to_state"), (F.lit(None) if failure is None else failure).cast("string").alias("failure"))
    clash = chunks.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select("chunk_id")
    clashing = chunks.join(clash, "chunk_id", "left_semi").select("version_id").distinct()
    checked = rows.join(passed.select("version_id"), "version_id", "left_semi").join(conflicts.select("version_id", F.lit(True).alias("_conflict")).distinct(), "version_id", "left")
    reason = F.when(F.col("_conflict"), REASONS["conflicts"]).when(F.col("supersedes_version_id").isNotNull(), REASONS["revision"]).otherwise(REASONS["plain"])
    checked = checked.withColumn("reason", reason)
    waits = F.lit(True) if not confirm_plain else F.col("reason") != REASONS["plain"]
    every = [
        outcome(rows, "REGISTERED", "PARSING"),
        outcome(rows.join(parsed.withColumn("_parsed", F.lit(True)), "version_id", "left"), "PARSING", F.when(F.col("_parsed"), "QC_PENDING").otherwise("PARSE_FAILED")),
        outcome(verdicts, "QC_PENDING", F.col("to_state")),
        outcome(checked, "STRUCTURING", F.when(waits, "META_REVIEW").otherwise("EMBEDDING")),
        outcome(clashing, "STRUCTURING", F.lit(None), F.lit("chunk ids are not unique")),
    ]
    if embed is not None:
        searched = chunks.where("NOT is_parent").select("chunk_id", "version_id", "text")
        bare = searched.join(embed(searched).select("chunk_id"), "chunk_id", "left_anti").groupBy("version_id").agg(F.count("*").alias("_n"))
        ends = rows.select("version_id", F.when(F.col("degraded"), "DEGRADED_INDEXED").otherwise("INDEXED").alias("_end"))
        every += [outcome(rows, "EMBEDDING", "INDEXING"), outcome(ends, "INDEXING", F.col("_end")), outcome(bare, "INDEXING", F.lit(None), F.concat(F.col("_n").cast("string"), F.lit(" chunks have no vector")))]
    outcomes = every[0]
    for more in every[1:]:
        outcomes = outcomes.unionByName(more)
    ran = written(run_until_idle(rows.select("version_id", "pipeline_status"), outcomes), "ran")
    indexed = F.col("pipeline_status").isin(*registry.INDEXED)
    states = ran.select("version_id", "pipeline_status").join(rows.select("version_id", "version_status", "effective_date"), "version_id").select("version_id", "pipeline_status", F.when(indexed, dates.live_status(F.col("effective_date"), today)).otherwise(F.col("version_status")).alias("version_status"))
    error = F.when(F.col("to_state") == "PARSE_FAILED", PARSE_FAILED).when(F.col("to_state") == "QC_FAILED", GATE_FAILED).alias("error_code")
    events = ran.select("version_id", F.posexplode("steps").alias("seq", "_s")).select("version_id", "seq", "_s.*").select("*", error)
    reached = events.select("version_id", "to_state")
    at = lambda state: reached.where(F.col("to_state") == state).select("version_id")
    item = lambda frame, kind, why: frame.select("version_id", F.lit(kind).alias("queue_type"), why.alias("reason"))
    queue = item(at("PARSE_FAILED"), "qc_fix", F.lit(REASONS["parse"])).unionByName(item(at("QC_FAILED"), "qc_fix", F.lit(REASONS["gate"]))).unionByName(item(at("META_REVIEW").join(checked.select("version_id", "reason"), "version_id"), "meta_confirm", F.col("reason")))
    failures = ran.where("failure IS NOT NULL").select("version_id", F.col("failed_in").alias("state"), "failure")
    live = states.where(indexed).select("version_id", F.col("version_status").alias("_live"))
    shown = rows.join(live, "version_id").withColumn("version_status", F.col("_live")).drop("_live")
    ranks = cases.issuer_rank(shown, issuers).select("version_id", "issuer_level")
    corpus = retrieval.corpus_rows(chunks, shown, ranks)
    return Batch(tree, chunks, found, tags, verdicts, conflicts, facts, corpus, states, events, queue, failures)
