"""Registration of batches, document states and their events, review queues and version switches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauselake.functions import dates
from clauselake.sources import tables

# The manifest's columns, the formats taken in, states and their transitions.
MANIFEST = ("filename", "title", "doc_number", "issuer", "perm_tag", "corpus_type", "sub_type", "biz_domain", "issue_date", "effective_date", "supersedes")
FORMATS = ("docx", "pdf", "xlsx")
TRANSITIONS = {
    "REGISTERED": ("PARSING", "QUARANTINED"),
    "PARSING": ("QC_PENDING", "PARSE_FAILED", "QUARANTINED"),
    "PARSE_FAILED": ("QC_PENDING", "REJECTED"),
    "QC_PENDING": ("STRUCTURING", "QC_FAILED"),
    "QC_FAILED": ("QC_PENDING", "STRUCTURING", "DEGRADED_INDEXED", "REJECTED"),
    "STRUCTURING": ("META_REVIEW", "EMBEDDING"),
    "META_REVIEW": ("EMBEDDING", "REJECTED"),
    "EMBEDDING": ("INDEXING",),
    "INDEXING": ("INDEXED", "DEGRADED_INDEXED"),
    "INDEXED": (),
    "DEGRADED_INDEXED": (),
    "REJECTED": (),
    "QUARANTINED": ("PARSING", "REJECTED"),
}
RESET_FROM = ("INDEXED", "DEGRADED_INDEXED", "REJECTED", "PARSE_FAILED", "QC_FAILED", "QUARANTINED")
ADVANCEABLE = ("REGISTERED", "PARSING", "QC_PENDING", "STRUCTURING", "EMBEDDING", "INDEXING")
INDEXED = ("INDEXED", "DEGRADED_INDEXED")
FAILED = ("PARSE_FAILED", "QC_FAILED", "QUARANTINED", "REJECTED")
DISPOSITIONS = {"fix": "QC_PENDING", "degrade": "STRUCTURING", "reject": "REJECTED", "release": "PARSING", "approve": "EMBEDDING"}
QUEUE_DISPOSITIONS = {"qc_fix": ("fix", "degrade", "reject"), "quarantine": ("release", "reject"), "meta_confirm": ("approve", "reject")}
NODES = (
    ("S0", ("REGISTERED",)),
    ("S1", ("PARSING", "PARSE_FAILED", "QC_PENDING")),
    ("S2", ("QC_PENDING", "QC_FAILED", "QUARANTINED")),
    ("S3", ("STRUCTURING", "META_REVIEW")),
    ("S4", ("META_REVIEW", "EMBEDDING")),
    ("S5", ("EMBEDDING", "INDEXING", "INDEXED", "DEGRADED_INDEXED")),
)
QUEUE_NODES = {"qc_fix": "S2", "quarantine": "S2", "meta_confirm": "S4"}


# ---------------------------------------------------------------------------- registration


def check_manifest(columns: list[str]) -> None:
    """Raises unless the columns are those of a manifest, in any order; the whole batch is refused."""
    named = [c for c in columns if c]
    missing, extra = [c for c in MANIFEST if c not in named], [c for c in named if c not in MANIFEST]
    if missing or extra:
        raise ValueError(f"manifest columns don't match: missing {missing}, not known {extra}")


def parse_supersedes(cell: Column) -> Column:
    """struct(relation, targets) of a supersedes cell: none, revise_replace, abolish_only or merge."""
    raw = F.trim(F.coalesce(cell, F.lit("")))
    abolish = r"^(?i:abolish|废止)\s*[:：]\s*(.*)$"
    target = F.trim(F.regexp_extract(raw, abolish, 1))
    listed = F.filter(F.transform(F.split(raw, "[;,、]"), lambda t: F.trim(t)), lambda t: t != "")
    form = lambda relation, targets: F.struct(relation.alias("relation"), targets.alias("targets"))
    none = F.array().cast("array<string>")
    return (
        F.when(raw == "", form(F.lit("none"), none))
        .when(raw.rlike(abolish), form(F.lit("abolish_only"), F.when(target != "", F.array(target)).otherwise(none)))
        .otherwise(form(F.when(F.size(listed) >= 2, "merge").otherwise("revise_replace"), listed))
    )


def version_relations(manifest: DataFrame) -> DataFrame:
    """Adds relation and targets; a revision of a file that another row also replaces is a split."""
    parsed = manifest.withColumn("_s", parse_supersedes(F.col("supersedes"))).select(*manifest.columns, F.col("_s.relation").alias("relation"), F.col("_s.targets").alias("targets"))
    single = F.col("relation").isin("revise_replace", "abolish_only") & (F.size("targets") == 1)
    splits = parsed.where(single).groupBy(F.get("targets", F.lit(0)).alias("_target")).agg(F.count("*").alias("_claims")).where("_claims >= 2")
    joined = parsed.withColumn("_target", F.get("targets", F.lit(0))).join(splits, "_target", "left")
    return joined.withColumn("relation", F.when((F.col("relation") == "revise_replace") & F.col("_claims").isNotNull(), "split_replace").otherwise(F.col("relation"))).drop("_target", "_claims")


def chain_roots(links: DataFrame) -> DataFrame:
    """(node, root) for ``links`` (node, parent): where the chain of parents ends.

    Every node has one parent, and a root has none. Pointers are doubled, so a chain of n
    links takes log2(n) rounds, each written to the shared folder. Links that run in a
    circle raise.
    """
    current, rounds = tables.written(links.select("node", "parent", F.lit(True).alias("moved")), "chains"), 0
    most = math.ceil(math.log2(current.count() + 2)) + 1
    while not current.where("moved").isEmpty():
        if rounds > most:
            raise ValueError("the links run in a circle")
        above = current.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        current = tables.written(current.drop("moved").join(above, "parent", "left").select("node", F.coalesce("_above", "parent").alias("parent"), F.col("_above").isNotNull().alias("moved")), "chains")
        rounds += 1
    return current.select("node", F.col("parent").alias("root"))


def _predecessors(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """(_row, _prior, _inherited, _link) of stored rows whose target is known.

    The file replaced is one of the registry, or else one that an earlier row of the
    batch has stored; _link is set where a revision continues a document of the batch.
    """
    target = F.get("targets", F.lit(0))
    claims = stored.where(F.col("relation").isin("revise_replace", "abolish_only")).select("_row", "_own", "relation", target.alias("_target"))
    older = versions.groupBy(F.col("source_filename").alias("_target")).agg(F.min_by(F.struct("version_id", "logical_id"), "version_id").alias("_old"))
    peers = stored.select(F.col("filename").alias("_target"), F.col("_row").alias("_peer_row"), F.col("_own").alias("_peer"))
    found = claims.join(older, "_target", "left").join(peers, "_target", "left").withColumn("_peer", F.when(F.col("_peer_row") < F.col("_row"), F.col("_peer")))
    revises = F.col("relation") == "revise_replace"
    return found.select(
        "_row",
        "_own",
        F.coalesce("_old.version_id", "_peer").alias("_prior"),
        F.when(revises, F.col("_old.logical_id")).alias("_inherited"),
        F.when(revises & F.col("_old").isNull(), F.col("_peer")).alias("_link"),
    ).where("_prior IS NOT NULL")


def register_batch(manifest: DataFrame, files: DataFrame, versions: DataFrame, batch_id: str, order: str | None = None) -> DataFrame:
    """Decides every manifest row as if one were registered after the other: REGISTERED, QUARANTINED, DUPLICATE or MISSING.

    ``files``: (filename, content, format). ``versions``: the registry so far, with
    version_id, logical_id, source_hash, source_filename, title, doc_number. ``order``:
    a column with each row's distinct place in the manifest; without it, rows count as they
    are read. Returns a row per manifest row that names a file, with status, reason,
    error_code, source_hash, version_id, logical_id, relation and supersedes_version_id.

    Rows whose file is missing store nothing, nor do duplicates: content that the
    registry or an earlier row has. Reasons for quarantine, in order: format, no
    permission tag, title and number that the registry or an earlier stored row has with
    other content. A revision of a file of the registry, or of one that an earlier row
    stored, names it and inherits its logical id, so revisions of revisions within the
    batch share one; a row that only abolishes names it and has a logical id of its own. A
    target that comes later, or not at all, is none.
    """
    check_manifest([c for c in manifest.columns if c != order])
    placed = manifest.select(*MANIFEST, (F.col(order) if order else F.monotonically_increasing_id()).alias("_row")).na.fill("", [*MANIFEST])
    named = version_relations(placed).where("filename <> ''").join(files.select("filename", F.sha2("content", 256).alias("source_hash"), "format"), "filename", "left")
    rows = tables.written(named.withColumn("_own", F.substring(F.sha1(F.concat_ws("|", F.lit(batch_id), "filename", "source_hash")), 1, 26)), "manifest")
    known = versions.groupBy("source_hash").agg(F.min("version_id").alias("_known"))
    first = rows.where("source_hash IS NOT NULL").groupBy("source_hash").agg(F.min("_row").alias("_first"), F.min_by("_own", "_row").alias("_owner")).join(known, "source_hash", "left")
    stored = tables.written(rows.join(first.where("_known IS NULL").select(F.col("_first").alias("_row")), "_row", "left_semi"), "stored")
    titled = stored.where("title <> '' AND doc_number <> ''").select("title", "doc_number", "_row")
    kept = versions.where("title <> '' AND doc_number <> ''").select("title", "doc_number").distinct().withColumn("_twin", F.lit(True))
    earliest = titled.groupBy("title", "doc_number").agg(F.min("_row").alias("_earliest"))
    twins = titled.join(earliest.join(kept, ["title", "doc_number"], "left"), ["title", "doc_number"]).where("_twin OR _row > _earliest").select("_row", F.lit(True).alias("_twin"))
    prior = tables.written(_predecessors(stored, versions), "prior")
    roots = chain_roots(prior.where("_link IS NOT NULL").select(F.col("_own").alias("node"), F.col("_link").alias("parent")))
    inherited = prior.select(F.col("_own").alias("root"), F.col("_inherited").alias("_root_logical")).where("_root_logical IS NOT NULL")
    continued = roots.join(inherited, "root", "left").select(F.col("node").alias("_own"), F.coalesce("_root_logical", F.concat(F.lit("L"), "root")).alias("_continued"))
    logical = prior.join(continued, "_own", "left").select("_row", "_prior", F.coalesce("_inherited", "_continued").alias("_logical"))
    is_stored = stored.select("_row", F.lit(True).alias("_stored"))
    # Rows without a file have no hash, so they take no part in the join on it.
    there = rows.where("source_hash IS NOT NULL").join(first.select("source_hash", "_known", "_owner"), "source_hash")
    joined = there.unionByName(rows.where("source_hash IS NULL"), allowMissingColumns=True)
    for side in (is_stored, twins, logical):
        joined = joined.join(side, "_row", "left")
    fresh = F.coalesce("_stored", F.lit(False))
    reason = F.when(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False)), "format").when(F.col("perm_tag") == "", "no permission tag").when(F.col("_twin"), "suspected duplicate")
    status = F.when(F.col("source_hash").isNull(), "MISSING").when(~fresh, "DUPLICATE").when(reason.isNotNull(), "QUARANTINED").otherwise("REGISTERED")
    said = F.when(status == "QUARANTINED", reason).when(status == "DUPLICATE", "same content").when(status == "MISSING", "no such file")
    return joined.select(
        "filename",
        status.alias("status"),
        said.alias("reason"),
        F.when((reason == "format") & fresh, "E101").alias("error_code"),
        "source_hash",
        F.when(fresh, F.col("_own")).when(status == "DUPLICATE", F.coalesce("_known", "_owner")).alias("version_id"),
        F.when(fresh, F.coalesce("_logical", F.concat(F.lit("L"), "_own"))).alias("logical_id"),
        "relation",
        F.when(fresh, F.col("_prior")).alias("supersedes_version_id"),
        F.col("relation").isin("merge", "split_replace").alias("needs_review"),
        dates.iso_date(F.col("issue_date")).alias("issue_date"),
        dates.iso_date(F.col("effective_date")).alias("effective_date"),
        F.lit(batch_id).alias("batch_id"),
        "title",
        "doc_number",
        F.col("_row").alias("row"),
    )


def registered(decided: DataFrame) -> DataFrame:
    """The rows that a decided batch adds to the registry; ``version_relation`` only where a predecessor was found."""
    stored = decided.where(F.col("status").isin("REGISTERED", "QUARANTINED"))
    relation = F.when(F.col("supersedes_version_id").isNotNull(), F.col("relation")).alias("version_relation")
    return stored.select("version_id", "logical_id", "source_hash", F.col("filename").alias("source_filename"), "title", "doc_number", F.col("status").alias("pipeline_status"), relation, "supersedes_version_id", "batch_id")


def registration_events(decided: DataFrame, versions: DataFrame) -> DataFrame:
    """(version_id, from_state, to_state, error_code, filename, reason) of a decided batch; missing files leave none.

    What is stored comes from no state. A duplicate leaves an event of the version that
    has its content, from that version's state to the same, so the repeat can be traced.
    """
    known = versions.select("version_id", F.col("pipeline_status").alias("_known"))
    fresh = decided.where(F.col("status").isin("REGISTERED", "QUARANTINED"))
    repeats = decided.where("status = 'DUPLICATE'").select("version_id", "filename", "reason")
    states = known.unionByName(fresh.select("version_id", F.col("status").alias("_known")))
    none = F.lit(None).cast("string")
    first = fresh.select("version_id", none.alias("from_state"), F.col("status").alias("to_state"), "error_code", "filename", "reason")
    again = repeats.join(states, "version_id", "left").select("version_id", F.col("_known").alias("from_state"), F.col("_known").alias("to_state"), none.alias("error_code"), "filename", "reason")
    return first.unionByName(again)


def exact_duplicates(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(source_hash, kept, copies) for each content that several rows have; the smallest id is kept."""
    return docs.groupBy(F.sha2(content, 256).alias("source_hash")).agg(F.min(id_col).alias("kept"), F.count("*").alias("copies")).where("copies > 1")


# --------------------------------------------------------------------------------- states


def edges(spark: SparkSession) -> DataFrame:
    """Allowed transitions (from_state, to_state), resets to REGISTERED included; a few dozen rows."""
    pairs = [(a, b) for a, targets in TRANSITIONS.items() for b in targets] + [(a, "REGISTERED") for a in RESET_FROM]
    return spark.createDataFrame(pairs, "from_state string, to_state string")


def apply_transitions(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions with new states, events, refused) for wanted transitions (version_id, to_state, actor, error_code, detail).

    Refused: unknown documents and steps that are no edge, with the reason. One step a
    document is taken at a time.
    """
    current = wanted.join(versions.select("version_id", F.col("pipeline_status").alias("from_state")), "version_id", "left")
    legal = current.join(F.broadcast(edges(versions.sparkSession)).withColumn("_edge", F.lit(True)), ["from_state", "to_state"], "left")
    events = legal.where("_edge").drop("_edge")
    refused = legal.where("_edge IS NULL").withColumn("reason", F.when(F.col("from_state").isNull(), "unknown document").otherwise("illegal transition")).drop("_edge")
    steps = events.select("version_id", F.col("to_state").alias("_to"), F.col("error_code").alias("_error"))
    moved = versions.join(steps, "version_id", "left").withColumns({"pipeline_status": F.coalesce("_to", "pipeline_status"), "last_error_code": F.coalesce("_error", "last_error_code")}).drop("_to", "_error")
    return moved, events, refused


def replay_states(events: DataFrame) -> DataFrame:
    """Each event (version_id, id, to_state) with the state before it and whether the step is an edge.

    The state before is that of the document's previous event; a first event must be
    REGISTERED or QUARANTINED.
    """
    before = F.lag("to_state").over(Window.partitionBy("version_id").orderBy("id"))
    legal = F.broadcast(edges(events.sparkSession)).withColumn("_edge", F.lit(True))
    return (
        events.withColumn("from_state", before)
        .join(legal, ["from_state", "to_state"], "left")
        .withColumn("legal", F.coalesce("_edge", F.col("from_state").isNull() & F.col("to_state").isin("REGISTERED", "QUARANTINED")))
        .drop("_edge")
    )


def dispose(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (queue_id, disposition, operator) on queue items: outcome, target state and reason if refused."""
    pairs = [(q, d, DISPOSITIONS[d]) for q, allowed in QUEUE_DISPOSITIONS.items() for d in allowed]
    allowed = F.broadcast(queue.sparkSession.createDataFrame(pairs, "queue_type string, disposition string, to_state string"))
    joined = decisions.join(queue.select("queue_id", "queue_type", "version_id", "status"), "queue_id", "left").join(allowed, ["queue_type", "disposition"], "left")
    reason = (
        F.when(~F.col("disposition").isin(*DISPOSITIONS), "unknown disposition")
        .when(F.col("status").isNull(), "unknown item")
        .when(F.col("status") != "open", "item is closed")
        .when(F.col("to_state").isNull(), "not for this queue")
    )
    return joined.select("queue_id", "version_id", "queue_type", "disposition", "operator", "to_state", reason.alias("refused"), (reason.isNull() & (F.col("disposition") == "degrade")).alias("degrades"))


def node_of(state: Column) -> Column:
    """The first node whose states hold the value; queue types have nodes too."""
    return F.coalesce(*[F.when(state == q, F.lit(n)) for q, n in QUEUE_NODES.items()], *[F.when(state.isin(*states), F.lit(n)) for n, states in NODES])


def node_statuses(versions: DataFrame, events: DataFrame, queue: DataFrame) -> DataFrame:
    """A row for each document and node: status, event_count and the last event's id and error.

    Status is done, failed, waiting, running or pending.
    """
    nodes = F.explode(F.array(*[F.lit(n) for n, _ in NODES])).alias("node")
    counts = events.groupBy("version_id", node_of(F.col("to_state")).alias("node")).agg(F.count("*").alias("event_count"), F.max("id").alias("last_event"), F.max_by("error_code", "id").alias("last_error_code"))
    waiting = queue.where("status = 'open'").select("version_id", node_of(F.col("queue_type")).alias("node")).distinct().withColumn("_open", F.lit(True))
    state, node, here = F.col("pipeline_status"), F.col("node"), node_of(F.col("pipeline_status"))
    status = (
        F.when(state.isin(*INDEXED), "done")
        .when(state == "REJECTED", F.when(node == "S2", "failed").otherwise("done"))
        .when(here.isNull(), "pending")
        .when(node == here, F.when(F.col("_open"), "waiting").when(state.isin(*FAILED), "failed").when(state == "META_REVIEW", "waiting").otherwise("running"))
        .when(node < here, "done")
        .otherwise("pending")
    )
    return versions.select("version_id", "pipeline_status", nodes).join(counts, ["version_id", "node"], "left").join(waiting, ["version_id", "node"], "left").select("version_id", "node", status.alias("status"), F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_event", "last_error_code")


# ------------------------------------------------------------------------------- versions


def switch_versions(versions: DataFrame) -> DataFrame:
    """Retires what indexed versions in force supersede: superseded, or abolished if they only abolish."""
    new = versions.where(F.col("pipeline_status").isin(*INDEXED) & (F.col("version_status") == "effective") & F.col("supersedes_version_id").isNotNull())
    old = new.groupBy(F.col("supersedes_version_id").alias("version_id")).agg(F.when(F.min("version_relation") == "abolish_only", "abolished").otherwise("superseded").alias("_status"))
    return versions.join(old, "version_id", "left").withColumn("version_status", F.coalesce("_status", "version_status")).drop("_status")


def activate_due(versions: DataFrame, today: Column) -> DataFrame:
    """Puts upcoming versions whose day has come in force."""
    due = (F.col("version_status") == "upcoming") & (F.col("effective_date") <= today)
    return versions.withColumn("version_status", F.when(due, "effective").otherwise(F.col("version_status")))


def version_pairs(versions: DataFrame) -> DataFrame:
    """For each version the one in force of its logical document (else itself) and that one's predecessor."""
    current = versions.where("version_status = 'effective'").groupBy("logical_id").agg(F.min("version_id").alias("_current"))
    predecessor = versions.select(F.col("version_id").alias("current_id"), F.col("supersedes_version_id").alias("predecessor_id"))
    return versions.select("version_id", "logical_id").join(current, "logical_id", "left").select("version_id", F.coalesce("_current", "version_id").alias("current_id")).join(predecessor, "current_id", "left").select("version_id", "current_id", "predecessor_id")


def clause_texts(chunks: DataFrame) -> DataFrame:
    """One text per version and clause path: its chunks in order."""
    usable = chunks.where("NOT is_parent AND NOT degraded AND clause_path_norm IS NOT NULL")
    lines = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "text")))
    return usable.groupBy("version_id", "clause_path_norm").agg(F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"), F.min_by("chunk_id", F.struct("seq", "chunk_id")).alias("first_chunk_id"))


def clause_changes(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Clauses added, removed or changed from predecessor to current version.

    ``pairs``: (current_id, predecessor_id). Returns both ids, clause_path_norm, kind,
    old_text, new_text and the new text's first chunk.
    """
    texts = clause_texts(chunks)
    keys = ["current_id", "predecessor_id", "clause_path_norm"]
    both = pairs.where("predecessor_id IS NOT NULL").select("current_id", "predecessor_id").distinct()
    new = both.join(texts.withColumnsRenamed({"version_id": "current_id", "text": "new_text"}), "current_id")
    old = both.join(texts.drop("first_chunk_id").withColumnsRenamed({"version_id": "predecessor_id", "text": "old_text"}), "predecessor_id")
    kind = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").otherwise("changed")
    return new.join(old, keys, "full_outer").where("NOT (old_text <=> new_text)").select(*keys, kind.alias("kind"), "old_text", "new_text", "first_chunk_id")
