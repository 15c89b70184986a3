"""References in chunk text: within a document, across documents, and from cases to clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

_C = X.NUMERAL
_CLAUSE = rf"第[{_C}\d]+条(?:之[{_C}\d]+)?"
# Fixed values: (type, kind, surface) of what points inside a document; the first is a pattern.
INTERNAL = (
    ("R3", "clause", _CLAUSE),
    ("R1", "document", "本办法"),
    ("R1", "document", "本规定"),
    ("R1", "document", "本细则"),
    ("R1", "document", "本指引"),
    ("R1", "document", "本制度"),
    ("R1", "document", "本通知"),
    ("R1", "document", "本条例"),
    ("R1", "document", "本规则"),
    ("R1", "article", "本条"),
    ("R1", "chapter", "本章"),
    ("R2", "previous", "前条"),
    ("R2", "paragraph", "上述各款"),
)
_TITLE = r"《[^》《]+》"
_YEAR = r"[〔\[]\d{4}[〕\]]"
#: Every surface in one pass, longer words first; a paragraph above has a number or none.
_ANY = "|".join([_CLAUSE, *sorted((w for _, _, w in INTERNAL[1:]), key=len, reverse=True), f"前[{_C}]*款"])


def _kinds(match: Column) -> Column:
    """What a surface found by _ANY points to; a word that starts with a shorter one of the table is both."""
    row = lambda ref_type, kind, end, surface: F.struct(F.lit(ref_type).alias("ref_type"), F.lit(kind).alias("kind"), match["start"].alias("start"), end.alias("end"), surface.alias("surface"))
    surface = match["surface"]
    words = [F.when(surface.startswith(w), row(t, kind, match["start"] + len(w), F.lit(w))) for t, kind, w in INTERNAL[1:]]
    clause = F.when(surface.startswith("第"), row("R3", "clause", match["end"], surface))
    above = F.when(surface.startswith("前") & surface.endswith("款"), row("R2", "paragraph", match["end"], surface))
    return F.array_compact(F.array(clause, *words, above))


def spans(text: Column, pattern: str) -> Column:
    """array<struct(start, end, surface)> of all matches, in characters.

    A match is where its surface comes first behind the match before: earlier, the pattern
    would have matched there. So patterns must not look ahead or behind.
    """
    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")

    def add(acc: Column, surface: Column) -> Column:
        last = F.call_function("locate", surface, text, acc["at"] + 1) - 1 + F.length(surface)
        return F.struct(last.alias("at"), F.array_append(acc["found"], F.struct((last - F.length(surface)).alias("start"), last.alias("end"), surface.alias("surface"))).alias("found"))

    surfaces = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.coalesce(F.aggregate(surfaces, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"], none)


def _body_start() -> Column:
    """Where the text goes on behind the breadcrumb."""
    return F.when(F.col("breadcrumb") != "", F.length("breadcrumb") + 1).otherwise(0)


def _found(chunks: DataFrame, pattern: str, *more: str) -> DataFrame:
    """Matches behind the breadcrumb of each chunk."""
    rows = chunks.withColumn("_body", _body_start())
    return rows.select("chunk_id", "version_id", "clause_path_norm", *more, "_body", F.inline(spans(F.col("text"), pattern))).where("start >= _body").drop("_body")


def _tail(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _clause_no(surface: Column) -> Column:
    """The clause number of ``第X条之Y``."""
    parts = rf"第([{_C}\d]+)条(?:之([{_C}\d]+))?$"
    return X.clause_number(F.concat_ws("之", F.regexp_extract(surface, parts, 1), F.nullif(F.regexp_extract(surface, parts, 2), F.lit(""))))


def _clauses(chunks: DataFrame) -> DataFrame:
    """Clause chunks that references are read from and resolved against."""
    return chunks.where("NOT is_parent AND chunk_type = 'clause'")


def internal_references(chunks: DataFrame) -> DataFrame:
    """References within each document.

    Returns chunk_id, version_id, span_start, span_end, surface, ref_type, target_version_id,
    target_path, status. A chunk's own number is no reference. Of several paths with the
    number asked for, the smallest counts. Paragraphs cannot be resolved, as chunks have no
    paragraph bounds.
    """
    clauses = _clauses(chunks)
    paths = clauses.where("clause_path_norm <> ''").groupBy("version_id", "clause_path_norm").agg(F.min("emit_ord").alias("_ord"))
    by_tail = paths.groupBy("version_id", _tail(F.col("clause_path_norm")).alias("_no")).agg(F.min("clause_path_norm").alias("_target"))
    previous = paths.withColumn("_before", F.lag("clause_path_norm").over(Window.partitionBy("version_id").orderBy("_ord"))).drop("_ord")
    matches = F.flatten(F.transform(spans(F.col("text"), _ANY), _kinds))
    found = clauses.select("chunk_id", "version_id", "clause_path_norm", _body_start().alias("_body"), F.inline(matches)).where("start >= _body")
    # A row of its own, or the optimizer would read the number again in each filter and key.
    found = found.select("*", F.explode(F.array(F.when(F.col("kind") == "clause", _clause_no(F.col("surface"))))).alias("_no"))
    own = F.col("_no").eqNullSafe(_tail(F.col("clause_path_norm")))
    joined = found.where((F.col("kind") != "clause") | (F.col("_no").isNotNull() & ~own)).join(by_tail, ["version_id", "_no"], "left").join(previous, ["version_id", "clause_path_norm"], "left")
    target = (
        F.when(F.col("kind") == "clause", F.col("_target"))
        .when(F.col("kind") == "article", F.nullif("clause_path_norm", F.lit("")))
        .when((F.col("kind") == "chapter") & F.col("clause_path_norm").contains("/"), F.split("clause_path_norm", "/")[0])
        .when(F.col("kind") == "previous", F.col("_before"))
    )
    rows = joined.withColumn("target_path", target)
    resolved = F.col("target_path").isNotNull() | (F.col("kind") == "document")
    return rows.select("chunk_id", "version_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "surface", "ref_type", F.col("version_id").alias("target_version_id"), "target_path", F.when(resolved, "resolved").otherwise("unresolved").alias("status"))


def cross_mentions(chunks: DataFrame) -> DataFrame:
    """Mentions of other documents: title, document number and clause number if given right behind.

    What follows a title is read in turn: brackets that hold a bracketed year, then a clause.
    """
    rest = lambda start: F.substr("text", start + 1)
    titles = _found(_clauses(chunks), _TITLE, "text")
    held = titles.withColumn("_in", F.regexp_extract(rest(F.col("end")), r"^[（(]([^）)]*)[）)]", 1))
    numbered = held.withColumn("doc_number", F.when(F.col("_in").rlike(_YEAR), F.col("_in")))
    behind = numbered.withColumn("_end", F.col("end") + F.when(F.col("doc_number").isNotNull(), F.length("doc_number") + 2).otherwise(0))
    read = behind.withColumn("clause_raw", F.nullif(F.regexp_extract(rest(F.col("_end")), f"^({_CLAUSE})", 1), F.lit("")))
    last = F.col("_end") + F.coalesce(F.length("clause_raw"), F.lit(0))
    return read.select(
        "chunk_id",
        "version_id",
        F.col("start").alias("span_start"),
        last.alias("span_end"),
        F.substr("text", F.col("start") + 1, last - F.col("start")).alias("surface"),
        F.expr("substr(surface, 2, length(surface) - 2)").alias("title"),
        "doc_number",
        "clause_raw",
    )


def resolve_documents(mentions: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds target_version_id and ``hit`` (single, multiple, none) to mentions.

    Tried in turn: document number, title, and what the title is an alias of, by number and
    by title. The first way with any hit decides; a document does not refer to itself.
    ``versions``: (version_id, doc_number, title, version_status), of which those in force
    count. ``aliases``: (alias, canonical_doc_number, canonical_title).
    """
    key = ["chunk_id", "span_start"]
    live = versions.where("version_status = 'effective'").select(F.col("version_id").alias("_hit"), F.col("doc_number").alias("_number"), F.col("title").alias("_title"))
    # Of several entries of an alias the one of the smallest number, then title, counts.
    first_alias = aliases.groupBy("alias").agg(F.min(F.struct("canonical_doc_number", "canonical_title")).alias("_a")).select("alias", "_a.*")
    named = mentions.select(*key, "version_id", "doc_number", "title").join(first_alias, F.col("title") == F.col("alias"), "left")
    way = lambda by, column: F.struct(F.lit(by).alias("by"), F.nullif(F.col(column), F.lit("")).alias("value"))
    asked = F.array(way("number", "doc_number"), way("title", "title"), way("number", "canonical_doc_number"), way("title", "canonical_title"))
    ways = named.select(*key, "version_id", F.posexplode(asked).alias("way", "_ask")).select(*key, "version_id", "way", "_ask.by", "_ask.value").where("value IS NOT NULL")
    known = live.select("_hit", F.lit("number").alias("by"), F.col("_number").alias("value")).unionByName(live.select("_hit", F.lit("title").alias("by"), F.col("_title").alias("value"))).where("value IS NOT NULL")
    # Two equal hits decide as much as a thousand: a value's hits are summed up before the join.
    known = known.groupBy("by", "value").agg(F.slice(F.array_sort(F.collect_set("_hit")), 1, 3).alias("_hits"))
    others = F.filter("_hits", lambda h: h != F.col("version_id"))
    hits = ways.join(known, ["by", "value"]).withColumn("_others", others).where(F.size("_others") > 0)
    first = hits.groupBy(*key).agg(F.min_by("_others", "way").alias("_others"))
    return mentions.join(first, key, "left").select("*", F.when(F.size("_others") == 1, F.get("_others", F.lit(0))).alias("target_version_id"), F.when(F.size("_others") == 1, "single").when(F.size("_others") > 1, "multiple").otherwise("none").alias("hit")).drop("_others")


def cross_references(chunks: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """References across documents, in the columns of ``internal_references``.

    Status: ambiguous (several documents), pending_target (none), resolved, or unresolved
    (the document has no such clause).
    """
    mentions = resolve_documents(cross_mentions(chunks), versions, aliases).withColumn("_no", _clause_no(F.col("clause_raw")))
    targets = chunks.where("clause_path_norm <> ''").groupBy(F.col("version_id").alias("target_version_id"), _tail(F.col("clause_path_norm")).alias("_no")).agg(F.min("clause_path_norm").alias("target_path"))
    status = F.when(F.col("hit") == "multiple", "ambiguous").when(F.col("hit") == "none", "pending_target").when(F.col("clause_raw").isNull() | F.col("target_path").isNotNull(), "resolved").otherwise("unresolved")
    return mentions.join(targets, ["target_version_id", "_no"], "left").select("chunk_id", "version_id", "span_start", "span_end", "surface", F.lit("R4").alias("ref_type"), "target_version_id", "target_path", status.alias("status"))


def all_references(chunks: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Both kinds; a clause number that stands inside a cross-document mention is part of it."""
    cross = cross_references(chunks, versions, aliases)
    inner = internal_references(chunks)
    outer = cross.select("chunk_id", F.col("span_start").alias("_a"), F.col("span_end").alias("_b"))
    inside = (F.lit("R3") == F.col("i.ref_type")) & (F.col("i.chunk_id") == F.col("o.chunk_id")) & (F.col("_a") <= F.col("i.span_start")) & (F.col("i.span_end") <= F.col("_b"))
    return inner.alias("i").join(outer.alias("o"), inside, "left_anti").unionByName(cross)


def render_glosses(text: Column, notes: Column, most: int = 30) -> Column:
    """Inserts 〖gloss〗 behind each annotated span, from the last to the first.

    ``notes``: array<struct(span_end, gloss, render)>; notes not to be rendered or without
    gloss are passed over, and a gloss is cut at ``most`` characters.
    """
    wanted = F.reverse(F.array_sort(F.filter(notes, lambda n: n["render"] & n["gloss"].isNotNull() & (n["gloss"] != ""))))
    return F.aggregate(wanted, text, lambda acc, n: F.concat(F.left(acc, n["span_end"]), F.lit("〖"), F.left(n["gloss"], F.lit(most)), F.lit("〗"), F.substr(acc, n["span_end"] + 1)))


# ------------------------------------------------------------------------ cases and clauses


def reference_key(doc_no: Column, path: Column) -> Column:
    """``number|path`` in normal form."""
    return F.concat_ws("|", X.normalise_doc_number(doc_no), X.normalise(path))


def align_citations(cited: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Aligns the regulations that cases cite with documents in force and their clauses.

    ``cited``: (case_id, ord, title, doc_number, clause). Documents are found by number,
    else by title, among external ones. Returns case_id, ord, doc_no, title,
    clause_path_norm, resolved. Documents and clauses grow with the register, and their size
    is not told by the files behind them, so none of the joins may broadcast them.
    """
    regs = versions.where("version_status = 'effective' AND corpus_type = 'P-EXT'")
    one = lambda column, name: regs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_{name}")).agg(F.min_by(F.struct("version_id", F.col("doc_number").alias("number")), "version_id").alias(f"_by_{name}"))
    core = F.split(F.regexp_replace(F.regexp_replace(X.normalise(F.col("clause")), "^第", ""), "条之", "之"), "条")[0]
    found = (
        # Rows without a number meet none, and are dealt by their title.
        cited.join(one("doc_number", "number").hint("merge"), (F.coalesce("doc_number", "title") == F.col("_number")) & F.col("doc_number").isNotNull(), "left")
        .join(one("title", "title").hint("merge"), F.col("title") == F.col("_title"), "left")
        .withColumn("_doc", F.coalesce("_by_number", "_by_title"))
        .withColumn("_no", F.when(F.coalesce(F.col("clause"), F.lit("")) != "", X.clause_number(core)))
        .withColumn("_target", F.col("_doc.version_id"))
    )
    tails = chunks.where("clause_path_norm <> ''").groupBy(F.col("version_id").alias("_target"), _tail(F.col("clause_path_norm")).alias("_no")).agg(F.min("clause_path_norm").alias("clause_path_norm"))
    whole = F.coalesce(F.col("clause"), F.lit("")) == ""
    return found.join(tails.hint("merge"), ["_target", "_no"], "left").select("case_id", "ord", F.when(F.col("_doc").isNull(), F.col("doc_number")).otherwise(F.col("_doc.number")).alias("doc_no"), "title", "clause_path_norm", (F.col("_doc").isNotNull() & (whole | F.col("clause_path_norm").isNotNull())).alias("resolved"))


def citation_arrays(aligned: DataFrame) -> DataFrame:
    """One row a case: the aligned entries in order, and whether any is unresolved."""
    entry = F.struct("ord", "doc_no", "title", "clause_path_norm", "resolved")
    return aligned.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["doc_no"].alias("doc_no"), e["title"].alias("title"), e["clause_path_norm"].alias("clause_path_norm"), e["resolved"].alias("resolved"))).alias("cited_regulations"), (~F.min("resolved")).alias("ref_unresolved"))


def bridge_index(cases: DataFrame) -> DataFrame:
    """The inverted index (key, case_id) of cited clauses, each pair once."""
    entries = cases.select("case_id", F.explode("cited_regulations").alias("e")).where("e.doc_no IS NOT NULL OR e.clause_path_norm IS NOT NULL")
    return entries.select(reference_key(F.col("e.doc_no"), F.col("e.clause_path_norm")).alias("key"), "case_id").distinct()


def cases_for_clauses(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Cases that cite any of ``keys`` (ord, key): (case_id, ord), each case at its first key."""
    return keys.join(index, "key").groupBy("case_id").agg(F.min("ord").alias("ord"))


def cited_clauses(cases: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk behind each resolved citation of a case: case_id, key, chunk_id."""
    entries = cases.select("case_id", F.explode("cited_regulations").alias("e")).where("e.clause_path_norm IS NOT NULL").select("case_id", X.normalise_doc_number(F.col("e.doc_no")).alias("_number"), F.col("e.clause_path_norm").alias("clause_path_norm")).distinct()
    live = versions.where("version_status = 'effective'").groupBy(X.normalise_doc_number(F.col("doc_number")).alias("_number")).agg(F.min("version_id").alias("version_id"))
    first = chunks.where("NOT is_parent AND NOT degraded").groupBy("version_id", "clause_path_norm").agg(F.min_by("chunk_id", F.struct("seq", "chunk_id")).alias("chunk_id"))
    # Chunks are many more than the file behind them tells, so they are not to be broadcast.
    known = live.join(first.hint("merge"), "version_id").select("_number", "clause_path_norm", "chunk_id")
    return entries.join(known.hint("merge"), ["_number", "clause_path_norm"]).select("case_id", F.concat_ws("|", "_number", "clause_path_norm").alias("key"), "chunk_id")
