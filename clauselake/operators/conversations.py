"""Conversations: paging, digests, sequence numbers and the question behind an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_of(conversations: DataFrame, *, page: int = 1, size: int = 20, title_like: str | None = None) -> DataFrame:
    """One page, newest first, with ``total_items`` and ``total_pages`` of all pages (counted at once)."""
    page, size = max(1, page), max(1, size)
    rows = conversations.where(F.lower("title").contains(title_like.lower())) if title_like else conversations
    total = rows.count()
    chosen = rows.orderBy(F.desc("updated_at"), "conversation_id").offset((page - 1) * size).limit(size)
    return chosen.withColumns({"total_items": F.lit(total).cast("long"), "total_pages": F.lit(-(-total // size)).cast("long")})


def summaries(messages: DataFrame) -> DataFrame:
    """(conversation_id, message_count, first_question, last_answer)."""
    return messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("seq"))).alias("first_question"), F.max_by(F.when(F.col("role") == "assistant", F.col("content")), F.when(F.col("role") == "assistant", F.col("seq"))).alias("last_answer"))


def paired(messages: DataFrame) -> DataFrame:
    """Assistant messages with the last user message before them."""
    before = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return messages.withColumn("question", asked).where("role = 'assistant'").select("conversation_id", "seq", "question", F.col("content").alias("answer"))


def append(messages: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` (conversation_id, ord, role, content) behind the messages so far, numbered on."""
    last = messages.groupBy("conversation_id").agg(F.max("seq").alias("_last"))
    numbered = fresh.join(last, "conversation_id", "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")))
    return messages.select("conversation_id", "seq", "role", "content").unionByName(numbered.select("conversation_id", "seq", "role", "content"))


def threads(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its messages in order."""
    told = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("messages"))
    return conversations.join(told, "conversation_id", "left")


def delete(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``ids``."""
    gone = ids.select("conversation_id").distinct()
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti")
