"""What a question asks for: scene, route, terms, and the question it continues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

from . import containment

# Words of each scene in order of precedence, and of other decisions.
SCENES = (
    ("behavior", ("是否违规", "违不违规", "违规吗", "是否合规", "能不能", "能否", "可不可以", "可以吗", "需不需要", "算不算", "是否需要", "是否可以")),
    ("statistical", ("高发", "统计", "多少起", "多少件", "排名", "占比", "几起", "数量分布", "处罚有哪些", "处罚有什么", "处罚都有哪些")),
    ("change", ("变更", "修订", "旧版", "什么时候改", "何时修订", "修改了", "历次修改")),
    ("case", ("类似案例", "类似的处罚", "类似处罚", "有没有案例", "相关案例", "处罚案例", "处罚先例")),
    ("enumerate", ("哪些制度", "列出所有", "列举", "有哪些规定", "哪些规定", "哪些要求", "所有关于")),
    ("definition", ("什么是", "是什么意思", "的定义", "是否等于", "等于")),
)
ROUTES = {"evidence": "evidence", "behavior": "judgmental", "definition": "evidence", "enumerate": "enumerate", "change": "change", "case": "case", "statistical": "statistical"}
OFF_DOMAIN = ("天气", "笑话", "股票", "彩票", "基金推荐", "午饭", "吃什么", "唱歌", "讲个")
ANCHORS = ("制度", "规定", "办法", "条款", "报销", "违规", "合规", "处罚", "义务", "备案", "披露", "投顾", "印章", "开户", "审计", "修订", "细则", "指引")
PRONOUNS = ("它呢", "这个", "那个", "他呢", "这条", "那条", "上面那个", "呢")
CONTINUES = ("它", "该", "这个", "那个", "这条", "那条", "上面那个", "上面那条")
DUTIES = ("要求", "义务", "必须", "应当", "禁止", "不得")
VERDICTS = ("违规", "违法", "合规", "合法")
TENTATIVE = ("可能违反", "疑似违规", "涉嫌", "倾向于不合规", "构成违")
MIN_LENGTH = 4


def scene(question: Column) -> Column:
    """The first scene any of whose words the question holds; evidence if none."""
    return F.coalesce(*[F.when(X.contains_any(question, words), F.lit(name)) for name, words in SCENES], F.lit("evidence"))


def route(question: Column) -> Column:
    """struct(route, confidence, reason): refuse what is off the domain, ask back what is too short, else by scene."""
    q = F.trim(F.coalesce(question, F.lit("")))
    off = X.contains_any(q, OFF_DOMAIN) & ~X.contains_any(q, ANCHORS)
    vague = (F.length(q) < MIN_LENGTH) | q.isin(*PRONOUNS)
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    form = lambda r, c, why: F.struct(r.alias("route"), c.alias("confidence"), why.alias("reason"))
    named = X.let(scene(q), lambda s: form(F.element_at(routes, s), F.when(s == "evidence", F.lit(0.6)).otherwise(F.lit(0.85)), F.concat(F.lit("scene="), s)))
    return F.when(off, form(F.lit("refuse"), F.lit(0.9), F.lit("off_domain"))).when(vague, form(F.lit("clarify"), F.lit(0.5), F.lit("ambiguous_or_too_short"))).otherwise(named)


def wants_duties(question: Column) -> Column:
    return X.contains_any(question, DUTIES)


def terms_in(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, terms): the dictionary's terms (ord, term) that each question holds, in order."""
    hits = containment.holding(questions, terms, "question", "term")
    return hits.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"])).alias("terms"))


def without_verdict(text: Column, neutral: str, tentative: bool = False) -> Column:
    """The text, or ``neutral`` if it pronounces on legality (or seems to, with ``tentative``)."""
    return F.when(X.contains_any(text, VERDICTS + (TENTATIVE if tentative else ())), F.lit(neutral)).otherwise(text)


def faithful(cited: Column, allowed: Column) -> Column:
    """Cited ids that were offered, each once, in order."""
    return F.array_distinct(F.filter(cited, lambda c: F.array_contains(allowed, c)))


def marked_ids(prompt: Column, n: int = 3) -> Column:
    """The first distinct ids marked ``[[clause_id:X]]``, as the offline answerer picks them."""
    return F.slice(F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\[\[clause_id:([^\]]+)\]\]"), F.lit(1))), 1, n)


def merged_questions(messages: DataFrame) -> DataFrame:
    """User messages (conversation_id, seq, role, content, route) with what they ask in full.

    A question that answers a request to clarify, is short, or holds a word that points
    back is joined to the last question before it; others stay as they are.
    """
    order = Window.partitionBy("conversation_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    said = F.nullif(F.trim("content"), F.lit(""))
    last_user = F.last(F.when(F.col("role") == "user", said), ignorenulls=True).over(before)
    last_turn = F.last(F.when(F.col("role").isin("user", "assistant"), F.struct("role", "route")), ignorenulls=True).over(before)
    q = F.trim("content")
    clarified = (F.col("_turn.role") == "assistant") & (F.col("_turn.route") == "clarify")
    continues = F.coalesce(clarified, F.lit(False)) | (F.length(q) < MIN_LENGTH) | X.contains_any(q, CONTINUES)
    rows = messages.withColumns({"_last": last_user, "_turn": last_turn}).where("role = 'user'")
    return rows.select("conversation_id", "seq", "content", F.when(F.col("_last").isNotNull() & continues, F.concat_ws(" ", "_last", q)).otherwise(F.col("content")).alias("question"))


def sentences(text: Column) -> Column:
    """struct(complete array, tail): sentences that have ended, and what has not."""
    parts = F.split(text, r"(?<=[。！？!?；;\n])")
    ended = F.size(parts) > 0
    last = F.element_at(parts, -1)
    done = F.coalesce(last.rlike(r"[。！？!?；;\n]$"), F.lit(False))
    full = F.filter(F.when(done, parts).otherwise(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))), lambda p: p != "")
    return F.struct(F.when(ended, full).otherwise(F.array().cast("array<string>")).alias("complete"), F.when(done, F.lit("")).otherwise(last).alias("tail"))
