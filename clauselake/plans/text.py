"""Queries of the text operators, over ``documents`` in the shape of regulations and texts made from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.functions import dates, text as X
from clauselake.operators import cases, ingest, obligations, quality, references, registry, routing, structure
from clauselake.sources.corpus import REGULATION_SQL, chinese, regulation_lines, table
from clauselake.sources.tables import written

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regulation_lines(table(spark, sf_dir, "documents"))


def _pick(words: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))).cast("int"))


# ------------------------------------------------------------------------------ expressions


@query("SELECT p_partkey, p_partkey % 9999 + 1 AS value, (p_partkey % 9999 + 1) || '-' || (p_partkey % 7 + 1) AS inserted FROM part")
def text_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 9999 + 1
    return table(spark, sf_dir, "part").select("p_partkey", X.chinese_to_int(chinese(n)).alias("value"), X.clause_number(F.concat(chinese(n), F.lit("之"), chinese(F.col("p_partkey") % 7 + 1))).alias("inserted"))


_SOLID = "regexp_replace(coalesce(text, ''), '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]', '', 'g')"


@query(f"""SELECT doc_id, length({_SOLID}) AS tokens, CASE WHEN length(trim(coalesce(text, ''))) <= 120 THEN trim(coalesce(text, '')) ELSE rtrim(substr(trim(text), 1, 120)) || '…' END AS excerpt,
  sha1('d' || doc_id || '|1/2|' || (doc_id % 3))[:24] AS chunk_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 40) || right(text, 20) END AS ends FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.count_tokens(t).cast("long").alias("tokens"), X.excerpt(t, 120).alias("excerpt"), X.chunk_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("1/2"), F.col("doc_id") % 3).alias("chunk_id"), X.head_and_tail(t, 40, 20).alias("ends"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 100 THEN text ELSE left(text, list_max(list_filter(range(101), lambda k: octet_length(encode(left(text, k))) <= 100))) END AS cut FROM documents""")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_bytes(F.col("text"), 100).alias("cut"))


@query("""SELECT c_custkey, CAST(('0x' || sha1(c_name)[:8]) AS BIGINT) / 4294967295.0 < 0.25 AS sampled FROM customer""")
def text_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.sampled(F.col("c_name"), 0.25).alias("sampled"))


@query("""WITH c AS (SELECT s_suppkey, (['', 'a.pdf', '废止：b.pdf', 'abolish: c.pdf', 'd;e、f', 'g,h'])[1 + s_suppkey % 6] AS cell FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'revise_replace' WHEN 2 THEN 'abolish_only' WHEN 3 THEN 'abolish_only' ELSE 'merge' END AS relation,
  CASE s_suppkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['a.pdf'] WHEN 2 THEN ['b.pdf'] WHEN 3 THEN ['c.pdf'] WHEN 4 THEN ['d', 'e', 'f'] ELSE ['g', 'h'] END AS targets FROM c""")
def text_supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _pick(("", "a.pdf", "废止：b.pdf", "abolish: c.pdf", "d;e、f", "g,h"), F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", registry.parse_supersedes(cell).alias("s")).select("s_suppkey", "s.relation", "s.targets")


_QUESTIONS = ("这样做是否违规", "2020年以来处罚有哪些", "投顾办法修订了什么", "有没有案例", "哪些制度规定了印章", "什么是适当性", "信息披露要求", "今天天气如何", "呢", "天气对披露的规定")
_ROUTES = (("judgmental", 0.85), ("statistical", 0.85), ("change", 0.85), ("case", 0.85), ("enumerate", 0.85), ("evidence", 0.85), ("evidence", 0.6), ("refuse", 0.9), ("clarify", 0.5), ("evidence", 0.6))


@query(f"""SELECT c_custkey, ({[r for r, _ in _ROUTES]})[1 + c_custkey % 10] AS route, CAST(({[c for _, c in _ROUTES]})[1 + c_custkey % 10] AS DOUBLE) AS confidence, c_custkey % 10 = 6 AS duties FROM customer""")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _pick(_QUESTIONS, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", routing.route(q).alias("r"), routing.wants_duties(q).alias("duties")).select("c_custkey", "r.route", "r.confidence", "duties")


@query("""WITH m AS (SELECT conv_id AS conversation_id, turn AS seq, role, text, trim(text) AS q,
  last_value(CASE WHEN role = 'user' THEN nullif(trim(text), '') END IGNORE NULLS) OVER w AS prior FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conversation_id, seq, text AS content, CASE WHEN prior IS NOT NULL AND (length(q) < 4 OR regexp_matches(q, '它|该|这个|那个|这条|那条')) THEN prior || ' ' || q ELSE text END AS question FROM m WHERE role = 'user'""")
def question_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.sources.corpus import conversation_messages

    return routing.merged_questions(conversation_messages(spark, sf_dir))


# -------------------------------------------------------------------------------- structure

_HEADS = f"""{REGULATION_SQL},
heads AS (
  SELECT version_id, idx, text, page,
    CASE WHEN idx % 12 = 0 THEN 1 WHEN idx % 12 = 6 THEN 2 WHEN idx % 3 = 1 THEN 3 WHEN idx % 12 = 5 THEN 5 WHEN idx % 12 = 8 THEN 6 END AS level,
    CASE WHEN idx % 12 IN (0, 6) THEN CAST(idx // 12 + 1 AS VARCHAR) WHEN idx % 3 = 1 THEN CAST(idx // 3 + 1 AS VARCHAR) WHEN idx % 12 = 5 THEN '2' WHEN idx % 12 = 8 THEN '3' END AS number,
    CASE WHEN idx % 12 = 5 THEN '(二)' WHEN idx % 12 = 8 THEN '③' WHEN idx % 12 IN (0, 6) OR idx % 3 = 1 THEN regexp_extract(text, '^第[一二三四五六七八九十百千]+[章节条]') END AS label
  FROM blocks
)"""


@query(f"WITH {_HEADS} SELECT version_id, idx, level, number, label FROM heads WHERE level IS NOT NULL")
def structure_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("version_id", "idx", X.heading(F.col("text")).alias("h")).where("h IS NOT NULL").select("version_id", "idx", "h.level", "h.number", "h.label")


# Runs of lines that end in a page number, and chapters or sections without an article behind
# them, are tables of contents.
_TREE = f"""{_HEADS},
marked AS (SELECT *, regexp_matches(text, '[.．·…]{{4,}}') AS leader, regexp_matches(text, '[.．·…]{{4,}}') OR regexp_matches(text, '\\S\\s+[0-9]{{1,4}}\\s*$') AS cand FROM heads),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY version_id, cand ORDER BY idx) AS run,
  min(CASE WHEN level <= 1 THEN idx END) OVER f AS next1, min(CASE WHEN level <= 2 THEN idx END) OVER f AS next2, min(CASE WHEN level = 3 THEN idx END) OVER f AS next3
  FROM marked WINDOW f AS (PARTITION BY version_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
toc AS (SELECT *, (cand AND (count(*) OVER (PARTITION BY version_id, cand, run) >= 3 OR bool_or(leader) OVER (PARTITION BY version_id, cand, run)))
  OR coalesce(level IN (1, 2) AND (next3 IS NULL OR CASE level WHEN 1 THEN next1 ELSE next2 END <= next3), FALSE) AS is_toc FROM runs),
kept AS (SELECT version_id, idx, text, page, CASE WHEN NOT is_toc THEN level END AS level, number, label FROM toc),
opened AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN idx END) OVER u AS i{k}" for k in range(1, 7))},
  {", ".join(f"last_value(CASE WHEN level = {k} THEN number END IGNORE NULLS) OVER u AS n{k}" for k in range(1, 7))}, {", ".join(f"last_value(CASE WHEN level = {k} THEN label END IGNORE NULLS) OVER u AS l{k}" for k in range(1, 7))}
  FROM kept WINDOW u AS (PARTITION BY version_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tree AS (SELECT version_id, idx, text, page, level, number, CASE WHEN i2 > coalesce(i1, -1) THEN i2 END AS section_idx,
  concat_ws('/', {", ".join(f"CASE WHEN i{k} > greatest(-1, {', '.join(f'coalesce(i{j}, -1)' for j in range(1, k)) or '-1'}) THEN n{k} END" for k in range(1, 7))}) AS path_norm,
  concat_ws(' > ', {", ".join(f"CASE WHEN i{k} > greatest(-1, {', '.join(f'coalesce(i{j}, -1)' for j in range(1, k)) or '-1'}) THEN l{k} END" for k in range(1, 7))}) AS path,
  CASE WHEN i3 > greatest(coalesce(i1, -1), coalesce(i2, -1)) THEN i3 END AS article_idx FROM opened)"""


@query(f"WITH {_TREE} SELECT version_id, idx, level, path, path_norm, article_idx FROM tree")
def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.clause_tree(_blocks(spark, sf_dir)).select("version_id", "idx", "level", "path", "path_norm", "article_idx")


@query()
def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.clause_chunks(_blocks(spark, sf_dir), limits=structure.ChunkLimits(60, 200, 600))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = regulation_lines(table(spark, sf_dir, "documents"))
    mark = F.when(F.col("idx") % 4 == 1, "问：").when((F.col("idx") % 4 == 2) & (F.col("idx") % 3 > 0), "答：").otherwise("")
    return lines.withColumn("text", F.concat(mark, F.lit("甲"), F.col("idx").cast("string")))


@query("""WITH l AS (SELECT doc_id AS version_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS idx FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT *, idx % 4 = 1 AS q, idx % 4 = 2 AND idx % 3 > 0 AS a, (idx + 3) // 4 AS ord FROM l WHERE idx > 0),
g AS (SELECT version_id, ord, '甲' || min(idx) AS question, bool_or(a) AS answered, string_agg('甲' || idx, chr(10) ORDER BY idx) FILTER (idx % 4 <> 1) AS rest FROM m GROUP BY 1, 2)
SELECT version_id, '问答/' || row_number() OVER (PARTITION BY version_id ORDER BY ord) AS clause_path, question || chr(10) || '问:' || question || chr(10) || '答:' || rest AS text FROM g WHERE answered""")
def structure_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.question_chunks(_questions(spark, sf_dir)).select("version_id", "clause_path", "text")


# ------------------------------------------------------------------------------------- tags

_W = obligations.ObligationWords()
_PLAIN = [m for m in _W.markers if m[0] not in _W.bare]
_MARKER_SQL = (
    "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{m}'" for m in _PLAIN) + " ELSE nullif(regexp_extract(regexp_replace(text, '" + "|".join(_W.exclusions) + "', '＊', 'g'), '应当|应该|应予|须经|应|须'), '') END"
)


@query(f"WITH {REGULATION_SQL}, m AS (SELECT version_id, idx, {_MARKER_SQL} AS marker FROM blocks) SELECT version_id, idx, marker, CASE WHEN marker IN ('不得', '禁止', '严禁', '不应', '不准') THEN 'prohibition' WHEN marker = '责令' THEN 'command' ELSE 'obligation' END AS deontic FROM m WHERE marker IS NOT NULL")
def tags_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _blocks(spark, sf_dir).select("version_id", "idx", obligations.obligation_marker(F.col("text")).alias("marker"))
    return marked.where("marker IS NOT NULL").withColumn("deontic", obligations.deontic_class(F.col("marker")))


@query(f"""WITH {REGULATION_SQL}, f AS (SELECT version_id, idx, text, regexp_extract(text, '([0-9]+|[〇零一二两三四五六七八九十百千]+)\\s*个?\\s*(工作日|自然日|日|天|月|季|年)') AS s, strpos(text, '半年') AS h FROM blocks)
SELECT version_id, idx, CASE WHEN h > 0 AND (s = '' OR h < strpos(text, s)) THEN '半年' WHEN s <> '' THEN s ELSE '次年' END AS surface,
  CAST(CASE WHEN h > 0 AND (s = '' OR h < strpos(text, s)) THEN 180 WHEN s = '三十日' THEN 30 WHEN s = '5个工作日' THEN 5 WHEN s = '两个月' THEN 60 END AS BIGINT) AS days FROM f WHERE s <> '' OR h > 0 OR contains(text, '次年')""")
def tags_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir).select("version_id", "idx", dates.duration(F.col("text")).alias("d")).where("d IS NOT NULL")
    return found.select("version_id", "idx", "d.surface", "d.days")


@query()
def tags_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obligations.tag_chunks(structure_chunks(spark, sf_dir))


# ------------------------------------------------------------------------------- references


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, one a line item of an order, that refer to others by number, title and place."""
    n = F.col("l_linenumber")
    refers = F.when(n == 1, "见第三条和前条").when(n == 2, F.concat(F.lit("《t"), (F.col("l_partkey") % 50).cast("string"), F.lit("》第二条之一"))).when(n == 3, "本办法本条，第九条").otherwise("本章无")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version_id"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    path = F.concat(F.lit("第一章 > 第"), chinese(n), F.lit("条"))
    return lines.select(F.concat_ws("-", "version_id", n).alias("chunk_id"), "version_id", F.concat_ws("\n", path, F.concat(F.lit("第"), chinese(n), F.lit("条 "), refers)).alias("text"), path.alias("breadcrumb"), F.concat(F.lit("1/"), n.cast("string")).alias("clause_path_norm"), n.alias("emit_ord"), n.alias("seq"), F.lit(False).alias("is_parent"), F.lit("clause").alias("chunk_type"), F.lit(False).alias("degraded"))


_REFERRING_SQL = "c AS (SELECT l_orderkey AS v, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_REFERRING_SQL}, prev AS (SELECT v, n, lag(n) OVER (PARTITION BY v ORDER BY n) AS b FROM c),
r AS (
  SELECT v, n, '第三条' AS surface, 'R3' AS ref_type, CASE WHEN EXISTS (FROM c x WHERE x.v = c.v AND x.n = 3) THEN '1/3' END AS target, NULL AS fixed FROM c WHERE n = 1
  UNION ALL SELECT v, n, '前条', 'R2', '1/' || b, NULL FROM prev WHERE n = 1
  UNION ALL SELECT v, n, '第二条之一', 'R3', NULL, NULL FROM c WHERE n = 2
  UNION ALL SELECT v, n, '本办法', 'R1', NULL, 'resolved' FROM c WHERE n = 3
  UNION ALL SELECT v, n, '本条', 'R1', '1/3', NULL FROM c WHERE n = 3
  UNION ALL SELECT v, n, '第九条', 'R3', NULL, NULL FROM c WHERE n = 3
  UNION ALL SELECT v, n, '本章', 'R1', '1', NULL FROM c WHERE n > 3)
SELECT v || '-' || n AS chunk_id, surface, ref_type, target AS target_path, coalesce(fixed, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END) AS status FROM r""")
def references_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.internal_references(_referring(spark, sf_dir)).select("chunk_id", "surface", "ref_type", "target_path", "status")


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    versions = orders.select(F.col("o_orderkey").alias("version_id"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("doc_number"), F.when(F.col("o_orderkey") <= 45, F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") <= 48, "t46").alias("title"), F.lit("effective").alias("version_status"))
    aliases = orders.where("o_orderkey = 49").select(F.lit("t49").alias("alias"), F.lit("n7").alias("canonical_doc_number"), F.lit("").alias("canonical_title"))
    return versions, aliases


@query(f"""WITH {_REFERRING_SQL}, r AS (SELECT *, p % 50 AS t, CASE WHEN p % 50 = 49 THEN 7 ELSE p % 50 END AS hit FROM c WHERE n = 2),
known AS (SELECT o_orderkey AS k FROM orders),
s AS (SELECT r.*, (SELECT count(*) FROM known WHERE k <> r.v AND CASE WHEN r.hit = 46 THEN k BETWEEN 46 AND 48 WHEN r.hit <= 45 THEN k = r.hit ELSE FALSE END) AS hits FROM r)
SELECT v || '-' || n AS chunk_id, '《t' || t || '》第二条之一' AS surface, CASE WHEN hits = 1 THEN CASE WHEN hit = 46 THEN (SELECT min(k) FROM known WHERE k BETWEEN 46 AND 48 AND k <> v) ELSE hit END END AS target_version_id, CASE WHEN hits > 1 THEN 'ambiguous' WHEN hits = 0 THEN 'pending_target' ELSE 'unresolved' END AS status FROM s""")
def references_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.cross_references(_referring(spark, sf_dir), *_titled(spark, sf_dir)).select("chunk_id", "surface", "target_version_id", "status")


@query(f"""WITH {_REFERRING_SQL} SELECT CAST(sum(CASE n WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END) AS BIGINT) AS n, count(*) FILTER (n = 2) AS mentions, CAST(0 AS BIGINT) AS inside FROM c""")
def references_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of references once those inside a mention are left to it."""
    found = references.all_references(_referring(spark, sf_dir), *_titled(spark, sf_dir))
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("ref_type") == "R4").alias("mentions"), F.count_if((F.col("ref_type") == "R3") & (F.col("surface") == "第二条之一")).alias("inside"))


# ------------------------------------------------------------------------------------ cases


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    amount = F.when(k % 3 == 0, F.concat(F.floor(F.col("o_totalprice")).cast("string"), F.lit("元"))).otherwise(F.concat((k % 90 + 1).cast("string"), F.lit(".5万元")))
    text = F.concat(
        F.when(k % 4 > 0, "中国证监会北京监管局\n").otherwise("（无）\n"),
        F.concat(F.lit("京证监〔2024〕"), k.cast("string"), F.lit("号\n")),
        F.concat(F.lit("当事人："), F.lit("某某"), k.cast("string"), F.lit("公司，住所地某处。\n")),
        F.when(k % 5 == 0, "性别男\n").otherwise(""),
        F.lit("现决定给予警告，并处罚款"),
        amount,
        F.lit("。\n"),
        F.date_format(day, "yyyy年M月d日"),
    )
    return table(spark, sf_dir, "orders").select(k.alias("version_id"), text.alias("text"), F.lit("局").alias("issuer"))


@query("""SELECT o_orderkey AS version_id, CASE WHEN o_orderkey % 4 > 0 THEN '中国证监会' ELSE '局' END AS penalty_org, '京证监[2024]' || o_orderkey || '号' AS doc_number, CAST(o_orderdate AS DATE) AS penalty_date, '某某' || o_orderkey || '公司' AS respondent, '警告/罚款' AS penalty_type,
  CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) / 10000.0 ELSE o_orderkey % 90 + 1.5 END AS amount_wan, CASE WHEN o_orderkey % 5 = 0 THEN '个人' ELSE '机构' END AS respondent_type FROM orders""")
def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_facts(_decisions(spark, sf_dir)).withColumn("amount_wan", F.col("amount_wan").cast("double"))


@query("""WITH d AS (SELECT o_orderkey AS k, '当事人：某某' || o_orderkey || '公司，住所地某处。' || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '性别男' ELSE '' END AS party,
  '现决定给予警告，并处罚款' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '元' ELSE (o_orderkey % 90 + 1) || '.5万元' END || '。' || chr(10) || strftime(o_orderdate, '%Y年%-m月%-d日') AS fine FROM orders),
s AS (
  SELECT k, 1 AS n, '当事人' AS name, party AS body, 'case_section' AS kind FROM d UNION ALL SELECT k, 2, '处罚决定', fine, 'case_section' FROM d
  UNION ALL SELECT k, 3, '摘要', left('决定书 ' || party, 150), 'case_summary' FROM d),
t AS (SELECT *, '《决定书》 > ' || name AS crumb FROM s)
SELECT sha1(k || '|case/' || n || '|0')[:24] AS chunk_id, k AS version_id, '案例/' || name AS clause_path, 'case/' || n AS clause_path_norm, 0 AS seq, crumb || chr(10) || body AS text, crumb AS breadcrumb, 1 AS page_start, 1 AS page_end,
  CAST(length(regexp_replace(crumb || body, '\\s', '', 'g')) AS INTEGER) AS token_count, FALSE AS is_parent, FALSE AS is_table, FALSE AS oversize, kind AS chunk_type, CAST(NULL AS VARCHAR) AS parent_chunk_id, NULL AS internal_refs, CAST(n AS INTEGER) AS emit_ord FROM t""")
def case_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _decisions(spark, sf_dir)
    lines = docs.select("version_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")).select("version_id", "idx", F.lit("text").alias("kind"), "text", F.lit(1).alias("page"), F.lit(None).cast("int").alias("page_end"))
    return structure.case_chunks(lines, docs.select("version_id", F.lit("决定书").alias("title")))


@query("""SELECT o_orderkey AS version_id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['doc_number', 'issue_date'] ELSE ['issue_date'] END) AS field FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'doc_number' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0""")
def metadata_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _decisions(spark, sf_dir)
    lines = docs.select("version_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    issuers = docs.where("version_id = 1").select(F.lit("ISS01").alias("code"), F.lit("中国证监会").alias("name"))
    extracted = cases.extracted_metadata(lines, docs.select("version_id", F.lit("").alias("title")), issuers)
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    manifest = orders.select(k.alias("version_id"), F.when(k % 2 == 0, "京证监〔2023〕1号").otherwise(F.concat(F.lit("京证监〔2024〕"), k.cast("string"), F.lit("号"))).alias("doc_number"), F.when(k % 3 == 0, F.date_add(F.to_date("o_orderdate"), 1)).otherwise(F.to_date("o_orderdate")).alias("issue_date"), F.lit("ISS01").alias("issuer_code"), F.lit("x").alias("title"))
    return cases.metadata_conflicts(extracted, manifest).select("version_id", "field")


# ---------------------------------------------------------------------------------- quality


@query(f"""WITH {_TREE},
b AS (SELECT version_id, count(*) FILTER (level = 3) AS articles, count(*) FILTER (regexp_matches({_SOLID}, '^第[〇零一二两三四五六七八九十百千0-9A-Za-z.]+条')) AS loose FROM tree GROUP BY 1),
p AS (SELECT version_id, page, sum(length({_SOLID})) AS n FROM tree GROUP BY 1, 2),
d AS (SELECT version_id, least(1.0, sum(n) / max(page) / greatest(1, list_sort(list(n))[1 + count(*) // 2])) AS sufficiency FROM p GROUP BY 1)
SELECT version_id, CASE WHEN loose = 0 THEN 1.0 ELSE round(articles / loose, 6) END AS coverage, round(sufficiency, 6) AS sufficiency FROM b JOIN d USING (version_id)""")
def quality_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir).withColumns({"ocr_conf": F.lit(None).cast("double"), "table_empty": F.lit(False)})
    return quality.indicator_values(blocks).select("version_id", F.round("coverage", 6).alias("coverage"), F.round("sufficiency", 6).alias("sufficiency"))


@query()
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir).withColumns({"ocr_conf": F.lit(None).cast("double"), "table_empty": F.lit(False)})
    profiles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.when(F.col("doc_id") % 5 == 0, "P-CASE").otherwise("P-INT").alias("corpus_type"))
    return quality.next_states(quality.gate(quality.indicators(quality.indicator_values(blocks), profiles)))


_GARBLED = f"len(regexp_extract_all({_SOLID}, '[\\x{{fffd}}\\x{{00}}-\\x{{1f}}]'))"


def _indicator_sql(is_table: str = "FALSE", page: str = "page", ocr: str = "NULL", empty: str = "FALSE") -> str:
    """CTE ``ind``: every indicator of the regulation view's documents, no questions among them."""
    return f"""
lined AS (SELECT version_id, idx, text, {page} AS page, level, number, path, {is_table} AS is_table, {empty} AS is_empty, {ocr} AS ocr FROM tree),
kept_order AS (SELECT *, lag(CAST(number AS INTEGER)) OVER (PARTITION BY version_id, regexp_replace(path, '(^| > )[^>]*$', ''), level ORDER BY idx) AS before FROM lined WHERE level IN (1, 2, 3)),
wrong AS (SELECT version_id, count(*) AS disorder FROM kept_order WHERE CAST(number AS INTEGER) <= before GROUP BY 1),
base AS (
  SELECT version_id, count(*) FILTER (level = 3) AS articles, count(*) FILTER (regexp_matches({_SOLID}, '^第[〇零一二两三四五六七八九十百千0-9A-Za-z.]+条')) AS loose,
    coalesce(max(CAST(number AS INTEGER)) FILTER (level = 3) - min(CAST(number AS INTEGER)) FILTER (level = 3) + 1 - count(DISTINCT number) FILTER (level = 3), 0) AS gaps,
    count(*) FILTER (NOT is_table) AS texts, count(*) FILTER (NOT is_table AND page IS NOT NULL) AS anchored, count(*) FILTER (is_table) AS tables, count(*) FILTER (is_table AND is_empty) AS empties,
    sum({_GARBLED}) FILTER (NOT is_table) AS odd, sum(length({_SOLID})) FILTER (NOT is_table) AS chars, avg(ocr) FILTER (NOT is_table) AS ocr_mean
  FROM lined GROUP BY 1),
paged AS (SELECT version_id, page, sum(length({_SOLID})) AS n FROM lined WHERE page > 0 GROUP BY 1, 2),
dense_ AS (SELECT version_id, least(1.0, sum(n) / max(page) / greatest(1, list_sort(list(n))[1 + count(*) // 2])) AS sufficiency FROM paged GROUP BY 1),
ind AS (
  SELECT version_id, CASE WHEN loose = 0 THEN 1.0 ELSE articles / loose END AS coverage, gaps, coalesce(disorder, 0) AS disorder, CASE WHEN texts = 0 THEN 1.0 ELSE anchored / texts END AS anchors,
    CASE WHEN tables = 0 THEN 0.0 ELSE empties / tables END AS empty_tables, CASE WHEN coalesce(chars, 0) = 0 THEN 0.0 ELSE odd / chars END AS garbled, ocr_mean, coalesce(sufficiency, 0.0) AS sufficiency
  FROM base LEFT JOIN dense_ USING (version_id) LEFT JOIN wrong USING (version_id)),
checks AS (
  SELECT *, garbled <= 0.01 AND coalesce(ocr_mean >= 0.85, TRUE) AS clean,
    coverage >= 0.95 AND gaps <= 0 AND disorder <= 0 AND anchors >= 1 AND empty_tables <= 0.05 AND garbled <= 0.01 AND coalesce(ocr_mean >= 0.85, TRUE) AND sufficiency >= 0.7 AS clause_ok,
    (coverage >= 0.95 AND coverage <= 0.97) OR (empty_tables <= 0.05 AND empty_tables >= 0.03) OR (sufficiency >= 0.7 AND sufficiency <= 0.72) AS near FROM ind)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regulation view with tables, blocks without a page, and confidences."""
    i, v = F.col("idx"), F.col("version_id")
    return _blocks(spark, sf_dir).withColumns({
        "kind": F.when(i % 12 == 10, "table").otherwise("text"),
        "page": F.when((v % 6 == 1) & (i % 5 == 4), F.lit(None)).otherwise(F.col("page")),
        "ocr_conf": F.when(v % 4 == 2, F.lit(0.8) + (i % 10) / 100),
        "table_empty": i % 240 == 10,
    })


@query(f"""WITH {_TREE},{_indicator_sql("idx % 12 = 10", "CASE WHEN version_id % 6 <> 1 OR idx % 5 <> 4 THEN page END", "CASE WHEN version_id % 4 = 2 THEN 0.8 + (idx % 10) / 100 END", "idx % 240 = 10")},
told AS (SELECT *, version_id % 5 = 0 AS is_case, CASE WHEN version_id % 5 = 0 THEN clean AND anchors >= 1 ELSE clause_ok END AS passed FROM checks)
SELECT version_id, round(coverage, 6) AS coverage, CAST(gaps AS DOUBLE) AS gaps, CAST(disorder AS DOUBLE) AS disorder, round(anchors, 6) AS anchors, round(empty_tables, 6) AS empty_tables, round(garbled, 6) AS garbled, round(ocr_mean, 6) AS ocr_mean, round(sufficiency, 6) AS sufficiency,
  CASE WHEN passed THEN 'STRUCTURING' ELSE 'QC_FAILED' END AS to_state, CASE WHEN NOT passed THEN 'E301' END AS error_code, NOT is_case AND near AS qc_marginal,
  array_to_string(list_filter([CASE WHEN NOT is_case AND coverage < 0.95 THEN 'clause_coverage' END, CASE WHEN NOT is_case AND gaps > 0 THEN 'clause_continuity' END, CASE WHEN NOT is_case AND sufficiency < 0.7 THEN 'extraction_sufficiency' END,
    CASE WHEN NOT is_case AND disorder > 0 THEN 'hierarchy_legality' END, CASE WHEN anchors < 1 THEN 'page_anchor_complete' END, CASE WHEN NOT is_case AND empty_tables > 0.05 THEN 'table_consistency' END, CASE WHEN NOT clean THEN 'text_quality' END], lambda x: x IS NOT NULL), ',') AS failed
FROM told""")
def quality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _scanned(spark, sf_dir)
    profiles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.when(F.col("doc_id") % 5 == 0, "P-CASE").otherwise("P-INT").alias("corpus_type"))
    # Read three times below; the clause tree behind it is made once.
    values = written(quality.indicator_values(blocks), "values")
    verdicts = quality.gate(quality.indicators(values, profiles))
    states = quality.next_states(verdicts).select("version_id", "to_state", "error_code", "qc_marginal").join(verdicts.select("version_id", F.array_join("failed", ",").alias("failed")), "version_id")
    return values.select("version_id", *[F.round(c, 6).alias(c) for c in ("coverage", "gaps", "disorder", "anchors", "empty_tables", "garbled", "ocr_mean", "sufficiency")]).join(states, "version_id")


_DAY = "DATE '2024-06-01'"
_OPENS = (
    r"regexp_matches(text, '^\s*(经查|违法事实|违规事实|存在以下)') OR regexp_matches(text, '^\s*(依据|根据.*《|违反了)') OR regexp_matches(text, '^\s*(现决定|我会决定|我局决定|决定|责令|处以)')"
    r" OR regexp_matches(text, '^\s*(当事人|被处罚人|被检查)|^.{2,48}(公司|中心|银行|集团|协会|事务所|、|先生|女士).{0,12}[:：]\s*$')"
)


@query(f"""WITH {_TREE},
v AS (SELECT doc_id AS version_id, CASE WHEN doc_id % 5 = 0 THEN 'P-CASE' WHEN doc_id % 7 = 0 THEN 'P-QA' ELSE 'P-INT' END AS kind, doc_id % 13 = 0 AS waits, doc_id % 17 <> 0 AS there FROM documents WHERE doc_id IS NOT NULL),
{_indicator_sql()},
gated AS (SELECT v.*, CASE kind WHEN 'P-QA' THEN FALSE WHEN 'P-CASE' THEN clean AND anchors >= 1 ELSE clause_ok END AS passed FROM v JOIN checks USING (version_id) WHERE there AND NOT waits),
heads_ AS (SELECT DISTINCT version_id FROM tree WHERE idx < 8 AND contains(text, '责令')),
met AS (SELECT g.*, version_id % 3 = 0 AND version_id IN (FROM heads_) AS conflict, version_id % 11 = 0 AS revises FROM gated g WHERE passed),
opens AS (SELECT version_id, count(*) FILTER ({_OPENS}) AS n FROM tree GROUP BY 1),
cut AS (
  SELECT version_id, CASE WHEN kind = 'P-CASE' THEN greatest(n, 1) + 1 ELSE arts END AS searched, CASE WHEN kind = 'P-CASE' THEN 0 ELSE secs END AS parents, conflict, revises, kind
  FROM met JOIN opens USING (version_id) JOIN (SELECT version_id, count(DISTINCT article_idx) AS arts, count(DISTINCT section_idx) AS secs FROM tree GROUP BY 1) USING (version_id)),
ends AS (
  SELECT v.version_id, CASE WHEN v.waits THEN 'META_REVIEW' WHEN NOT v.there THEN 'PARSE_FAILED' WHEN c.version_id IS NULL THEN 'QC_FAILED' WHEN c.conflict OR c.revises THEN 'META_REVIEW'
      WHEN c.version_id % 19 = 0 AND c.searched > 0 THEN 'INDEXING' WHEN c.version_id % 9 = 0 THEN 'DEGRADED_INDEXED' ELSE 'INDEXED' END AS state, v.waits, c.searched, c.conflict, c.revises
  FROM v LEFT JOIN cut c USING (version_id)),
live AS (SELECT *, CASE WHEN state IN ('INDEXED', 'DEGRADED_INDEXED') THEN CASE WHEN version_id % 2 = 1 THEN 'upcoming' ELSE 'effective' END ELSE 'staging' END AS status FROM ends)
SELECT 'state' AS kind, state || ' ' || status AS name, count(*) AS n FROM live GROUP BY ALL
UNION ALL SELECT 'table', 'tree', count(*) FROM tree JOIN v USING (version_id) WHERE v.there AND NOT v.waits
UNION ALL SELECT 'table', 'chunks', sum(searched + parents) FROM cut
UNION ALL SELECT 'table', 'verdicts', count(*) FROM gated
UNION ALL SELECT 'table', 'conflicts', count(*) FROM met WHERE conflict
UNION ALL SELECT 'table', 'facts', count(*) FROM met WHERE kind = 'P-CASE'
UNION ALL SELECT 'table', 'corpus', sum(searched) FROM live WHERE state IN ('INDEXED', 'DEGRADED_INDEXED')
UNION ALL SELECT 'table', 'states', count(*) FROM live
UNION ALL SELECT 'table', 'failures', count(*) FROM live WHERE state = 'INDEXING'
UNION ALL SELECT 'queue', CASE WHEN state = 'PARSE_FAILED' THEN 'not parsed' WHEN state = 'QC_FAILED' THEN 'quality gate' WHEN conflict THEN 'metadata conflict' ELSE 'revision to be confirmed' END, count(*) FROM live WHERE NOT waits AND state IN ('PARSE_FAILED', 'QC_FAILED', 'META_REVIEW') GROUP BY ALL
UNION ALL SELECT 'event', name, count(*) FROM (SELECT unnest(CASE state WHEN 'PARSE_FAILED' THEN ['PARSING', 'PARSE_FAILED'] WHEN 'QC_FAILED' THEN ['PARSING', 'QC_PENDING', 'QC_FAILED'] WHEN 'META_REVIEW' THEN ['PARSING', 'QC_PENDING', 'STRUCTURING', 'META_REVIEW']
  WHEN 'INDEXING' THEN ['PARSING', 'QC_PENDING', 'STRUCTURING', 'EMBEDDING', 'INDEXING'] ELSE ['PARSING', 'QC_PENDING', 'STRUCTURING', 'EMBEDDING', 'INDEXING', state] END) AS name FROM live WHERE NOT waits) GROUP BY ALL""")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    versions = docs.select(
        i.alias("version_id"),
        F.when(i % 5 == 0, "P-CASE").when(i % 7 == 0, "P-QA").otherwise("P-INT").alias("corpus_type"),
        F.concat(F.lit("t"), i.cast("string")).alias("title"),
        none.alias("doc_number"),
        F.lit(None).cast("date").alias("issue_date"),
        F.when(i % 2 == 1, F.lit("2030-01-01").cast("date")).alias("effective_date"),
        F.when(i % 3 == 0, "甲署").otherwise("").alias("issuer"),
        F.when(i % 11 == 0, i - 1).alias("supersedes_version_id"),
        F.when(i % 13 == 0, "META_REVIEW").otherwise("REGISTERED").alias("pipeline_status"),
        (i % 9 == 0).alias("degraded"),
        none.alias("sub_type"),
        F.lit("public").alias("perm_tag"),
        F.lit("staging").alias("version_status"),
        F.array().cast("array<string>").alias("biz_domains"),
        none.alias("biz_domain"),
    )
    blocks = _blocks(spark, sf_dir).where("version_id % 17 <> 0").withColumns({"ocr_conf": F.lit(None).cast("double"), "table_empty": F.lit(False)})
    # The second issuer is named by a word of duty, which many documents have at their head.
    issuers = spark.createDataFrame([("I1", "甲署", "部级"), ("I2", "责令", "部级")], "code string, name string, issuer_level string")
    known = versions.select("version_id", "doc_number", "title", F.lit("effective").alias("version_status"))
    aliases = spark.createDataFrame([], "alias string, canonical_doc_number string, canonical_title string")
    batch = ingest.ingest_batch(
        versions, blocks, issuers, known, aliases,
        today=F.lit("2024-06-01").cast("date"),
        embed=lambda chunks: chunks.where("version_id % 19 <> 0").select("chunk_id"),
        limits=structure.ChunkLimits(0, 1 << 30, 1 << 30),
        confirm_plain=True,
    )
    counted = lambda frame, kind, name: frame.select(F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name")).groupBy("kind", "name").agg(F.count("*").alias("n"))
    out = counted(batch.states, "state", F.concat_ws(" ", "pipeline_status", "version_status")).unionByName(counted(batch.queue, "queue", F.col("reason"))).unionByName(counted(batch.events, "event", F.col("to_state")))
    for name in ("tree", "chunks", "verdicts", "conflicts", "facts", "corpus", "states", "failures"):
        out = out.unionByName(batch.tables()[name].agg(F.lit("table").alias("kind"), F.lit(name).alias("name"), F.count("*").alias("n")))
    return out



# ---------------------------------------------------------------------- pages and verifiers


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 5 lines of the regulation view."""
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return _blocks(spark, sf_dir).groupBy("version_id", F.col("page").alias("page_no")).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


@query(f"WITH {REGULATION_SQL} SELECT version_id, idx, CASE WHEN {_SOLID} <> '' THEN page END AS page FROM blocks")
def pages_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators.alignment import align_pages

    blank = _blocks(spark, sf_dir).withColumn("page", F.lit(None).cast("int"))
    return align_pages(blank, _pages(spark, sf_dir)).select("version_id", "idx", "page")


@query(f"WITH {REGULATION_SQL} SELECT version_id, idx, CASE WHEN {_SOLID} <> '' THEN page END AS page FROM blocks")
def pages_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth block of 80 characters or more stands on its page with a character put in, changed or left out."""
    from clauselake.operators.alignment import align_pages

    blocks = _blocks(spark, sf_dir)
    k, at = F.col("idx") % 3, F.lit(20) + F.col("idx") % 40
    edited = F.concat(F.left("text", at), F.when(k == 0, "").when(k == 1, "¤").otherwise("¤¤"), F.substr("text", at + 2))
    spoilt = blocks.withColumn("text", F.when((F.col("idx") % 5 == 2) & (F.length("text") >= 80), edited).otherwise(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    pages = spoilt.groupBy("version_id", F.col("page").alias("page_no")).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return align_pages(blocks.withColumn("page", F.lit(None).cast("int")), pages).select("version_id", "idx", "page")


@query(f"""WITH {REGULATION_SQL}, p AS (SELECT version_id, page, sum(length({_SOLID})) AS n FROM blocks GROUP BY 1, 2)
SELECT version_id, CAST(page AS INT) AS page_no, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS "end" FROM p WINDOW w AS (PARTITION BY version_id ORDER BY page)""")
def pages_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators.alignment import page_offsets

    return page_offsets(_pages(spark, sf_dir))


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a line; every ninth is a table and every eleventh degraded."""
    rows = _blocks(spark, sf_dir)
    return rows.select(F.concat_ws("-", "version_id", "idx").alias("chunk_id"), "version_id", "text", F.lit("").alias("breadcrumb"), F.col("page").alias("page_start"), "page_end", F.lit(False).alias("is_parent"), (F.col("idx") % 9 == 8).alias("is_table"), (F.col("idx") % 11 == 10).alias("degraded"), F.col("idx").alias("seq"))


@query(f"""WITH {REGULATION_SQL} SELECT count(*) FILTER (NOT (idx % 9 = 8 OR idx % 11 = 10)) AS total, count(*) FILTER (NOT (idx % 9 = 8 OR idx % 11 = 10)) AS matched, count(*) FILTER (idx % 9 = 8 OR idx % 11 = 10) AS exempt, CAST(1 AS DOUBLE) AS pass_rate FROM blocks""")
def verify_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators import report

    return report.replay_summary(report.replay(_line_chunks(spark, sf_dir), _pages(spark, sf_dir)))


@query(f"WITH {REGULATION_SQL}, m AS (SELECT {_MARKER_SQL} AS marker FROM blocks) SELECT count(marker) AS obligation_chunks, round(count(marker) / count(*), 4) AS coverage FROM m")
def report_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators import report

    chunks = _line_chunks(spark, sf_dir)
    return report.obligation_coverage(chunks, obligations.tag_chunks(chunks))


@query(f"WITH {REGULATION_SQL} SELECT version_id, trim('t' || version_id || ' ' || left(trim(regexp_replace(arg_min(text, idx), '^\\s+', '')), 30)) AS question FROM blocks GROUP BY 1")
def questions_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators import report

    versions = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("version_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"))
    return report.synthetic_questions(_line_chunks(spark, sf_dir), versions)


@query(f"""WITH {REGULATION_SQL} SELECT version_id || '-' || idx AS chunk_id, CASE WHEN version_id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS biz_domain, CASE WHEN version_id % 3 = 0 THEN 3 ELSE 0 END AS issuer_level, 20240301 AS effective_date, page AS page_start FROM blocks""")
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.operators.retrieval import corpus_rows as rows

    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    i = F.col("doc_id")
    versions = docs.select(i.alias("version_id"), F.lit("P-INT").alias("corpus_type"), F.lit("s").alias("sub_type"), F.lit("p").alias("perm_tag"), F.lit("effective").alias("version_status"), F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("biz_domains"), F.lit("c").alias("biz_domain"), F.lit("2024-03-01").cast("date").alias("effective_date"))
    issuers = docs.select(F.lit("I1").alias("code"), F.lit("会").alias("name"), F.lit("部级").alias("issuer_level")).distinct()
    ranks = cases.issuer_rank(docs.select(i.alias("version_id"), F.when(i % 3 == 0, "会").otherwise("x").alias("issuer")), issuers).select("version_id", "issuer_level")
    chunks = _line_chunks(spark, sf_dir).withColumns({"chunk_type": F.lit("clause"), "clause_path": F.lit("p")})
    return rows(chunks, versions, ranks).select("chunk_id", "biz_domain", "issuer_level", "effective_date", "page_start")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey % 100 AS n, l_linenumber AS k FROM lineitem), v AS (SELECT p_partkey % 120 AS n, min(p_partkey) AS version_id FROM part GROUP BY 1)
SELECT case_id, 'n' || n || '|' || k AS key, version_id || '/' || k AS chunk_id FROM c JOIN v USING (n) WHERE k <= 5""")
def bridge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    entry = F.struct(F.concat(F.lit("n"), (F.col("l_partkey") % 100).cast("string")).alias("doc_no"), F.col("l_linenumber").cast("string").alias("clause_path_norm"))
    cited = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(entry).alias("cited_regulations"))
    versions = parts.select(F.col("p_partkey").alias("version_id"), F.concat(F.lit("n"), (F.col("p_partkey") % 120).cast("string")).alias("doc_number"), F.lit("effective").alias("version_status"))
    chunks = parts.select(F.col("p_partkey").alias("version_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("version_id", F.col("k").cast("string").alias("clause_path_norm"), F.concat_ws("/", "version_id", "k").alias("chunk_id"), F.lit(0).alias("seq"), F.lit(False).alias("is_parent"), F.lit(False).alias("degraded"))
    return references.cited_clauses(cited, versions, chunks)
