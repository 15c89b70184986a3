"""Queries of single functions and sinks, over rows made from ``part``, ``supplier``, ``nation`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from clauselake.functions import text as X
from clauselake.operators import cases, curation, obligations, references, retrieval, routing
from clauselake.sources import formats, tables
from clauselake.sources.corpus import table

QUERIES, ORACLE_SQL = {}, {}
K = "p_partkey"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _turn(n: int, *values: Column | str) -> Column:
    """The value that the key modulo ``n`` picks."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.col(K) % n).cast("int"))


# ------------------------------------------------------------------ issuers and domains


def _issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, ("内部", "自律组织", "部级", "其他", "其他"))), F.col("n_regionkey").cast("int"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), level.alias("issuer_level"))


def _issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    way = F.col("s_suppkey") % 3
    return named.select("s_suppkey", F.when(way == 0, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).when(way == 1, F.col("n_name")).otherwise("不详").alias("issuer"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'N' || s_nationkey END AS issuer_code FROM supplier")
def issuer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.resolve_issuer(_issued(spark, sf_dir), _issuers(spark, sf_dir)).select("s_suppkey", "issuer_code")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 AND n_regionkey < 3 THEN CAST(n_regionkey AS INTEGER) + 1 ELSE 0 END AS issuer_level FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def issuer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.issuer_rank(_issued(spark, sf_dir), _issuers(spark, sf_dir)).select("s_suppkey", "issuer_level")


@query("""WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'd1' ELSE '' END AS said, [['d1'], ['d2'], [], ['d1', 'd3']][1 + p_partkey % 4] AS model,
  p_partkey % 2 = 0 AS inner_, CAST('0x' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.25 AS drawn FROM part)
SELECT p_partkey, CASE WHEN said <> '' THEN [said] WHEN len(model) > 0 THEN model END AS domains, CASE WHEN said <> '' THEN 'manifest' WHEN len(model) > 0 THEN 'llm' END AS source,
  CASE WHEN said <> '' THEN len(model) > 0 AND NOT list_contains(model, said) WHEN len(model) > 0 THEN inner_ OR drawn ELSE FALSE END AS needs_review FROM d""")
def domain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _turn(4, F.array(F.lit("d1")), F.array(F.lit("d2")), F.array().cast("array<string>"), F.array(F.lit("d1"), F.lit("d3")))
    docs = _parts(spark, sf_dir).select(K, _turn(2, "P-INT", "P-EXT").alias("corpus_type"), F.when(F.col(K) % 3 == 0, "d1").otherwise("").alias("manifest_domain"), model.alias("model_domains"), F.col(K).cast("string").alias("sample_key"))
    return cases.business_domains(docs, 0.25).select(K, "domains", "source", "needs_review")


@query("SELECT p_partkey, list_filter(w, lambda x, i: list_contains(['red', 'small', 'ring', 'bolt'], x) AND list_position(w, x) = i) AS kept FROM (SELECT p_partkey, string_split(p_name || ' ' || p_name, ' ') AS w FROM part)")
def enforced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ("red", "small", "ring", "bolt")))
    return _parts(spark, sf_dir).select(K, cases.enforced(F.split(F.concat_ws(" ", "p_name", "p_name"), " "), allowed).alias("kept"))


# ---------------------------------------------------------------------------------- tags


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), e AS (SELECT name, 'v' || length(name) AS dv FROM w WHERE length(name) % 2 = 0),
x AS (SELECT p_partkey AS chunk_id, p_partkey // 4 AS version_id, list_distinct(string_split(p_name, ' ')) AS ws, string_split(p_name, ' ') AS w, p_brand, p_type FROM part),
h AS (SELECT chunk_id, version_id, list_filter(w, lambda y, i: list_position(w, y) = i AND length(y) % 2 = 0) AS entity_type FROM x)
SELECT chunk_id, version_id, 'entity_type' AS tag_type, array_to_string(entity_type, ',') AS tag_value, entity_type, array_to_string(list_sort(list_distinct(list_transform(entity_type, lambda y: 'v' || length(y)))), ',') AS dict_version FROM h WHERE len(entity_type) > 0
UNION ALL SELECT chunk_id, version_id, 'department', p_brand, NULL, 'b' FROM x WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 3)
UNION ALL SELECT chunk_id, version_id, 'matter', p_type, NULL, 'm' FROM x""")
def tags_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    found = parts.select(F.col(K).alias("chunk_id"), F.floor(F.col(K) / 4).alias("version_id"), F.split("p_name", " ").alias("entity_types"), F.array("p_brand").alias("departments"), F.array("p_type", "p_type").alias("matters"))
    words = parts.select(F.explode(F.split("p_name", " ")).alias("name")).distinct().where(F.length("name") % 2 == 0)
    names = lambda rows, column, version: rows.select(F.col(column).alias("name"), F.lit(version).alias("dict_version")).distinct()
    return obligations.dictionary_tags(found, words.withColumn("dict_version", F.concat(F.lit("v"), F.length("name").cast("string"))), names(parts.where("p_size < 3"), "p_brand", "b"), names(parts, "p_type", "m"))


@query("""WITH t AS (SELECT l_orderkey AS chunk_id, l_orderkey // 7 AS version_id, (['is_obligation', 'duration', 'other'])[1 + l_linenumber % 3] AS tag_type, CAST(l_linenumber AS VARCHAR) AS tag_value FROM lineitem)
SELECT * FROM t WHERE tag_type = 'other' OR version_id % 2 = 1 UNION ALL SELECT o_orderkey, o_orderkey // 7, 'duration', 'new' FROM orders WHERE o_orderkey // 7 % 2 = 0""")
def tags_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda key: F.floor(F.col(key) / 7)
    kinds = F.get(F.array(*map(F.lit, ("is_obligation", "duration", "other"))), (F.col("l_linenumber") % 3).cast("int"))
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), of("l_orderkey").alias("version_id"), kinds.alias("tag_type"), F.col("l_linenumber").cast("string").alias("tag_value"))
    fresh = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), of("o_orderkey").alias("version_id"), F.lit("duration").alias("tag_type"), F.lit("new").alias("tag_value")).where("version_id % 2 = 0")
    return obligations.replace_tags(tags, fresh, tags.where("version_id % 2 = 0").select("version_id").distinct())


# ------------------------------------------------------------------------ cards and files


@query("""SELECT o_orderkey AS case_id, '{"title":"' || c_name || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"penalty_org":"局"' ELSE '' END || ',"doc_number":"n' || o_orderkey || '","penalty_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"'
  || CASE WHEN o_orderkey % 3 = 0 THEN ',"respondent":"某人","respondent_type":"个人"' ELSE '' END || ',"violation_category":"' || o_orderstatus || '","penalty_type":"罚款"' || CASE WHEN o_orderkey % 5 > 0 THEN ',"amount_wan":' || (o_orderkey % 5 - 1) ELSE '' END || '}' AS card
FROM orders JOIN customer ON o_custkey = c_custkey""")
def case_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    person = lambda value: F.when(k % 3 == 0, value).otherwise("")
    rows = table(spark, sf_dir, "orders").select(k.alias("case_id"), F.col("o_custkey").alias("version_id"), F.when(k % 2 == 0, "局").alias("penalty_org"), F.concat(F.lit("n"), k.cast("string")).alias("doc_number"), F.to_date("o_orderdate").alias("penalty_date"), person("某人").alias("respondent"), person("个人").alias("respondent_type"), F.col("o_orderstatus").alias("violation_category"), F.lit("罚款").alias("penalty_type"), F.when(k % 5 > 0, k % 5 - 1).alias("amount_wan"))
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("version_id"), F.col("c_name").alias("title"))
    return rows.alias("c").join(versions.alias("v"), "version_id").select("c.case_id", cases.case_card().alias("card"))


@query("""SELECT DISTINCT 'title' AS kind, replace(p_name, ' ', '') AS cited FROM part
UNION ALL SELECT DISTINCT 'number', '证监会公告〔' || (2000 + p_partkey % 30) || '〕' || (p_partkey % 500) || '号' FROM part""")
def citations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("依据《"), "p_name", F.lit("》和证监会公告〔"), (F.col(K) % 30 + 2000).cast("string"), F.lit("〕 "), (F.col(K) % 500).cast("string"), F.lit(" 号"))
    titles, numbers = curation.citations_in(_parts(spark, sf_dir).select(said.alias("text")))
    return titles.select(F.lit("title").alias("kind"), F.col("title").alias("cited")).unionByName(numbers.select(F.lit("number").alias("kind"), F.col("doc_number").alias("cited")))


@query("""WITH f AS (SELECT p_partkey, p_name || '〔' || (2000 + p_partkey % 30) || '〕 ' || (p_partkey % 500) || '号' AS title FROM part)
SELECT p_partkey FROM f WHERE contains(title, 'blue ring') OR contains(title, 'small') OR contains(replace(title, ' ', ''), '〔2007〕7号')""")
def files_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _parts(spark, sf_dir).select(K, F.concat("p_name", F.lit("〔"), (F.col(K) % 30 + 2000).cast("string"), F.lit("〕 "), (F.col(K) % 500).cast("string"), F.lit("号")).alias("title"))
    one = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")
    return curation.cited(files, one("title", "blue ring", "small"), one("doc_number", "〔2007〕7号")).select(K)


# ------------------------------------------------------------------------------- text


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey % 13, p_size, p_partkey % 3, p_partkey) AS place FROM part")
def clause_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat((F.col(K) % 13).cast("string"), F.lit("/"), F.col("p_size").cast("string"), F.lit("-"), (F.col(K) % 3).cast("string"))
    return _parts(spark, sf_dir).select(K, F.row_number().over(Window.partitionBy(F.col("p_size") % 5).orderBy(X.path_key(path), K)).cast("long").alias("place"))


@query("""SELECT p_partkey, substr(t, 1, 3) || '〖' || p_brand || '〗' || substr(t, 4) AS text FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, 6) || '〖' || substr(p_type, 1, 4) || '〗' || substr(p_name, 7) ELSE p_name END AS t FROM part)""")
def glosses_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = lambda end, gloss, render: F.struct(F.lit(end).alias("span_end"), gloss.alias("gloss"), render.alias("render"))
    yes = F.lit(True)
    notes = F.array(note(3, F.col("p_brand"), yes), note(4, F.lit(""), yes), note(5, F.lit(None).cast("string"), yes), note(6, F.left("p_type", F.lit(4)), F.col(K) % 2 == 0))
    return _parts(spark, sf_dir).select(K, references.render_glosses(F.col("p_name"), notes).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name || '。'] ELSE [p_name || '。', p_type || '！'] END AS complete, CASE p_partkey % 3 WHEN 1 THEN '' ELSE p_brand END AS tail FROM part")
def sentence_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("p_name", F.lit("。"), _turn(3, F.col("p_brand"), F.concat("p_type", F.lit("！")), F.concat("p_type", F.lit("！"), "p_brand")))
    return _parts(spark, sf_dir).select(K, routing.sentences(said).alias("_s")).select(K, "_s.complete", "_s.tail")


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END / CAST(length(p_name) + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS DOUBLE), 6) AS ratio,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS garbled, CAST(length(replace(p_name, ' ', '')) + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS total FROM part""")
def garbled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("p_name", F.when(F.col(K) % 3 == 0, "�\x01").otherwise(""))
    rows = _parts(spark, sf_dir).select(K, F.round(X.garbled_ratio(said), 6).alias("ratio"), X.garbled_chars(said).alias("_c"))
    return rows.select(K, "ratio", F.col("_c.garbled").cast("int").alias("garbled"), F.col("_c.total").cast("int").alias("total"))


@query("SELECT p_partkey, (['不作判断', '可能违反某条', '不作判断', '普通说明'])[1 + p_partkey % 4] AS plain, (['不作判断', '不作判断', '不作判断', '普通说明'])[1 + p_partkey % 4] AS cautious FROM part")
def neutral_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _turn(4, "该行为违规", "可能违反某条", "合规", "普通说明")
    return _parts(spark, sf_dir).select(K, routing.without_verdict(said, "不作判断").alias("plain"), routing.without_verdict(said, "不作判断", tentative=True).alias("cautious"))


@query("SELECT p_partkey, [CAST(p_partkey AS VARCHAR), 'c' || (p_partkey % 7)] AS marked, ['c' || (p_partkey % 7)] AS kept FROM part")
def faithful_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda c: F.concat(F.lit("[[clause_id:"), c, F.lit("]] "))
    own, seventh = F.col(K).cast("string"), F.concat(F.lit("c"), (F.col(K) % 7).cast("string"))
    rows = _parts(spark, sf_dir).select(K, routing.marked_ids(F.concat(mark(own), F.lit("text "), mark(seventh), mark(own))).alias("marked"), seventh.alias("_c"))
    return rows.select(K, "marked", routing.faithful(F.concat("marked", "marked"), F.array("_c", F.lit("other"))).alias("kept"))


# -------------------------------------------------------------------------- retrieval


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 > 0 AND label IN (1, 2) AND (vec_id % 5 = 2 OR (label = 2 AND vec_id % 5 = 3))")
def listing_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    corpus = table(spark, sf_dir, "embeddings").select(i.alias("chunk_id"), F.when(i % 3 == 0, "parent").otherwise("clause").alias("chunk_type"), F.array(F.concat(F.lit("d"), F.col("label").cast("string")), F.lit("all")).alias("biz_domain"), F.when(i % 5 == 4, None).otherwise(F.array(F.concat(F.lit("e"), (i % 5).cast("string")), F.concat(F.lit("f"), F.col("label").cast("string"), (i % 5).cast("string")))).alias("entity_type"))
    return retrieval.filtered(corpus, domains=("d1", "d2"), entities=("e2", "f23")).select("chunk_id")


@query("""WITH n AS (SELECT n_nationkey AS query_id, 'in ' || n_name AS question FROM nation),
l AS (SELECT query_id, list_distinct(flatten(list(t))) AS terms FROM n JOIN (VALUES ('ALG', ['a', 'b']), ('ERIA', ['b', 'c']), ('IN', ['d']), ('in', ['e'])) v(oral, t) ON contains(question, oral) GROUP BY 1)
SELECT query_id, token, CAST(sum(w) AS DOUBLE) AS weight FROM (
  SELECT query_id, 'base' AS token, 1.0 AS w FROM l UNION ALL SELECT query_id, 'e', 0.5 FROM l UNION ALL SELECT query_id, unnest(terms), 0.3 FROM l) GROUP BY ALL""")
def sparse_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("in "), "n_name").alias("question"))
    listed = spark.createDataFrame([("ALG", "a| b"), ("ERIA", "b|c|"), ("IN", "d"), ("in", "e"), ("none", "|"), (None, "z")], "oral_term string, legal_terms string")
    found = retrieval.legal_terms(questions, tables.scenario_terms(listed))
    base = F.create_map(F.lit("base"), F.lit(1.0), F.lit("e"), F.lit(0.5))
    spans = F.transform("legal_terms", lambda t: F.create_map(t, F.lit(1.0)))
    return found.select("query_id", F.explode(retrieval.boosted(base, spans, 0.3)).alias("token", "weight"))


# ----------------------------------------------------------------------- formats and sinks


@query("SELECT p_partkey, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_brand || ' |' || chr(10) || '| ' || p_partkey || ' | ' || p_size || ' |' AS markdown, FALSE AS is_empty FROM part")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr><tr><td rowspan=2>"), F.col(K).cast("string"), F.lit("</td><td>"), "p_brand", F.lit(" </td></tr><tr><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    grids = _parts(spark, sf_dir).select(K, formats.html_table(html).alias("_t"))
    return grids.select(K, formats.markdown(F.col("_t")).alias("markdown"), formats.empty_table(F.col("_t")).alias("is_empty"))


@query("SELECT p_partkey, (['pdf', 'png', 'jpg', 'unknown', 'unknown'])[1 + p_partkey % 5] AS format FROM part")
def formats_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _turn(5, "255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE0", "504B030400", "00")
    return _parts(spark, sf_dir).select(K, formats.sniff(F.unhex(head)).alias("format"))


@query("SELECT p_partkey AS version_id, 'raw/P-INT/b' || (p_partkey % 9) || '/' || p_partkey || '.pdf' AS raw_key, 'rendition/' || p_partkey || '.pdf' AS rendition_key, 'ir/' || p_partkey || '.json' AS ir_key FROM part")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _parts(spark, sf_dir).select(F.col(K).cast("string").alias("version_id"), F.lit("P-INT").alias("corpus_type"), F.concat(F.lit("b"), (F.col(K) % 9).cast("string")).alias("batch_id"), F.lit("pdf").alias("source_format"))
    return tables.object_keys(versions).select(F.col("version_id").cast("long").alias("version_id"), "raw_key", "rendition_key", "ir_key")


@query("SELECT p_size % 4 AS lot, p_partkey, CASE WHEN p_size % 4 = 1 THEN 'second' ELSE 'first' END AS run FROM part")
def sink_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written once and not again, with one of its partitions replaced since."""
    path = tables.scratch(spark, "lots")
    rows = _parts(spark, sf_dir).select((F.col("p_size") % 4).alias("lot"), K)
    tables.replace_partitions(rows.withColumn("run", F.lit("first")), path, "lot")
    tables.write_once(rows.withColumn("run", F.lit("third")), path)
    tables.replace_partitions(rows.where("lot = 1").withColumn("run", F.lit("second")), path, "lot")
    return spark.read.schema("p_partkey long, run string, lot int").parquet(path)


@query("SELECT 'N' || n_nationkey AS code, n_name AS name, CASE WHEN n_regionkey = 0 THEN '内部' WHEN n_regionkey = 1 THEN '自律组织' WHEN n_regionkey = 2 THEN '部级' ELSE '其他' END AS issuer_level FROM nation")
def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary written as CSV, with a line without a key and an added column, read back."""
    path = tables.scratch(spark, "issuers")
    odd = spark.createDataFrame([(None, "nobody", "其他")], "code string, name string, issuer_level string")
    _issuers(spark, sf_dir).unionByName(odd).withColumn("note", F.lit("x")).write.csv(path, header=True)
    return tables.dictionary(spark, path, "issuers")


@query("SELECT 'd' || p_partkey || '.pdf' AS filename, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'n' || p_partkey ELSE '' END AS doc_number FROM part")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as CSV, with an empty line, read back."""
    path = tables.scratch(spark, "manifest")
    rows = _parts(spark, sf_dir).select(F.concat(F.lit("d"), F.col(K).cast("string"), F.lit(".pdf")).alias("filename"), F.col("p_name").alias("title"), F.when(F.col(K) % 2 == 0, F.concat(F.lit("n"), F.col(K).cast("string"))).alias("doc_number"))
    rows.unionByName(spark.createDataFrame([(None, None, None)], rows.schema)).write.csv(path, header=True)
    return tables.manifest(spark, path)


_TIDY = "regexp_replace(l, '[\\x{00}-\\x{08}\\x0b-\\x{1f}\\x{fffe}\\x{ffff}]', '', 'g')"
_BLANK = "regexp_replace(t, '[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]', '', 'g') = ''"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL)),
t AS (SELECT doc_id, i, {_TIDY} AS t FROM l WHERE doc_id % 50 <> 0),
k AS (SELECT doc_id, i, t, i % 7 = 3 AS tabled FROM t WHERE i % 7 = 3 OR NOT {_BLANK})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, CASE WHEN tabled THEN 'table' WHEN i % 5 = 0 THEN 'heading' ELSE 'text' END AS kind, CASE WHEN tabled THEN 'k' || chr(9) || i || chr(10) || 'v' || chr(9) || length(t) ELSE t END AS text, CAST(NULL AS VARCHAR) AS error FROM k
UNION ALL SELECT doc_id, 0, NULL, NULL, 'E101' FROM documents WHERE doc_id IS NOT NULL AND doc_id % 50 = 0""")
def office_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as office files, one in fifty broken, and read back by the data source."""
    from clauselake.sources import office

    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    tidy = F.transform("lines", lambda x: F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", ""))
    block = lambda x, i: F.struct(F.when(i % 7 == 3, "table").when(i % 5 == 0, "heading").otherwise("text").alias("kind"), F.when(i % 7 == 3, F.concat(F.lit("k\t"), i.cast("string"), F.lit("\nv\t"), F.length(x).cast("string"))).otherwise(x).alias("text"))
    files = docs.select(F.concat("doc_id", F.lit(".docx")).alias("name"), F.when(F.col("doc_id") % 50 != 0, F.transform(tidy, block)).alias("blocks"))
    path = tables.scratch(spark, "office")
    office.write_docx(files, path).agg(F.sum("bytes")).collect()
    read = office.read_office(spark, path, partition_bytes=1 << 20)
    return read.select(F.regexp_extract("path", r"(-?\d+)\.docx$", 1).cast("long").alias("doc_id"), "idx", "kind", "text", "error")


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauselake.sources import pages

    return pages.page_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))
