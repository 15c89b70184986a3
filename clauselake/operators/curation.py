"""Choosing files for a corpus: titles, types, one format a title, stratified samples, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.functions import text as X

from . import containment
from .references import spans

# Patterns of file types in order, formats in order of preference.
TYPES = (
    ("案例", r"(警示函|监管措施|行政处罚|纪律处分|处分(决定)?|监管谈话|责令改正|认定为不适当人选|采取.{0,8}措施.{0,4}决定)"),
    ("外规·法律", r"中华人民共和国.{1,12}法([（(].*?[)）])?$"),
    ("外规·自律规则", r"(交易所|结算|登记).{0,20}(规则|办法|细则|指引|指南|规定|业务规则|手册|章程)"),
    ("外规·部门规章通知", r"(通知|公告|批复|复函|意见|办法|规定|细则|指引|准则|解释)"),
)
FORMATS = ("pdf", "docx", "doc", "txt")
CASE_FORMATS = ("pdf", "txt", "docx", "doc")
MIN_BYTES = 64

# Who numbers a document, and the kinds of numbered documents.
NUMBERED_BY = ("证监会", "证监")
NUMBERED_KINDS = ("令", "公告", "发")

#: A title of 4 to 40 characters between book marks.
_CITED_TITLE = r"《([^》]{4,40})》"
#: Year and serial number, once all brackets are alike.
_YEAR_AND_SERIAL = r"〔?\d{4}〕?第?\d{1,4}号"
#: What may stand before the year, longest first.
_BEFORE = sorted({who + kind for who in ("", *NUMBERED_BY) for kind in ("", *NUMBERED_KINDS)} - {""}, key=lambda p: (-len(p), p))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def title_of(name: Column) -> Column:
    """A file name without extension, the numbers that it begins with, and brackets that hold a year.

    Of the parts between _ and - those in front that are numbers of at most four digits go:
    serial numbers and a date, at most five, and never the last part.
    """
    stem = base_name(name)
    parts = F.split(stem, "[_-]")
    words = F.filter(F.transform(parts, lambda x, k: F.when(~x.rlike(r"^\d{1,4}$"), k)), lambda k: k.isNotNull())
    ahead = F.least(F.coalesce(F.array_min(words), F.lit(5)), F.lit(5), F.size(parts) - 1)
    skipped = F.aggregate(F.slice(parts, 1, ahead), F.lit(0), lambda n, x: n + F.length(x) + 1)
    rest = F.substr(stem, skipped + 1)
    dated = F.filter(F.regexp_extract_all(rest, F.lit(r"([（(【][^（(【)）】]*[)）】])"), F.lit(1)), lambda x: x.contains("年"))
    return F.trim(F.aggregate(dated, rest, lambda t, x: F.replace(t, x, F.lit(""))))


def type_of(name: Column) -> Column:
    stem = base_name(name)
    return F.coalesce(*[F.when(stem.rlike(p), F.lit(t)) for t, p in TYPES], F.lit("未判定"))


def safe_stem(name: Column, n: int = 70) -> Column:
    return F.left(F.regexp_replace(base_name(name), r"[^\p{L}\p{N}._-]+", "_"), F.lit(n))


def one_per_title(files: DataFrame) -> DataFrame:
    """(title, type, ext, path, formats): of files with one title the preferred format stays.

    ``files``: (path, name, length). Unknown formats and files under MIN_BYTES are passed
    over. Decisions prefer formats with page anchors, then plain text.
    """
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    known = files.withColumns({"ext": ext, "title": title_of(F.col("name"))}).where(F.col("ext").isin(*FORMATS) & (F.col("length") >= MIN_BYTES))
    typed = known.withColumn("_type", F.first(type_of(F.col("name"))).over(Window.partitionBy("title").orderBy("path")))
    order = lambda formats: F.array_position(F.array(*map(F.lit, formats)), F.col("ext"))
    preference = F.when(F.col("_type") == "案例", order(CASE_FORMATS)).otherwise(order(FORMATS))
    return typed.groupBy("title").agg(F.min("_type").alias("type"), F.min_by(F.struct("ext", "path"), F.struct(preference, "path")).alias("_f"), F.array_sort(F.collect_set("ext")).alias("formats")).select("title", "type", "_f.ext", "_f.path", "formats")


def stratified(rows: DataFrame, k: int, strata: tuple[str, ...], key: str, seed: int = 42) -> DataFrame:
    """``k`` rows, one from each stratum in turn; within a stratum by a seeded hash of ``key``."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= k).orderBy("_turn", *strata).limit(k).drop("_turn")


def numbers_in(text: Column) -> Column:
    """The document numbers in a text, without white space: year and serial, and before them who numbers and what kind.

    Brackets are made alike for the search only; a number is given as it stands.
    """
    solid = F.regexp_replace(text, r"\s+", "")
    alike = F.translate(solid, "[【(]】)", "〔〔〔〕〕〕")
    before = lambda m: F.coalesce(*[F.when(F.endswith(F.left(solid, m["start"]), F.lit(p)), F.lit(len(p))) for p in _BEFORE], F.lit(0))
    surface = lambda m: X.let(before(m), lambda n: F.substr(solid, m["start"] - n + 1, m["end"] - m["start"] + n))
    return F.transform(spans(alike, _YEAR_AND_SERIAL), surface)


def citations_in(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct titles and document numbers that texts cite."""
    titles = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_CITED_TITLE), F.lit(1))).alias("title")).select(F.regexp_replace("title", r"\s+", "").alias("title")).distinct()
    return titles, texts.select(F.explode(numbers_in(F.col("text"))).alias("doc_number")).distinct()


def cited(files: DataFrame, titles: DataFrame, numbers: DataFrame) -> DataFrame:
    """Files whose title holds, or is held by, a cited title, or holds a cited number; spaces don't count for numbers.

    Empty titles are cited by none.
    """
    own = files.select("title").distinct()
    words = titles.select(F.col("title").alias("_w")).distinct()
    found = containment.holding(own, words, "title", "_w").select("title")
    found = found.unionByName(containment.holding(words, own, "_w", "title").select("title"))
    solid = own.withColumn("_solid", F.regexp_replace("title", " ", ""))
    found = found.unionByName(containment.holding(solid, numbers.select(F.col("doc_number").alias("_w")).distinct(), "_solid", "_w").select("title"))
    return files.join(found, "title", "left_semi").select(*files.columns)


def file_hints(name: Column) -> Column:
    """struct(issue_date, doc_number) as a file name gives them."""
    from clauselake.functions.dates import date_of

    pattern = r"(\d{4})-?(\d{2})-?(\d{2})"
    day = date_of(*[F.nullif(F.regexp_extract(name, pattern, k), F.lit("")) for k in (1, 2, 3)])
    return F.struct(day.alias("issue_date"), F.nullif(F.trim(F.regexp_extract(X.to_halfwidth(name), r"([^\s_\-]{0,12}[〔\[(]\d{4}[〕\])]\s*第?\d+号)", 1)), F.lit("")).alias("doc_number"))
