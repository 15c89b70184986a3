"""Column expressions over regulation text: normal forms, numerals, clause numbers, headings.

Everything here is a Catalyst expression, so it runs inside whole-stage code generation
and can be pushed, pruned and folded like any other column.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of Chinese numerals, enumeration marks, inserted-clause suffixes.
DIGITS = "〇零一二两三四五六七八九"
DIGIT_VALUES = "001223456789"
UNITS = "十百千"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫"
LATIN_INSERTS = {"bis": 1, "ter": 2, "quater": 3, "quinquies": 4}
#: Heading levels, by the character that ends a heading's label.
LEVELS = {"章": 1, "节": 2, "条": 3, "款": 4, "项": 5, "目": 6}

NUMERAL = DIGITS + UNITS
_NUM = rf"[{NUMERAL}\d]+"
_ARTICLE_NUM = rf"(?:{_NUM}(?:bis|ter|quater|quinquies)?|\d+\.\d+[a-zA-Z]?)"

_WIDE = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = " " + "".join(map(chr, range(0x21, 0x7F)))
_RADICALS = "".join(map(chr, range(0x2F00, 0x2FD6)))
_UNIFIED = unicodedata.normalize("NFKC", _RADICALS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, which also keeps nested expressions small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_halfwidth(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as their narrow forms."""
    # Few lines have any, and translating goes through all characters one by one.
    return F.when(text.rlike("[\u3000\uff01-\uff5e]"), F.translate(text, _WIDE, _NARROW)).otherwise(text)


def strip_ws(text: Column) -> Column:
    """Without any Unicode white space."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")


def normalise(text: Column) -> Column:
    """Narrow and without white space; null counts as empty."""
    return strip_ws(to_halfwidth(F.coalesce(text, F.lit(""))))


def unify_radicals(text: Column) -> Column:
    """Kangxi radicals (U+2F00 to U+2FD5) as the characters they stand for."""
    return F.translate(text, _RADICALS, _UNIFIED)


def count_tokens(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(normalise(text))


def normalise_doc_number(text: Column) -> Column:
    return F.translate(normalise(text), "〔【〕】", "[[]]")


def chinese_to_int(text: Column) -> Column:
    """The value of a Chinese or Arabic numeral; null for anything else.

    A unit counts the non-zero digit right before it (or one); a last digit adds itself.
    """
    scaled = lambda t: (
        F.when((F.length(t) == 1) | t.startswith("0"), F.lit(1).cast("long")).otherwise(F.left(t, F.lit(1)).try_cast("long"))
        * F.when(t.endswith("十"), 10).when(t.endswith("百"), 100).otherwise(1000)
    )

    def value(s: Column) -> Column:
        plain = F.translate(s, DIGITS, DIGIT_VALUES)
        parts = F.regexp_extract_all(plain, F.lit(rf"(\d?[{UNITS}])"), F.lit(1))
        rest = F.coalesce(F.nullif(F.regexp_extract(plain, r"(\d)$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
        return F.when(s.rlike(r"^\d{1,18}$"), s.try_cast("long")).when(s.rlike(f"^[{NUMERAL}]+$"), F.aggregate(parts, rest, lambda a, t: a + scaled(t)))

    return let(normalise(text), value)


def clause_number(raw: Column) -> Column:
    """A clause number in its one form: ``N``, or ``N-K`` for inserted clauses; null if it has none."""
    numeral = rf"^([{NUMERAL}]+|\d+)(?:之([{NUMERAL}\d]+))?$"
    latin = r"^(\d+)(?i:(bis|ter|quater|quinquies))$"
    decimal = r"^(\d+)\.(\d+)[a-zA-Z]?$"
    inserts = F.create_map(*[F.lit(x) for pair in LATIN_INSERTS.items() for x in (pair[0], str(pair[1]))])

    def form(s: Column) -> Column:
        whole = lambda pattern, k: F.regexp_extract(s, pattern, k).try_cast("long").cast("string")
        insert = F.regexp_extract(s, numeral, 2)
        return (
            F.when(s.rlike(numeral), F.concat(chinese_to_int(F.regexp_extract(s, numeral, 1)).cast("string"), F.when(insert == "", F.lit("")).otherwise(F.concat(F.lit("-"), chinese_to_int(insert).cast("string")))))
            .when(s.rlike(latin), F.concat(whole(latin, 1), F.lit("-"), F.element_at(inserts, F.lower(F.regexp_extract(s, latin, 2)))))
            .when(s.rlike(decimal), F.concat(whole(decimal, 1), F.lit("-"), whole(decimal, 2)))
        )

    return let(normalise(raw), form)


def heading(text: Column) -> Column:
    """struct(level, number, label) if the line is a heading, else null.

    Levels 1 to 6 are chapter, section, article, paragraph, item and sub-item. A line that
    starts with an article number but goes on as a citation is no heading.
    """
    article = rf"^(?>第({_ARTICLE_NUM})条(?:之({_NUM}))?)(?![、，,;；的])(?!第{_NUM}[款项条])"
    decimal = r"^\s*(\d+(?:\.\d+){1,2})\s+(?!条)\S"
    item = rf"^(?:\(({_NUM})\)|({_NUM})、)"

    def found(level: Column, number: Column, label: Column) -> Column:
        return F.when(number.isNotNull(), F.struct(level.alias("level"), number.alias("number"), label.alias("label")))

    def first(pattern: str, level: Column | str, read: Callable[[Callable[[int], Column]], Column], s: Column, label: str) -> Column:
        """The heading that ``pattern`` finds in ``s``; evaluated only where it matches."""
        level = F.lit(LEVELS[level]) if isinstance(level, str) else level
        return F.when(s.rlike(pattern), found(level, read(lambda k: F.regexp_extract(s, pattern, k)), F.regexp_extract(s, label, 1)))

    def classify(half: Column) -> Column:
        def solid(s: Column) -> Column:
            plain = [first(f"^第({_NUM}){level}", level, lambda group: clause_number(group(1)), s, f"^(第{_NUM}{level})") for level in ("章", "节", "款")]
            inserted = first(article, "条", lambda group: clause_number(F.concat_ws("之", group(1), F.nullif(group(2), F.lit("")))), s, rf"^(第{_ARTICLE_NUM}条(?:之{_NUM})?)")
            items = first(item, "项", lambda group: clause_number(F.concat(group(1), group(2))), s, rf"^(\({_NUM}\)|{_NUM}、)")
            place = F.when(s != "", F.position(F.left(s, F.lit(1)), F.lit(CIRCLED))).otherwise(0)
            circled = F.when(place > 0, found(F.lit(LEVELS["目"]), place.cast("string"), F.left(s, F.lit(1))))
            return F.coalesce(*plain, inserted, first(decimal, "条", lambda group: group(1), half, r"^\s*(\d+(?:\.\d+){1,2})"), items, circled)

        return let(strip_ws(half), solid)

    return let(to_halfwidth(F.coalesce(text, F.lit(""))), classify)


def internal_references(text: Column) -> Column:
    """array<struct(level, number, surface)> of all clause mentions, white space aside."""
    s = normalise(text)
    pattern = rf"第({_ARTICLE_NUM})([章节条款项])(?:之({_NUM}))?"
    surfaces = F.regexp_extract_all(s, F.lit(rf"(第{_ARTICLE_NUM}[章节条款项](?:之{_NUM})?)"), F.lit(1))

    def one(surface: Column) -> Column:
        insert = F.regexp_extract(surface, pattern, 3)
        raw = F.concat(F.regexp_extract(surface, pattern, 1), F.when(insert != "", F.concat(F.lit("之"), insert)).otherwise(""))
        return F.struct(F.regexp_extract(surface, pattern, 2).alias("level"), clause_number(raw).alias("number"), surface.alias("surface"))

    return F.filter(F.transform(surfaces, one), lambda r: r["number"].isNotNull())


def chunk_id(version_id: Column, path: Column, seq: Column) -> Column:
    """The first 24 hex digits of SHA-1 over ``version|path|seq``."""
    return F.substring(F.sha1(F.concat_ws("|", version_id, path, seq.cast("string"))), 1, 24)


def number_key(number: Column) -> Column:
    """A clause number as an array of integers, which compares in clause order."""
    return F.transform(F.split(F.translate(number, "-", "."), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def path_key(path: Column) -> Column:
    """A clause path as an array of number keys; sorts in reading order."""
    return F.transform(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != ""), number_key)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes.

    No character has more than 4 bytes, so only the first ``most`` characters are looked at.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept"))
    chars = F.split(F.substring(text, 1, most), "(?!^)")
    end = F.aggregate(
        chars,
        start,
        lambda a, c: F.struct((a["n"] + F.octet_length(c)).alias("n"), F.when(a["n"] + F.octet_length(c) <= most, a["kept"] + F.length(c)).otherwise(a["kept"]).alias("kept")),
    )["kept"]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, end))


def excerpt(text: Column, n: int) -> Column:
    """The trimmed text, cut after ``n`` characters with an ellipsis."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n))), F.lit("…")))


def head_and_tail(text: Column, head: int, tail: int) -> Column:
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.left(text, F.lit(head)), F.right(text, F.lit(tail))))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def words_in(text: Column, words: tuple[str, ...]) -> Column:
    """The words that occur in the text, in the order given."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: text.contains(w)) if words else F.array().cast("array<string>")


def sampled(key: Column, rate: float) -> Column:
    """A decision by the key's SHA-1 that is true for about ``rate`` of all keys, and the same each time."""
    if rate <= 0 or rate >= 1:
        return F.lit(rate >= 1)
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF)) < rate


def garbled_ratio(text: Column) -> Column:
    """Replacement and control characters over all characters; 0 for an empty text."""
    bad = F.regexp_count(text, F.lit(r"[�\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def garbled_chars(text: Column) -> Column:
    """(garbled, all) characters besides white space."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", "")
    return F.struct(F.regexp_count(solid, F.lit(r"[�\x00-\x1F]")).alias("garbled"), F.length(solid).alias("total"))
