"""Column expressions that normalise text, dates, companies and category signals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that must be the same for equal results.
COMPANY_FORMS = r"株式会社|合同会社|有限会社|incorporated|corporation|\binc\.?\b|\bltd\.?\b|\bco\.?\s*,?\s*ltd\.?\b"
ANALYSIS_COMPANY_FORMS = r"株式会社|合同会社|有限会社|inc\.?|ltd\.?|co\.?\s*,?\s*ltd\.?"
CANONICAL_DROP = "[^0-9a-zぁ-んァ-ン一-龥]+"
REMOTE = r"remote|work\s*from\s*home|telecommut|リモート|在宅勤務|在宅ワーク|hybrid|ハイブリッド"
LANGUAGES = {
    "bilingual": r"\bbilingual\b|バイリンガル|日英",
    "english": r"\benglish\b|英語|英会話",
    "japanese": r"\bjapanese\b|日本語|jlpt|n[1-5]\b",
}
EMPLOYMENT = {
    "parttime": r"part[ -]?time|アルバイト|パート",
    "contract": r"contract|契約社員|有期雇用",
    "dispatch": r"dispatch|派遣",
    "freelance": r"freelance|業務委託|フリーランス",
    "intern": r"intern|インターン",
    "fulltime": r"full[ -]?time|正社員",
}

#: Flags of regular expressions that read Unicode as the rules mean it.
_I = "(?iuU)"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _bare(s: pd.Series) -> pd.Series:
    """Case-folded without accents."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x).casefold() if not unicodedata.combining(c)), na_action="ignore")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfkc(c: Column, unicode: bool = True) -> Column:
    """Compatibility composition; unicode=False for text that is known to have none, and stays in the JVM."""
    return _nfkc(_filled(c)) if unicode else _filled(c)


def folded(c: Column, unicode: bool = True) -> Column:
    return _nfkc_fold(_filled(c)) if unicode else F.replace(F.lower(_filled(c)), F.lit("ß"), F.lit("ss"))


def clean_text(c: Column, unicode: bool = True) -> Column:
    """NFKC, white space of any kind to one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(nfkc(c, unicode), r"(?U)[\s\x1c-\x1f]+", " "))


def canonical_text(c: Column, unicode: bool = True, forms: bool = False) -> Column:
    """Folded, without company forms unless `forms` keeps them, of digits, a-z, kana and kanji only."""
    t = folded(c, unicode)
    return F.regexp_replace(t if forms else F.regexp_replace(t, f"(?U){COMPANY_FORMS}", ""), CANONICAL_DROP, "")


def analysis_text(c: Column, unicode: bool = True) -> Column:
    """The older rule of quality reports: company forms also inside words, two of them unknown."""
    return F.regexp_replace(F.regexp_replace(folded(c, unicode), f"(?U){ANALYSIS_COMPANY_FORMS}", ""), CANONICAL_DROP, "")


def normalize_company(c: Column, unicode: bool = True) -> Column:
    """clean_text() without one trailing tagline of 5 to 80 characters."""
    return F.regexp_replace(clean_text(c, unicode), r"(?U)\s*[・|]\s*[^|・]{5,80}$", "")


def infer_employment(c: Column) -> Column:
    """The first employment type whose pattern occurs; null if none does."""
    return F.coalesce(*(F.when(c.rlike(_I + p), F.lit(k)) for k, p in EMPLOYMENT.items()))


def infer_languages(c: Column) -> Column:
    found = F.array(*(F.when(c.rlike(_I + p), F.lit(k)) for k, p in LANGUAGES.items()))
    return F.array_compact(found)


def infer_remote(c: Column) -> Column:
    return _filled(c).rlike(_I + REMOTE)


def _strict_date(c: Column, formats: dict[str, str]) -> Column:
    """First reading of text as a date by (shape, format); timestamps give their local day."""
    iso = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$", 1)
    compact = F.regexp_extract(c, r"^(\d{8})$", 1)
    ways = [F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), F.try_to_date(F.when(compact != "", compact), "yyyyMMdd")]
    ways += [F.try_to_date(F.when(c.rlike(shape), c), form) for shape, form in formats.items()]
    return F.coalesce(*ways)


#: Shapes and formats after ISO; month names in any case, as parsers of them are.
DATES = {
    r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d",
    r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    r"^\d{4}年\d{1,2}月\d{1,2}日$": "yyyy年M月d日",
}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _named_month(c: Column) -> Column:
    """Month d, yyyy with full or short names, as yyyy-M-d."""
    name = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)\s+\d{1,2},\s+\d{4}$", 1))
    number = F.coalesce(*(F.when(name.isin(m.lower(), m.lower()[:3]), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    rest = F.concat(F.regexp_extract(c, r"(\d{4})$", 1), F.lit("-"), number.cast("string"), F.lit("-"), F.regexp_extract(c, r"^[A-Za-z]+\s+(\d{1,2}),", 1))
    return F.try_to_date(rest, "yyyy-M-d")


def parse_date(c: Column, unicode: bool = True) -> Column:
    """Date of a text in any known format, else null; offsets don't move the day."""
    text = clean_text(c, unicode)
    return F.coalesce(_strict_date(text, DATES), _named_month(text))


def analysis_date(c: Column) -> Column:
    """The older rule of quality reports: no slashes, no kanji, text only trimmed."""
    text = F.trim(c)
    return F.coalesce(_strict_date(text, {r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d"}), _named_month(text))


def normalize_date(c: Column, unicode: bool = True) -> Column:
    return F.date_format(parse_date(c, unicode), "yyyy-MM-dd")


def relative_date(c: Column, as_of: Column) -> Column:
    """ISO day of texts like "4 days ago"; null for any other text."""
    t = F.lower(clean_text(c, unicode=False))
    unit = F.regexp_extract(t, r"(\d+)\s*(day|week|month|year)", 2)
    n = F.regexp_extract(t, r"(\d+)\s*(day|week|month|year)", 1).try_cast("int")
    days = n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)
    day = F.when(t.rlike(r"second|minute|hour|just now|today"), as_of).when(days.isNotNull(), F.date_sub(as_of, days))
    return F.date_format(day, "yyyy-MM-dd")


def html_to_text(c: Column) -> Column:
    """Text of an HTML fragment: tags are borders, comments, scripts and styles go, common entities are read."""
    t = F.regexp_replace(_filled(c), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[a-z/!?][^>]*>", " ")
    for name, sign in {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "amp": "&"}.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def numbers_in(c: Column) -> Column:
    """All whole numbers of a text, with thousands separators or not."""
    found = F.regexp_extract_all(F.regexp_replace(_filled(c), r"(?<=\d),(?=\d)", ""), F.lit(r"(\d+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def wage_from_text(c: Column) -> Column:
    """Wage struct of a text: first and last number, unit by its word, the text itself."""
    n = numbers_in(c)
    unit = F.when(c.rlike("(?i)hour|時給"), "hourly").when(c.rlike("(?i)month|月給"), "monthly").when(c.rlike("(?i)year|annual|年俸|年収"), "annual")
    return F.struct(F.get(n, 0).alias("min"), F.get(n, F.size(n) - 1).alias("max"), unit.alias("unit"), _filled(c).alias("raw"))


def evidence(text: Column, pattern: str) -> Column:
    """The sentence around the first match, at most 500 characters; null without a match."""
    flags = "(?iuU)"
    head = F.regexp_extract(text, rf"(?s){flags}^(.*?)(?:{pattern})", 1)
    match = F.regexp_extract(text, rf"{flags}(?:{pattern})", 0)
    tail = F.substr(text, F.char_length(head) + F.char_length(match) + 1)
    before = F.regexp_extract(head, r"([^.。\n]*)$", 1)
    after = F.when(tail.rlike(r"[.。\n]"), F.regexp_extract(tail, r"^([^.。\n]*[.。\n])", 1)).otherwise(F.substring(tail, 1, 160))
    sentence = F.trim(F.regexp_replace(F.concat(before, match, after), r"(?U)\s+", " "))
    return F.when(text.rlike(flags + f"(?:{pattern})"), F.substring(sentence, 1, 500))


# Kind, value, pattern and confidence of explicit signals.
SIGNALS = [
    ("visa", "possible_support", r"\bvisa sponsorship\b|ビザ(?:サポート|支援)|就労ビザ", 0.92),
    ("overseas", "supported", r"overseas applicants?|apply from overseas|海外(?:在住|応募)", 0.94),
    ("language", "n1_required", r"(?:JLPT\s*)?N1\s+(?:is\s+)?required|日本語能力試験\s*N1", 0.98),
    ("language", "n2_required", r"(?:JLPT\s*)?N2\s+(?:is\s+)?required|日本語能力試験\s*N2", 0.98),
    ("remote", "available", r"\bfully remote\b|\bremote work (?:is )?available\b|フルリモート", 0.93),
]
EXTRACTOR = "listing-rules-v1"


def signals(text: Column, rules: list[tuple[str, str, str, float]] = SIGNALS) -> Column:
    """Array of (kind, value, confidence, evidence, extractorVersion) of the rules that match."""
    each = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(c).alias("confidence"), evidence(text, p).alias("evidence"), F.lit(EXTRACTOR).alias("extractorVersion")) for k, v, p, c in rules]
    return F.filter(F.array(*each), lambda s: F.coalesce(s["evidence"], F.lit("")) != "")
