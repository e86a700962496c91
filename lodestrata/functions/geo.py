"""The region dimension and detection of regions in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _bare, _filled

# ISO code order, slug (its capitalised form is the English name), Japanese name.
REGIONS = """
01 hokkaido 北海道, 02 aomori 青森県, 03 iwate 岩手県, 04 miyagi 宮城県, 05 akita 秋田県, 06 yamagata 山形県, 07 fukushima 福島県,
08 ibaraki 茨城県, 09 tochigi 栃木県, 10 gunma 群馬県, 11 saitama 埼玉県, 12 chiba 千葉県, 13 tokyo 東京都, 14 kanagawa 神奈川県,
15 niigata 新潟県, 16 toyama 富山県, 17 ishikawa 石川県, 18 fukui 福井県, 19 yamanashi 山梨県, 20 nagano 長野県, 21 gifu 岐阜県,
22 shizuoka 静岡県, 23 aichi 愛知県, 24 mie 三重県, 25 shiga 滋賀県, 26 kyoto 京都府, 27 osaka 大阪府, 28 hyogo 兵庫県,
29 nara 奈良県, 30 wakayama 和歌山県, 31 tottori 鳥取県, 32 shimane 島根県, 33 okayama 岡山県, 34 hiroshima 広島県,
35 yamaguchi 山口県, 36 tokushima 徳島県, 37 kagawa 香川県, 38 ehime 愛媛県, 39 kochi 高知県, 40 fukuoka 福岡県, 41 saga 佐賀県,
42 nagasaki 長崎県, 43 kumamoto 熊本県, 44 oita 大分県, 45 miyazaki 宮崎県, 46 kagoshima 鹿児島県, 47 okinawa 沖縄県
"""
ROWS = [tuple(x.split()) for x in REGIONS.replace("\n", " ").split(",")]


def regions(spark: SparkSession) -> DataFrame:
    """code, slug, name, japanese: 47 rows."""
    return spark.createDataFrame([(c, s, s.capitalize(), j) for c, s, j in ROWS], "code string, slug string, name string, japanese string")


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


def code_to_slug(c: Column) -> Column:
    return F.try_element_at(_map([(c, s) for c, s, _ in ROWS]), c)


def code_to_name(c: Column) -> Column:
    return F.try_element_at(_map([(c, s.capitalize()) for c, s, _ in ROWS]), c)


def slug_to_code(c: Column) -> Column:
    return F.try_element_at(_map([(s, c) for c, s, _ in ROWS]), F.lower(c))


def slug_to_name(c: Column) -> Column:
    return F.try_element_at(_map([(s, s.capitalize()) for _, s, _ in ROWS]), c)


def detect_region(text: Column, unicode: bool = True) -> Column:
    """Slug of the first region in code order whose name occurs anywhere in the text."""
    bare = _bare(_filled(text)) if unicode else F.lower(_filled(text))
    short = lambda j: j if j == "北海道" else j.rstrip("都府県") if j != "京都府" else "京都"
    return F.coalesce(*(F.when(F.contains(text, F.lit(short(j))) | F.contains(bare, F.lit(s)), F.lit(s)) for _, s, j in ROWS))
