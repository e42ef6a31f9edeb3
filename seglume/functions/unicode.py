"""Normal forms of texts: compatibility forms by an Arrow function, variant characters by a table in ``translate``."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from seglume.functions import parsing
from seglume.functions.text import _col, replace_all


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Arrow's own normal forms leave letters and marks apart; texts in ASCII, which most are, stay as they are
    plain = pc.string_is_ascii(texts).to_pylist()
    return pa.array([x if ascii_ else unicodedata.normalize("NFKC", x) for x, ascii_ in zip(texts.to_pylist(), plain)], pa.string())


def nfkc(text: str | Column) -> Column:
    """Wide letters, ligatures and other compatibility forms as plain ones."""
    return _nfkc(_col(text))


#: Common traditional and Japanese forms, and the simplified forms, place by place. More are a parameter.
TRADITIONAL = "這個們來說時會對過還沒開關門問間東車馬魚鳥龍話語讀書學國園圖團長張場見觀親覺風飛電雲氣發後裡裏麼為與無萬億"
SIMPLIFIED = "这个们来说时会对过还没开关门问间东车马鱼鸟龙话语读书学国园图团长张场见观亲觉风飞电云气发后里里么为与无万亿"


def simplified(text: str | Column, forms: tuple[str, str] = (TRADITIONAL, SIMPLIFIED)) -> Column:
    """Variant characters as simplified ones."""
    return F.translate(_col(text), *forms)


def cjk_key(text: str | Column, forms: tuple[str, str] = (TRADITIONAL, SIMPLIFIED)) -> Column:
    """Simplified, Han and Latin letters and digits only."""
    return replace_all(simplified(text, forms), (r"[^一-鿿A-Za-z0-9]", ""))


def source_key(text: str | Column, forms: tuple[str, str] | None = (TRADITIONAL, SIMPLIFIED)) -> Column:
    """For comparing source texts: compatibility forms first, then variants, Han numerals as digits, no numbering before the
    text (which the numerals must not make up), letters and digits only, in lower case."""
    plain = replace_all(nfkc(text), (r"^\s*\[\d+\][.:\s]*", ""), (r"^\s*\d+[.:\-]\s+", ""))
    plain = simplified(plain, forms) if forms else plain
    # one pandas function after the Arrow one: both work on whole batches
    return F.lower(replace_all(parsing.texts(parsing.arabic_numerals)(plain), (r"[^一-鿿A-Za-z0-9]", "")))
