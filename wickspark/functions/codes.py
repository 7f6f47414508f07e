"""Security code rules (F1-F7, F13) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickspark.model import DOMESTIC_INDEXES, OVERSEAS_INDEXES

# Code prefixes of the boards, and vendor names of overseas indexes.
ETF_PREFIXES = ("510", "511", "512", "513", "515", "516", "518", "520", "561", "562", "563", "588", "159")
SZ_MAIN = ("000", "001", "002", "003")
SH_MAIN = ("600", "601", "603", "605")
GROUP_ETF_PREFIXES = ("15", "16", "51")
HISTORY_SYMBOLS = {"000300.SH": "sh000300", "399006.SZ": "sz399006",
                   "DJI": ".DJI", "SPX": ".INX", "IXIC": ".IXIC"}
QUOTE_SYMBOLS = {"DJI": "gb_dji", "SPX": "gb_inx", "IXIC": "gb_ixic"}


def _starts(code: Column, prefixes) -> Column:
    return F.substring(code, 1, len(prefixes[0])).isin(*prefixes)


def is_index(code: Column) -> Column:
    """overseas names, 000/880 in Shanghai, 399 in Shenzhen."""
    sh = code.endswith(".SH") & _starts(code, ("000", "880"))
    sz = code.endswith(".SZ") & code.startswith("399")
    return code.isin(*OVERSEAS_INDEXES) | sh | sz


def classify_board(code: Column) -> Column:
    """hs / cy / kc / index / etf / excluded, first rule wins."""
    sh, sz = code.endswith(".SH"), code.endswith(".SZ")
    etf_home = (sh & code.startswith("5")) | (sz & code.startswith("15"))
    return (F.when(code.isin(*OVERSEAS_INDEXES), "index")
            .when(code.endswith(".BJ"), "excluded")
            .when(is_index(code), "index")
            .when(sz & _starts(code, ("300", "301")), "cy")
            .when(sh & code.startswith("688"), "kc")
            .when(etf_home & _starts(code, ETF_PREFIXES), "etf")
            .when(sh | sz, "hs")
            .otherwise("index"))


def is_index_short(code: Column) -> Column:
    """fewer than nine characters, or one of the two domestic indexes."""
    return (F.length(code) < 9) | code.isin(*DOMESTIC_INDEXES)


def perf_group(code: Column) -> Column:
    """index / etf / stock, the split of the performance tables."""
    return (F.when(is_index_short(code), "index")
            .when(_starts(code, GROUP_ETF_PREFIXES), "etf").otherwise("stock"))


def normalize_code(raw: Column, hint: Column | None = None) -> Column:
    """strip a market prefix and add the market suffix by hint or first digits."""
    text = F.upper(F.trim(raw))
    found = F.regexp_extract(text, "^(SH|SZ|BJ)", 1)
    code = F.regexp_replace(text, "^(SH|SZ|BJ)", "")
    market = F.when(found != "", F.lower(found)).otherwise(
        F.coalesce(F.lower(hint) if hint is not None else F.lit(None).cast("string"), F.lit("")))
    digits = code.rlike("^[0-9]{6}$")
    by_digits = (F.when((market == "sh") | code.rlike("^(5|6|9|11)"), "SH")
                 .when((market == "bj") | code.rlike("^[84]"), "BJ").otherwise("SZ"))
    by_hint = F.when(market.isin("sh", "sz", "bj"), F.upper(market)).otherwise("SZ")
    return F.when(code == "", "").otherwise(
        F.concat(code, F.lit("."), F.when(digits, by_digits).otherwise(by_hint)))


def _lookup(code: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(code == key, value).otherwise(out)
    return out


def _six_digits_in(code: Column, suffix: str) -> Column:
    return (F.length(code) == 9) & code.endswith(suffix)


def history_symbol(code: Column) -> Column:
    """symbol at the history vendor; null where it has none."""
    plain = F.when(_six_digits_in(code, ".SH") | _six_digits_in(code, ".SZ"), F.substring(code, 1, 6))
    return F.coalesce(_lookup(code, HISTORY_SYMBOLS), plain)


def quote_symbol(code: Column) -> Column:
    """symbol at the quote vendor; null where it has none."""
    return (F.when(_six_digits_in(code, ".SH"), F.concat(F.lit("sh"), F.substring(code, 1, 6)))
            .when(_six_digits_in(code, ".SZ"), F.concat(F.lit("sz"), F.substring(code, 1, 6)))
            .otherwise(_lookup(code, QUOTE_SYMBOLS)))


def stock_code(code6: Column) -> Column:
    """six digits of a stock -> code with suffix."""
    return F.concat(code6, F.when(code6.startswith("6"), ".SH").otherwise(".SZ"))


def etf_code(code6: Column) -> Column:
    """six digits of a fund -> code with suffix, null when neither 5 nor 1 leads."""
    return (F.when(code6.startswith("5"), F.concat(code6, F.lit(".SH")))
            .when(code6.startswith("1"), F.concat(code6, F.lit(".SZ"))))


def listed_in_beijing(code: Column) -> Column:
    """codes the sources cannot serve."""
    return code.endswith(".BJ")
