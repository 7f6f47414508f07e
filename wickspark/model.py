"""Data model: column names, schemas, trading constants and the pattern catalogue.

Bars are one row per (code, trade_date) with trade_date a DATE.  That key is what bounds every
per-code window, sort and fold in the library: a code can hold at most one row per calendar day
(about 36,500 rows in a century), however many raw rows arrived for it.  Everything that touches
raw rows (several per code and day) is an algebraic aggregate with map-side combine instead.
"""

from __future__ import annotations

from pyspark.sql import types as T

CODE = "code"
DATE = "trade_date"

BAR_SCHEMA = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("trade_date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("vol", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("pct_chg", T.DoubleType()),
    T.StructField("turnover_rate", T.DoubleType()),
])
OHLC = ("open", "high", "low", "close")
BAR_VALUES = tuple(f.name for f in BAR_SCHEMA.fields[2:])

# Trading rules.
START_CASH = 100_000_000.0
COMMISSION = 0.0001
INVEST_FRACTION = 0.995
LOT = 100
STOP_LOSS = -0.03
STOP_LABEL = "3%止损"
HOLD_DAYS = 2
YEAR_BARS = 252
MIN_YEARS = 0.01
LOOK_BACK = 25  # bars before a day that are enough for every pattern and rule of its signals
COVER_START_SLACK = 10
COVER_END_SLACK = 5
CYCLE_REVERSAL = 0.08
CYCLE_MIN_DAYS = 22
CYCLE_CLASSIFY = 0.05
CYCLE_SUB_FACTOR = 0.6

# Pattern codes and their display names.
PATTERN_NAMES = {
    "CDL2CROWS": "两只乌鸦",
    "CDL3BLACKCROWS": "三只乌鸦",
    "CDL3INSIDE": "三内部上涨",
    "CDL3LINESTRIKE": "三线打击",
    "CDL3OUTSIDE": "三外部上涨",
    "CDL3STARSINSOUTH": "南方三星",
    "CDL3WHITESOLDIERS": "三个白兵",
    "CDLABANDONEDBABY": "弃婴",
    "CDLADVANCEBLOCK": "大敌当前",
    "CDLBELTHOLD": "腰带线",
    "CDLBREAKAWAY": "脱离形态",
    "CDLCLOSINGMARUBOZU": "收盘缺影线",
    "CDLCONCEALBABYSWALL": "藏婴吞没",
    "CDLCOUNTERATTACK": "反击线",
    "CDLDARKCLOUDCOVER": "乌云盖顶",
    "CDLDOJI": "十字星",
    "CDLDOJISTAR": "十字星",
    "CDLDRAGONFLYDOJI": "蜻蜓十字",
    "CDLENGULFING": "吞没形态",
    "CDLEVENINGDOJISTAR": "黄昏十字星",
    "CDLEVENINGSTAR": "黄昏之星",
    "CDLGAPSIDESIDEWHITE": "跳空并列白线",
    "CDLGRAVESTONEDOJI": "墓碑十字",
    "CDLHAMMER": "锤子线",
    "CDLHANGINGMAN": "吊颈线",
    "CDLHARAMI": "孕线",
    "CDLHARAMICROSS": "十字孕线",
    "CDLHIGHWAVE": "风高浪大线",
    "CDLHIKKAKE": "陷阱形态",
    "CDLHIKKAKEMOD": "修正陷阱",
    "CDLHOMINGPIGEON": "家鸽形态",
    "CDLIDENTICAL3CROWS": "三胞胎乌鸦",
    "CDLINNECK": "颈内线",
    "CDLINVERTEDHAMMER": "倒锤子",
    "CDLKICKING": "反冲形态",
    "CDLKICKINGBYLENGTH": "反冲形态",
    "CDLLADDERBOTTOM": "梯形底部",
    "CDLLONGLEGGEDDOJI": "长脚十字",
    "CDLLONGLINE": "长蜡烛",
    "CDLMARUBOZU": "光头光脚",
    "CDLMATCHINGLOW": "相同低价",
    "CDLMATHOLD": "涨停形态",
    "CDLMORNINGDOJISTAR": "早晨十字星",
    "CDLMORNINGSTAR": "早晨之星",
    "CDLONNECK": "颈上线",
    "CDLPIERCING": "刺透形态",
    "CDLRICKSHAWMAN": "黄包车夫",
    "CDLRISEFALL3METHODS": "上涨/下跌三法",
    "CDLSEPARATINGLINES": "分手线",
    "CDLSHOOTINGSTAR": "射击之星",
    "CDLSHORTLINE": "短蜡烛",
    "CDLSPINNINGTOP": "纺锤线",
    "CDLSTALLEDPATTERN": "停顿形态",
    "CDLSTICKSANDWICH": "棒三明治",
    "CDLTAKURI": "探水竿",
    "CDLTASUKIGAP": "跳空缺口",
    "CDLTHRUSTING": "插入形态",
    "CDLTRISTAR": "三星形态",
    "CDLUNIQUE3RIVER": "奇特三川",
    "CDLUPSIDEGAP2CROWS": "上升缺口两乌鸦",
    "CDLXSIDEGAP3METHODS": "上升/下降跳空三法",
}
# The sell class; every other pattern is in the buy class.
SELL_CLASS = (
    "CDL2CROWS", "CDL3BLACKCROWS", "CDL3LINESTRIKE", "CDL3STARSINSOUTH", "CDL3WHITESOLDIERS",
    "CDLABANDONEDBABY", "CDLADVANCEBLOCK", "CDLBREAKAWAY", "CDLCONCEALBABYSWALL",
    "CDLDARKCLOUDCOVER", "CDLEVENINGDOJISTAR", "CDLEVENINGSTAR", "CDLHANGINGMAN",
    "CDLIDENTICAL3CROWS", "CDLINNECK", "CDLMATHOLD", "CDLONNECK", "CDLSHOOTINGSTAR",
    "CDLSTALLEDPATTERN", "CDLTHRUSTING", "CDLTRISTAR", "CDLUPSIDEGAP2CROWS",
)
# Patterns the daily signal list leaves out, patterns with a cautious rule, the
# reported alias, index codes and quote symbols.
NOT_DAILY = ("CDLMATHOLD", "CDLONNECK")
CAUTIOUS = ("CDLMARUBOZU", "CDLDRAGONFLYDOJI", "CDLINVERTEDHAMMER", "CDLSEPARATINGLINES",
            "CDLTAKURI", "CDLTASUKIGAP")
PATTERN_ALIAS = {"CDL2CROWS": "CDLADVANCEBLOCK"}
OVERSEAS_INDEXES = ("DJI", "FCHI", "SPX", "GDAXI", "N225")
TRACKED_INDEXES = {"DJI": "道琼斯指数", "FCHI": "法国CAC40", "SPX": "标普500", "GDAXI": "德国DAX",
                   "N225": "日经225", "000300.SH": "沪深300", "399006.SZ": "创业板指"}
DOMESTIC_INDEXES = ("000300.SH", "399006.SZ")

ALL_PATTERNS = tuple(PATTERN_NAMES)
BUY_CLASS = tuple(p for p in ALL_PATTERNS if p not in SELL_CLASS)
_daily_buy_class = tuple(p for p in BUY_CLASS if p not in NOT_DAILY)
_daily_sell_class = tuple(p for p in SELL_CLASS if p not in NOT_DAILY)
# List order matters where "the last match wins": the own class first, the other class after it.
DAILY_BUY_ORDER = _daily_buy_class + _daily_sell_class
DAILY_SELL_ORDER = _daily_sell_class + _daily_buy_class
DAILY_PATTERNS = DAILY_BUY_ORDER
