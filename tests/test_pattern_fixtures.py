"""Each of the 61 patterns on bars made by hand from its public definition: an exact hit, and the same bars with one thing wrong."""

import pandas as pd
import pytest

from tests.test_patterns import HAND_MADE, neutral
from wickspark.model import ALL_PATTERNS
from wickspark.operators import candles

BLACK, WHITE = (60, 60.2, 49.8, 50), (50, 60.2, 49.8, 60)
THREE = [(50, 53.1, 49.9, 53), (55, 58.1, 54.9, 58)]

# pattern: value, its bars after 14 neutral ones (bodies 55-56, ranges 54.5-56.5), {number of a bar: the bar that breaks it}
CASES = {
    "CDL2CROWS": (-100, [WHITE, (63, 63.3, 61.8, 62), (62.5, 62.6, 54.8, 55)], {2: (62.5, 62.6, 48.8, 49)}),
    "CDL3BLACKCROWS": (-100, [(55.8, 55.9, 53, 53.02), (54.5, 54.6, 51.5, 51.52), (53, 53.1, 49.9, 49.92)], {2: (53, 53.1, 47.9, 49.92)}),
    "CDL3INSIDE": (100, [BLACK, (54, 54.6, 53.9, 54.5), (55, 61, 54.9, 60.5)], {2: (55, 61, 54.9, 59)}),
    "CDL3LINESTRIKE": (100, [(50, 53.1, 49.9, 53), (52, 55.1, 51.9, 55), (54, 57.1, 53.9, 57), (58, 58.1, 49, 49.5)], {3: (58, 58.1, 49, 50.5)}),
    "CDL3OUTSIDE": (100, [(55.5, 55.7, 54.6, 54.8), (54.5, 56.6, 54.4, 56.5), (56.4, 57.6, 56.3, 57.5)], {2: (56.4, 57.6, 55.8, 56)}),
    "CDL3STARSINSOUTH": (100, HAND_MADE["CDL3STARSINSOUTH"], {2: (54.2, 55.5, 53.9, 53.91)}),
    "CDL3WHITESOLDIERS": (100, [(50, 52.02, 49.9, 52), (51, 53.52, 50.9, 53.5), (52.5, 55.02, 52.4, 55)], {2: (52.5, 57, 52.4, 55)}),
    "CDLABANDONEDBABY": (100, [BLACK, (48, 48.3, 47.7, 48), (50, 56, 49.9, 55.5)], {1: (48, 49.9, 47.7, 48)}),
    "CDLADVANCEBLOCK": (-100, [(50, 55.1, 49.9, 55), (54, 57.1, 53.9, 57), (56.5, 58.8, 56.4, 57.4)], {2: (56.5, 61.6, 56.4, 61.5)}),
    "CDLBELTHOLD": (100, [(50, 53, 50, 52.8)], {0: (50, 53, 49, 52.8)}),
    "CDLBREAKAWAY": (100, HAND_MADE["CDLBREAKAWAY"], {4: (45, 50, 44, 47.5)}),
    "CDLCLOSINGMARUBOZU": (100, [(50, 52.5, 49, 52.5)], {0: (50, 53.5, 49, 52.5)}),
    "CDLCONCEALBABYSWALL": (100, HAND_MADE["CDLCONCEALBABYSWALL"], {3: (53.5, 54, 47, 47.2)}),
    "CDLCOUNTERATTACK": (100, [BLACK, (40, 50.1, 39.9, 50)], {1: (40, 52.1, 39.9, 52)}),
    "CDLDARKCLOUDCOVER": (-100, [WHITE, (61, 61.2, 53.9, 54)], {1: (61, 61.2, 53.9, 56)}),
    "CDLDOJI": (100, [(55, 55.5, 54.5, 55.1)], {0: (55, 55.5, 54.5, 55.4)}),
    "CDLDOJISTAR": (-100, [WHITE, (62, 62.4, 61.5, 62.05)], {1: (59, 59.4, 58.5, 59.05)}),
    "CDLDRAGONFLYDOJI": (100, [(55, 55.05, 53, 55)], {0: (55, 56, 53, 55)}),
    "CDLENGULFING": (100, [(55.5, 55.7, 54.6, 54.8), (54.5, 56.6, 54.4, 56.5)], {1: (54.5, 56.6, 54.4, 55.4)}),
    "CDLEVENINGDOJISTAR": (-100, [WHITE, (62, 62.3, 61.7, 62.05), (60, 60.1, 54.9, 55)], {2: (60, 60.1, 54.9, 58)}),
    "CDLEVENINGSTAR": (-100, [WHITE, (61, 61.8, 60.8, 61.6), (60, 60.1, 54.9, 55)], {2: (60, 60.1, 54.9, 58)}),
    "CDLGAPSIDESIDEWHITE": (100, [(50, 53.1, 49.9, 53), (55, 56.1, 54.9, 56), (55.05, 56.2, 54.9, 56.1)], {2: (52.5, 56.2, 52.4, 56.1)}),
    "CDLGRAVESTONEDOJI": (100, [(55, 57, 54.98, 55)], {0: (55, 57, 53, 55)}),
    "CDLHAMMER": (100, [(54.2, 54.55, 52, 54.5)], {0: (58.2, 58.55, 56, 58.5)}),
    "CDLHANGINGMAN": (-100, [(58.2, 58.55, 56, 58.5)], {0: (54.2, 54.55, 52, 54.5)}),
    "CDLHARAMI": (100, [BLACK, (54, 54.6, 53.9, 54.5)], {1: (59.5, 60.6, 59.4, 60.5)}),
    "CDLHARAMICROSS": (100, [BLACK, (54, 54.6, 53.9, 54.02)], {1: (61, 61.3, 60.7, 61.02)}),
    "CDLHIGHWAVE": (100, [(55, 57, 53, 55.5)], {0: (55, 57, 54.5, 55.5)}),
    "CDLHIKKAKE": (100, [(54, 57, 53, 56), (54.5, 56, 54, 55), (54.3, 55.5, 53.5, 54.4)], {2: (54.3, 56.2, 53.5, 54.4)}),
    "CDLHIKKAKEMOD": (100, [(54, 58, 52, 56), (55, 57, 53, 53.1), (54, 56, 53.5, 55), (54, 55.5, 53.2, 54)], {1: (55, 57, 53, 56)}),
    "CDLHOMINGPIGEON": (100, [BLACK, (54.5, 54.6, 53.9, 54)], {1: (54, 54.6, 53.9, 54.5)}),
    "CDLIDENTICAL3CROWS": (-100, HAND_MADE["CDLIDENTICAL3CROWS"], {1: (63.5, 63.7, 62, 62.01)}),
    "CDLINNECK": (-100, [BLACK, (48, 50.1, 47.8, 50.05)], {1: (48, 51.1, 47.8, 51)}),
    "CDLINVERTEDHAMMER": (100, [(54, 56, 53.98, 54.3)], {0: (55.2, 57.2, 55.18, 55.5)}),
    "CDLKICKING": (100, [(55, 55.02, 51.98, 52), (57, 60.02, 56.98, 60)], {1: (54, 60.02, 53.98, 60)}),
    "CDLKICKINGBYLENGTH": (100, [(55, 55.02, 51.98, 52), (57, 61.02, 56.98, 61)], {1: (54, 61.02, 53.98, 61)}),
    "CDLLADDERBOTTOM": (100, HAND_MADE["CDLLADDERBOTTOM"], {4: (54.5, 57, 54, 56.5)}),
    "CDLLONGLEGGEDDOJI": (100, [(55, 56, 54, 55.05)], {0: (55, 56, 54, 55.5)}),
    "CDLLONGLINE": (100, [(50, 53.2, 49.8, 53)], {0: (50, 55, 49.8, 53)}),
    "CDLMARUBOZU": (100, [(50, 53.02, 49.98, 53)], {0: (50, 53.02, 49, 53)}),
    "CDLMATCHINGLOW": (100, [(60, 60.2, 53.8, 54), (56, 56.2, 53.9, 54.02)], {1: (56, 56.2, 53.9, 55)}),
    "CDLMATHOLD": (100, HAND_MADE["CDLMATHOLD"], {4: (60.5, 61.2, 60, 61)}),
    "CDLMORNINGDOJISTAR": (100, [BLACK, (48, 48.3, 47.7, 48.05), (50, 55.1, 49.9, 55)], {2: (50, 55.1, 49.9, 52)}),
    "CDLMORNINGSTAR": (100, [BLACK, (49, 49.2, 48.2, 48.4), (50, 55.1, 49.9, 55)], {2: (50, 55.1, 49.9, 52)}),
    "CDLONNECK": (-100, [BLACK, (48, 49.9, 47.8, 49.82)], {1: (48, 50.6, 47.8, 50.5)}),
    "CDLPIERCING": (100, [BLACK, (49, 56.1, 48.8, 56)], {1: (49, 56.1, 48.8, 54)}),
    "CDLRICKSHAWMAN": (100, [(55, 56, 54, 55.05)], {0: (54.1, 56, 54, 54.15)}),
    "CDLRISEFALL3METHODS": (100, HAND_MADE["CDLRISEFALL3METHODS"], {4: (57.5, 66, 57, 59.9)}),
    "CDLSEPARATINGLINES": (100, [(55, 55.5, 52.8, 53), (55, 58.2, 54.98, 58)], {1: (55, 58.2, 53, 58)}),
    "CDLSHOOTINGSTAR": (-100, [(57.3, 60, 56.98, 57)], {0: (55.5, 58, 55.18, 55.2)}),
    "CDLSHORTLINE": (100, [(55, 55.9, 54.7, 55.5)], {0: (55, 57, 54.7, 55.5)}),
    "CDLSPINNINGTOP": (100, [(55, 56.3, 54.2, 55.5)], {0: (55, 55.8, 54.2, 55.5)}),
    "CDLSTALLEDPATTERN": (-100, [(50, 53.1, 49.9, 53), (52, 56.02, 51.9, 56), (55.8, 56.7, 55.7, 56.3)], {2: (55.8, 59.7, 55.7, 59.3)}),
    "CDLSTICKSANDWICH": (100, [(56, 56.2, 53.8, 54), (54.5, 57.1, 54.4, 57), (57.2, 57.4, 53.8, 54.02)], {2: (57.2, 57.4, 53.8, 55)}),
    "CDLTAKURI": (100, [(55, 55.05, 53, 55.02)], {0: (55, 55.05, 54.98, 55.02)}),
    "CDLTASUKIGAP": (100, [*THREE, (57, 57.2, 53.8, 54)], {2: (57, 57.2, 53.8, 55.5)}),
    "CDLTHRUSTING": (-100, [BLACK, (48, 53.1, 47.8, 53)], {1: (48, 56.1, 47.8, 56)}),
    "CDLTRISTAR": (-100, [(55, 55.5, 54.5, 55.05), (57, 57.5, 56.5, 57.05), (55.5, 56, 55, 55.55)], {1: (55, 55.5, 54.5, 55.02)}),
    "CDLUNIQUE3RIVER": (100, [(60, 60.2, 51.8, 52), (55, 55.1, 48, 53), (51, 51.7, 50, 51.5)], {1: (55, 55.1, 52.5, 53)}),
    "CDLUPSIDEGAP2CROWS": (-100, HAND_MADE["CDLUPSIDEGAP2CROWS"], {2: (62.5, 62.7, 60.5, 61.8)}),
    "CDLXSIDEGAP3METHODS": (100, [*THREE, (57, 57.2, 51.8, 52)], {2: (57, 57.2, 51.8, 54)}),
}


def mirrored(bars):
    """Rises become falls: 110 minus each price."""
    return [(110 - o, 110 - low, 110 - h, 110 - c) for o, h, low, c in bars]


@pytest.fixture(scope="module")
def values(spark):
    """Values of a case's pattern on all bars of each kind."""
    frames = []
    for name, (_, bars, wrong) in CASES.items():
        broken = [wrong.get(k, bar) for k, bar in enumerate(bars)]
        for kind, rows in (("hit", neutral(14) + bars), ("miss", neutral(14) + broken), ("mirror", mirrored(neutral(14) + bars))):
            pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
            pdf.insert(0, "trade_date", pd.bdate_range("2020-01-01", periods=len(rows)).date)
            pdf.insert(0, "code", f"{name}:{kind}")
            frames.append(pdf)
    out = candles.patterns(spark.createDataFrame(pd.concat(frames)), list(CASES)).toPandas().sort_values(["code", "trade_date"])
    return {code: part[code.split(":")[0]].tolist() for code, part in out.groupby("code")}


def test_all_patterns_have_a_fixture():
    assert sorted(CASES) == sorted(ALL_PATTERNS)


@pytest.mark.parametrize("name", sorted(CASES))
def test_hit_and_miss(values, name):
    assert values[f"{name}:hit"][-1] == CASES[name][0]
    assert values[f"{name}:miss"][-1] == 0


#: Patterns with a bullish and a bearish form: on the mirrored bars the other one appears.
TWO_SIDED = """CDL3INSIDE CDL3LINESTRIKE CDL3OUTSIDE CDLABANDONEDBABY CDLBELTHOLD CDLBREAKAWAY CDLCLOSINGMARUBOZU CDLCOUNTERATTACK CDLDOJISTAR CDLENGULFING
CDLHARAMI CDLHARAMICROSS CDLHIGHWAVE CDLHIKKAKE CDLHIKKAKEMOD CDLKICKING CDLKICKINGBYLENGTH CDLLONGLINE CDLMARUBOZU CDLRISEFALL3METHODS CDLSEPARATINGLINES CDLSHORTLINE
CDLSPINNINGTOP CDLTASUKIGAP CDLTRISTAR CDLXSIDEGAP3METHODS""".split()


@pytest.mark.parametrize("name", TWO_SIDED)
def test_mirror(values, name):
    assert values[f"{name}:mirror"][-1] == -CASES[name][0]


def test_morning_and_evening_are_mirrors(spark):
    names = {"CDLMORNINGSTAR": "CDLEVENINGSTAR", "CDLMORNINGDOJISTAR": "CDLEVENINGDOJISTAR", "CDLEVENINGSTAR": "CDLMORNINGSTAR"}
    for name, other in names.items():
        rows = mirrored(neutral(14) + CASES[name][1])
        pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
        pdf.insert(0, "trade_date", pd.bdate_range("2020-01-01", periods=len(rows)).date)
        pdf.insert(0, "code", "600000.SH")
        assert candles.patterns(spark.createDataFrame(pdf), [other]).orderBy("trade_date").toPandas()[other].tolist()[-1] == -CASES[name][0]
