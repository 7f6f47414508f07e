"""Random bar series and a bar-by-bar account: the plain form of the trade rules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def random_bars(codes: int, n: int, seed: int, step: float = 0.5, start: float = 50.0) -> pd.DataFrame:
    """Coarse prices (multiples of `step`), so that ties and rare shapes occur often."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(codes):
        size = int(rng.integers(max(1, n // 2), n + 1))
        quiet = rng.choice([1, 2, 4, 8], size=size)
        close = np.maximum(start + np.cumsum(rng.integers(-4, 5, size) * quiet / 4) * step, 5 * step)
        open_ = np.maximum(close + rng.integers(-6, 7, size) * step, step)
        high = np.maximum(open_, close) + rng.integers(0, 4, size) * rng.integers(0, 2, size) * step
        low = np.maximum(np.minimum(open_, close) - rng.integers(0, 4, size) * rng.integers(0, 2, size) * step, step / 2)
        days = pd.bdate_range("2020-01-01", periods=size)
        out.append(pd.DataFrame({"code": f"{600000 + k}.SH", "trade_date": days.date, "open": open_, "high": high,
                                 "low": low, "close": close, "vol": rng.integers(1, 99, size).astype(float)}))
    return pd.concat(out, ignore_index=True)


def run_account(opens, closes, signal, side, hold, cash, combined=False):
    """Walk the bars one by one.  signal[i]: may the next bar open a position?"""
    trades, equity = [], []
    pos = entry = size = 0
    e = -1
    pending = False
    peak = dd = 0.0
    sg = 1 if side == "buy" else -1
    held_total = 0
    fee = 0.0001
    size = 0

    def close_at(i, price, why, held):
        nonlocal cash, size
        pct = (price / entry - 1) * 100 if sg > 0 else (entry / price - 1) * 100
        trades.append({"entry_idx": e, "exit_idx": i, "exit_reason": why, "size": size, "pnl_pct": pct, "dd": dd, "held": held})
        cash = cash + size * price * (1 - fee) if sg > 0 else cash - size * price * (1 + fee)
        size = 0

    held = 0
    for i in range(len(opens)):
        if size and pending:
            close_at(i, opens[i], "stop", held)
            pending = False
        if combined and size and i - e == hold:
            close_at(i, opens[i], "hold", held)
        if i and signal[i - 1] and not size and opens[i] > 0:
            lots = math.floor(math.floor(cash * 0.995 / opens[i]) / 100) * 100
            if lots > 0:
                size, entry, e, held = lots, opens[i], i, 0
                cash = cash - size * entry * (1 + fee) if sg > 0 else cash + size * entry * (1 - fee)
                peak, dd = cash + sg * size * entry, 0.0
        if size:
            value = cash + sg * size * closes[i]
            equity.append(value)
            held += 1
            held_total += 1
            peak = max(peak, value)
            if peak > 0:
                dd = max(dd, (peak - value) / peak * 100)
        else:
            equity.append(cash)
        if sg > 0 and size and i > e and closes[i] / entry - 1 <= -0.03:
            pending = True
        if not combined and size and i - e >= hold and not pending:
            close_at(i, opens[i], "hold", held)
    if size:
        close_at(len(opens) - 1, closes[-1], "end", held)
        equity[-1] = cash
    return trades, equity, held_total, cash
