"""Figures of accounts of one or many holding periods, formed in numpy from one row per code.

The same rules as `trades.folded` and `metrics.account_figures`, which say them in SQL, with the same operations on doubles in the same
order. There a lambda is interpreted for each candidate and mark of each account; here all accounts of some codes take their next
candidate, and later their next mark, together. An exit depends on the bar, the side and the period only, so it is found once for all patterns.

A task holds the codes of one Arrow batch and works on at most PART candidates at once, or on one period of one code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wickspark.model import COMMISSION, INVEST_FRACTION, LOT, START_CASH, STOP_LOSS

PART = 1 << 19
CODES = 200  # codes of one Arrow batch; a code has a row for each day at most
_FREE = np.iinfo(np.int64).max  # a position open at the end never frees its account
_FIGURES = (("trades", pa.int64()), ("held_bars", pa.int64()), ("hold_days", pa.int64()), ("final_value", pa.float64()), ("won", pa.int64()),
            ("_sum", pa.float64()), ("_fall", pa.float64()), ("_mean", pa.float64()), ("_std", pa.float64()))


def ledgers(gathered: DataFrame, wanted: Iterable[tuple[int, str, str]], holds: Iterable[int], cash: float = START_CASH, also: Iterable[str] = (),
            traded: bool = False) -> DataFrame:
    """Rows (code, `_opens`, `_closes`, `_fired`: of each bar the cells with a signal, `also`) -> a row for each account, its figures unrounded.

    wanted: of each account to form its cell, pattern and side. traded: only accounts with a trade. `_sum` is null where no trade has a percentage,
    `_mean` and `_std` where no return or fewer than two are other than 0, and these, `_fall` and `final_value` where there is no trade."""
    wanted, holds, also = tuple(wanted), tuple(holds), ("code", *also)
    cells, buys = [c for c, _, _ in wanted], [s == "buy" for _, _, s in wanted]
    spark = gathered.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= CODES:
        spark.conf.set(name, str(CODES))  # a code is a long row; results don't depend on it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, sides = pa.array([p for _, p, _ in wanted], pa.string()), pa.array([s for _, _, s in wanted], pa.string())
        for batch in batches:
            for first, bars, whole in _parts(batch, len(holds), PART):
                for these in ([holds] if whole else [(h,) for h in holds]):
                    code, account, hold, made = _accounts(*bars, cells, buys, these, cash, traded)
                    at = pa.array(code + first)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(c).take(at) for c in also], pa.array(np.asarray(these, np.int32)[hold]), patterns.take(pa.array(account)),
                             sides.take(pa.array(account)), *[pa.array(values, kind, mask=missing) for (_, kind), (values, missing) in zip(_FIGURES, made, strict=True)]],
                            names=[*also, "hold", "pattern", "side", *[n for n, _ in _FIGURES]])

    kept = ", ".join(f"`{c}` {gathered.schema[c].dataType.simpleString()}" for c in also)
    shown = ", ".join(f"{n} {'bigint' if kind == pa.int64() else 'double'}" for n, kind in _FIGURES)
    return gathered.select(*also, "_opens", "_closes", "_fired").mapInArrow(run, f"{kept}, hold int, pattern string, side string, {shown}")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list starts, and the last ends, and the values of all."""
    at = lists.offsets.to_numpy()
    return at - at[0], lists.values[at[0]:at[-1]]


def _parts(batch: pa.RecordBatch, periods: int, most: int) -> Iterator[tuple[int, tuple, bool]]:
    """The codes of a batch in runs of at most so many candidates, or a single code: the first code, (start of each code, opens, closes, bar and cell of
    each signal), and whether all periods can be formed at once."""
    starts, opens = _flat(batch.column("_opens"))
    opens, closes = opens.to_numpy(), _flat(batch.column("_closes"))[1].to_numpy()
    per_bar, cells = _flat(_flat(batch.column("_fired"))[1])
    cells = cells.to_numpy()
    signals = per_bar[starts]  # where the signals of each code start
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(signals, signals[first] + most // periods, "right")) - 1, first + 1)
        a, z = starts[first], starts[last]
        bar = np.repeat(np.arange(z - a), np.diff(per_bar[a:z + 1]))
        yield (first, (starts[first:last + 1] - a, opens[a:z], closes[a:z], bar, cells[signals[first]:signals[last]]),
               (signals[last] - signals[first]) * periods <= most)
        first = last


def _positive(x: np.ndarray) -> np.ndarray:
    """x > 0 as SQL has it, where NaN is more than any number."""
    return ~(x <= 0)


def _exits(starts: np.ndarray, opens: np.ndarray, closes: np.ndarray, holds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """For a signal on each bar, by (side, period), buys first: the bar and price of the exit, bars held, and whether it stays open to the end."""
    n = len(opens)
    bar = np.arange(n)
    last = np.repeat(starts[1:] - 1, np.diff(starts))
    left = last - bar
    entry = opens[np.minimum(bar + 1, n - 1)]
    never = n + max(holds) + 2
    first = np.full(n, never)  # the first bar, from the entry bar as 1, whose close is below the stop
    for k in range(max(holds), 0, -1):
        first[(left >= k + 1) & (closes[np.minimum(bar + k + 1, n - 1)] / entry - 1 <= STOP_LOSS)] = k
    outs, prices, helds, ends = [], [], [], []
    for stop in (first, np.full(n, never)):
        for h in holds:
            on_time, stopped = (stop > h) & (left >= h + 1), (stop <= h) & (left >= stop + 2)
            end = ~(on_time | stopped)
            out = bar + 1 + np.where(stopped, stop + 1, np.where(on_time, h, np.maximum(left - 1, 0)))
            at = np.minimum(out, n - 1)
            outs.append(out)
            prices.append(np.where(end, closes[at], opens[at]))
            helds.append(np.where(stopped, stop + 1, np.where(on_time, h + 1, np.maximum(left, 0))))
            ends.append(end)
    return tuple(np.concatenate(x) for x in (outs, prices, helds, ends))


def _accounts(starts: np.ndarray, opens: np.ndarray, closes: np.ndarray, bar: np.ndarray, cell: np.ndarray, wanted: list[int], buys: list[bool],
              holds: tuple[int, ...], cash: float, traded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """The accounts of some codes: place of the code, of the account in wanted and of the period, and _FIGURES as (values, where null)."""
    with np.errstate(all="ignore"):
        codes, periods, n = len(starts) - 1, len(holds), len(opens)
        code_of = np.repeat(np.arange(codes), np.diff(starts))
        last = starts[1:] - 1
        usable = (bar < last[code_of[bar]]) & _positive(opens[np.minimum(bar + 1, max(n - 1, 0))])
        bar, cell = bar[usable], cell[usable]
        cells = max(max(wanted), int(cell.max(initial=0))) + 1
        key = code_of[bar] * cells + cell
        order = np.argsort(key, kind="stable")
        bar, amount = bar[order], np.bincount(key, minlength=codes * cells)
        begin = np.cumsum(amount) - amount
        # accounts before their periods: those with most signals first, so that those with a k-th signal are the first ones
        place = (np.arange(codes)[:, None] * cells + np.asarray(wanted)[None, :]).ravel()
        by_size = np.argsort(-amount[place], kind="stable")
        by_size = by_size[amount[place][by_size] > 0]
        less, begin = -amount[place][by_size], begin[place][by_size]
        code, account = by_size // len(wanted), by_size % len(wanted)
        many = len(by_size) * periods
        buy = np.repeat(np.asarray(buys)[account], periods)
        outs, prices, helds, ends = _exits(starts, opens, closes, holds) if n else (np.zeros(0, int),) * 4
        row = (np.where(buy, 0, periods) + np.tile(np.arange(periods), len(by_size))) * n

        money, free, count = np.full(many, cash), np.full(many, -1), np.zeros(many, np.int64)
        steps = []
        for k in range(-int(less[0]) if len(less) else 0):
            some = int(np.searchsorted(less, -k, "left"))  # accounts with more than k signals
            at = np.repeat(bar[begin[:some] + k], periods)
            idx = np.flatnonzero(at + 1 >= free[:some * periods])
            b, own = at[idx], money[idx]
            entry = opens[b + 1]
            shares = own * INVEST_FRACTION / entry
            lots = (shares - np.fmod(shares, 1)) / LOT
            whole = (lots - np.fmod(lots, 1)) * LOT
            able = _positive(whole)
            if not able.all():
                idx, b, own, entry, whole = idx[able], b[able], own[able], entry[able], whole[able]
            ex = row[idx] + b
            paid, got = whole * entry, whole * prices[ex]
            long = buy[idx]
            into = np.where(long, own - paid * (1 + COMMISSION), own + paid * (1 - COMMISSION))
            after = np.where(long, into + got * (1 - COMMISSION), into - got * (1 + COMMISSION))
            money[idx], free[idx] = after, np.where(ends[ex], _FREE, b + 1 + helds[ex])
            steps.append((idx, count[idx], b, ex, whole, into, after))
            count[idx] += 1

        # trades in order of their account
        first = np.cumsum(count) - count
        total = int(count.sum())
        owner, b, ex = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        whole, into, after = np.empty(total), np.empty(total), np.empty(total)
        for idx, no, *own in steps:
            to = first[idx] + no
            owner[to] = idx
            for column, values in zip((b, ex, whole, into, after), own, strict=True):
                column[to] = values
        del steps
        held, end, entry, price, long = helds[ex], ends[ex], opens[b + 1], prices[ex], buy[owner]
        told = long | (price != 0)
        pct = round_two(np.where(told, np.where(long, price / entry - 1, entry / price - 1) * 100, 0))
        gain = np.bincount(owner[told], pct[told], many)
        some_told = np.bincount(owner[told], minlength=many) > 0
        won = np.bincount(owner[told & _positive(pct)], minlength=many)
        held_bars = np.bincount(owner, held, many).astype(np.int64)
        hold_days = np.bincount(owner, outs[ex] - b - 1, many).astype(np.int64)

        # marks: each held bar, and the bar on which the account is cash again; none of them where the next position is opened on that bar
        follows = np.zeros(total, bool)
        follows[:-1] = (owner[1:] == owner[:-1]) & (b[1:] == b[:-1] + held[:-1])
        settles = ~end & (b + 1 + held <= last[code_of[b]]) & ~follows
        length = held + settles
        to = np.cumsum(length) - length
        marks = np.empty(int(length.sum()))
        whose = np.repeat(np.arange(total), length)
        step = np.arange(len(marks)) - to[whose]
        signed = np.where(long, whole, -whole)
        marks[:] = into[whose] + signed[whose] * closes[np.minimum(b[whose] + 1 + step, max(n - 1, 0))]
        closing = np.flatnonzero(settles | end)
        marks[to[closing] + length[closing] - 1] = after[closing]
        del whose, step
        amount = np.bincount(owner, length, many).astype(np.int64)
        moves, mean, std, fall = _moves(marks, np.cumsum(amount) - amount, amount, cash)

        live = np.flatnonzero(count)
        made = [(count, None), (held_bars, None), (hold_days, None), (money, False), (won, None), (gain, ~some_told), (fall, False), (mean, moves < 1), (std, moves < 2)]
        code, account, hold = code[live // periods], account[live // periods], live % periods
        if traded:
            return code, account, hold, [(values[live], None if missing is None or missing is False else missing[live]) for values, missing in made]
        own = (code * len(wanted) + account) * periods + hold
        every = np.arange(codes * len(wanted) * periods)

        def spread(values, fill):
            out = np.full(len(every), fill, values.dtype)
            out[own] = values[live]
            return out

        told = [(spread(values, 0), None if missing is None else spread(np.zeros(many, bool) if missing is False else missing, True)) for values, missing in made]
        return every // periods // len(wanted), every // periods % len(wanted), every % periods, told


def _moves(marks: np.ndarray, begin: np.ndarray, amount: np.ndarray, cash: float) -> tuple[np.ndarray, ...]:
    """Of each account the number of returns other than 0, their mean and deviation, and its deepest fall below a peak. Mark by mark, in order."""
    order = np.argsort(-amount, kind="stable")
    begin, less = begin[order], -amount[order]
    many = len(order)
    before, peak, fall = np.full(many, cash), np.full(many, cash), np.full(many, -np.inf)
    n, total, mean, m2 = np.zeros(many), np.zeros(many), np.zeros(many), np.zeros(many)
    for k in range(-int(less[0]) if many else 0):
        some = int(np.searchsorted(less, -k, "left"))
        x, prior = marks[begin[:some] + k], before[:some]
        r = x / prior - 1
        moved = np.flatnonzero((prior != 0) & (r != 0))
        r = r[moved]
        total[moved] += r
        n[moved] += 1
        away = r - mean[moved]
        part = away / n[moved]
        mean[moved] += part
        m2[moved] += away * (away - part)
        np.maximum(peak[:some], x, out=peak[:some])
        np.maximum(fall[:some], (peak[:some] - x) / peak[:some] * 100, out=fall[:some])
        before[:some] = x
    out = np.empty((4, many))
    out[:, order] = n, total / n, np.sqrt(m2 / (n - 1)), fall
    return tuple(out)


def round_two(x: np.ndarray) -> np.ndarray:
    """round(x, 2) as Spark rounds: halves of the shortest decimal form go away from 0."""
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * 100
        whole = np.floor(scaled)
        rest = scaled - whole
        out = np.copysign((whole + (rest >= 0.5)) / 100, x)
    for i in np.flatnonzero((np.abs(rest - 0.5) < 1e-5) | (scaled > 1e9)):  # too near to a half, or too large, to tell from the product
        v = float(x[i])
        out[i] = float(Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if abs(v) < 1e15 else v
    return out
