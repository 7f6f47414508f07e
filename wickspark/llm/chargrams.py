"""Which byte n-grams a text holds: hashed to 2 ** BITS slots, each slot once per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wickspark.llm.words import MULTIPLIER, buffers, slices

BITS = 22


class Presence:
    """orders: lengths of n-grams, 4 at most. table: byte -> byte, applied first."""

    def __init__(self, orders: tuple[int, ...], table: np.ndarray, bits: int = BITS) -> None:
        self.orders, self.table, self.bits = orders, table, bits
        self.stamp = np.zeros(1 << bits, np.int32)

    def _slots(self, data: np.ndarray) -> list[np.ndarray]:
        """Slots of the n-gram that starts at each byte, for each order."""
        code, out = np.zeros(len(data), np.uint64), {}
        for n in range(1, max(self.orders) + 1):
            code = code[: len(code) - (n > 1)] * np.uint64(256) + data[n - 1 :]
            if n in self.orders:
                spread = (code + (np.uint64(n) << np.uint64(32))) * MULTIPLIER
                out[n] = ((spread ^ (spread >> np.uint64(29))) * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int32)
            if len(code) < 1:
                break
        return [out.get(n, np.zeros(0, np.int32)) for n in self.orders]

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text, its distinct slots in order of first appearance or any other."""
        data, offsets = buffers(column)
        for a, b in slices(offsets):
            part = self.table[data[offsets[a] : offsets[b]]]
            slots = self._slots(part) if len(part) else [np.zeros(0, np.int32)] * len(self.orders)
            at = (offsets[a : b + 1] - offsets[a]).tolist()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                ids = np.concatenate([s[lo : max(lo, hi - n + 1)] for s, n in zip(slots, self.orders, strict=True)])
                number = np.arange(len(ids), dtype=np.int32)
                self.stamp[ids] = number
                yield ids[self.stamp[ids] == number]
