"""The latest writes, on the driver until they are flushed; its size is bounded by the configured capacity."""

from __future__ import annotations


class Memtable:
    def __init__(self) -> None:
        self._rows: dict[int, tuple[int | None, int]] = {}

    def __len__(self) -> int:
        return len(self._rows)

    def put(self, key: int, value: int | None, seq: int) -> None:
        """A value of None is a delete."""
        self._rows[key] = (value, seq)

    def get(self, key: int) -> tuple[int | None, int] | None:
        return self._rows.get(key)

    def scan(self, low: int, high: int) -> list[tuple[int, int | None, int, bool]]:
        return [(k, v, s, v is None) for k, (v, s) in sorted(self._rows.items()) if low <= k <= high]

    def rows(self) -> list[tuple[int, int | None, int, bool]]:
        return [(k, v, s, v is None) for k, (v, s) in sorted(self._rows.items())]

    def clear(self) -> None:
        self._rows.clear()
