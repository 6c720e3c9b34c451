"""Retrieval kinds: named operations with checked inputs, whose small results are kept for a while."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Kind:
    """``inputs`` maps a parameter to (type, required); ``most`` bounds the rows that a result may have on the driver."""

    name: str
    run: Callable[..., DataFrame]
    inputs: Mapping[str, tuple[type, bool]] = field(default_factory=dict)
    most: int = 1000

    def check(self, given: Mapping[str, Any]) -> dict[str, Any]:
        for k in given:
            if k not in self.inputs:
                raise ValueError(f"{self.name}: no parameter {k}")
        for k, (kind, required) in self.inputs.items():
            if k not in given and required:
                raise ValueError(f"{self.name}: {k} is missing")
            if k in given and (not isinstance(given[k], kind) or isinstance(given[k], bool) and kind is not bool):
                raise ValueError(f"{self.name}: {k} is not of type {kind.__name__}")
        return dict(given)


class Kinds:
    """Registry with a cache: results are keyed by a digest of name and input, dropped after ``ttl_s`` or, above ``size``
    entries, by the longest disuse."""

    def __init__(self, ttl_s: float = 300.0, size: int = 256, clock: Callable[[], float] = time.monotonic) -> None:
        self._kinds: dict[str, Kind] = {}
        self._kept: OrderedDict[str, tuple[float, list[dict]]] = OrderedDict()
        self.ttl_s, self.size, self.clock = ttl_s, size, clock
        self.hits = self.misses = 0

    def add(self, kind: Kind) -> None:
        if kind.name in self._kinds:
            raise ValueError(f"kind {kind.name} is filed twice")
        self._kinds[kind.name] = kind

    def names(self) -> list[str]:
        return sorted(self._kinds)

    def ask(self, name: str, **given: Any) -> list[dict]:
        """The rows of a kind; an unknown name is a KeyError, a wrong input or a result of too many rows a ValueError."""
        kind = self._kinds[name]
        checked = kind.check(given)
        key = hashlib.sha256(json.dumps([name, checked], sort_keys=True, default=str).encode()).hexdigest()
        now = self.clock()
        if key in self._kept and now - self._kept[key][0] < self.ttl_s:
            self._kept.move_to_end(key)
            self.hits += 1
            return [dict(r) for r in self._kept[key][1]]
        self.misses += 1
        rows = [r.asDict(recursive=True) for r in kind.run(**checked).limit(kind.most + 1).collect()]
        if len(rows) > kind.most:
            raise ValueError(f"{name}: more than {kind.most} rows")
        self._kept[key] = (now, rows)
        self._kept.move_to_end(key)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return [dict(r) for r in rows]

    def forget(self) -> None:
        self._kept.clear()
