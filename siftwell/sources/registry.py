"""Named loaders and scorers; a name is taken once."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str) -> None:
        self.kind, self._entries = kind, {}

    def register(self, name: str) -> Callable:
        def keep(entry):
            if name in self._entries:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self._entries[name] = entry
            return entry

        return keep

    def names(self) -> list[str]:
        return sorted(self._entries)

    def get(self, name: str):
        if name not in self._entries:
            raise KeyError(f"unknown {self.kind} {name!r}; available: {', '.join(self.names())}")
        return self._entries[name]


LOADERS = Registry("loader")
SCORERS = Registry("scorer")
