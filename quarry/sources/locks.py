"""Table locks: shared, update, exclusive; re-entrant, writers first, five seconds of patience."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from quarry.errors import SqlError

SHARED, UPDATE, EXCLUSIVE = "S", "U", "X"
RANK = {SHARED: 0, UPDATE: 1, EXCLUSIVE: 2}
#: Which locks of others let a lock in.
LETS_IN = {SHARED: {SHARED, UPDATE}, UPDATE: {SHARED}, EXCLUSIVE: set()}
PATIENCE = 5.0


class Locks:
    def __init__(self, patience: float = PATIENCE):
        self.patience, self.changed = patience, threading.Condition()
        self.held: dict[str, dict[object, list[str]]] = defaultdict(dict)
        self.waiting: dict[str, int] = defaultdict(int)

    def take(self, owner: object, table: str, mode: str) -> None:
        """A lock for owner; one that it has, or a weaker one, is counted again; a stronger one waits for the others."""
        with self.changed:
            own = self.held[table].setdefault(owner, [])
            if own and max(map(RANK.get, own)) >= RANK[mode]:
                own.append(mode)
                return
            writer = mode != SHARED
            self.waiting[table] += writer
            until = time.monotonic() + self.patience
            try:
                while not self._free(owner, table, mode):
                    if not self.changed.wait(max(0.0, until - time.monotonic())) and not self._free(owner, table, mode):
                        if not own:
                            self.held[table].pop(owner, None)
                        raise SqlError("lock", f"no {mode} lock on {table} within {self.patience:g} s")
            finally:
                self.waiting[table] -= writer
                self.changed.notify_all()
            own = self.held[table].setdefault(owner, own)
            own.append(mode)

    def _free(self, owner: object, table: str, mode: str) -> bool:
        others = [m for o, ms in self.held[table].items() if o is not owner for m in ms]
        own = self.held[table].get(owner)
        if mode == SHARED and not own and self.waiting[table]:
            return False  # a writer waits
        return all(m in LETS_IN[mode] for m in others)

    def take_all(self, owner: object, wanted: dict[str, str]) -> None:
        for table in sorted(wanted):
            self.take(owner, table, wanted[table])

    def free(self, owner: object, table: str | None = None) -> None:
        """Everything that owner holds, or one lock of a table."""
        with self.changed:
            for name in [table] if table else list(self.held):
                own = self.held[name].get(owner)
                if own:
                    own.pop() if table else own.clear()
                    if not own:
                        del self.held[name][owner]
            self.changed.notify_all()

    def listing(self) -> list[tuple[str, str, str]]:
        with self.changed:
            return [(table, str(owner), m) for table, owners in self.held.items() for owner, ms in owners.items() for m in ms]
