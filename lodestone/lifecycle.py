"""Unloading of models that are idle."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class IdleUnloader:
    """Calls the registered unloaders once nothing was used for more than ``timeout`` seconds; 0 never does.

    An unloader says whether it had anything to unload. One that fails is passed over, so that the others still run.
    """

    def __init__(self, timeout: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.timeout, self.clock = timeout, clock
        self.last: float | None = None
        self._unloaders: dict[str, Callable[[], bool]] = {}
        self._lock = threading.Lock()
        self._stop: threading.Event | None = None

    def register(self, name: str, unload: Callable[[], bool]) -> None:
        with self._lock:
            self._unloaders[name] = unload

    def touch(self) -> None:
        """Notes a use."""
        with self._lock:
            self.last = self.clock()

    def idle(self, now: float | None = None) -> bool:
        now = self.clock() if now is None else now
        return self.timeout > 0 and self.last is not None and now - self.last > self.timeout

    def check(self, now: float | None = None) -> list[str]:
        """Names of what was unloaded; until the next use nothing is idle then."""
        if not self.idle(now):
            return []
        with self._lock:
            todo, self.last = dict(self._unloaders), None
        out = []
        for name, unload in todo.items():
            try:
                if unload():
                    out.append(name)
            except Exception as e:  # noqa: BLE001
                print(f"unloading {name} failed: {e}")
        return out

    def start(self, every: float = 15.0) -> None:
        """Checks in a thread of its own, until ``stop``."""
        if self._stop is None:
            self._stop = stop = threading.Event()

            def patrol() -> None:
                while not stop.wait(every):
                    self.check()

            threading.Thread(target=patrol, daemon=True).start()

    def stop(self) -> None:
        if self._stop is not None:
            self._stop.set()
            self._stop = None
