"""A driver-side cache bounded in bytes, whose entries expire."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable


class SizedCache:
    """Keys and values as bytes; the least recently used go when the room is full, and each when its seconds are over.

    `disabled` takes nothing in. An entry larger than a thousandth of the room is an error, as it would drive out too many.
    """

    def __init__(self, room: int = 8 << 20, disabled: bool = False, clock: Callable[[], float] = time.monotonic, share: int = 1024):
        self.room, self.disabled, self.clock, self.share = room, disabled, clock, share
        self.held: OrderedDict[bytes, tuple[bytes, float]] = OrderedDict()
        self.size, self.lock = 0, threading.Lock()

    def set(self, key: bytes, value: bytes, seconds: float = 0) -> None:
        """Seconds of 0 never end."""
        if self.disabled:
            return
        own = len(key) + len(value)
        if own > max(self.room // self.share, 1):
            raise ValueError("the entry is too large for the cache")
        with self.lock:
            self._drop(key)
            self.held[key] = value, self.clock() + seconds if seconds else float("inf")
            self.size += own
            while self.size > self.room:
                self._drop(next(iter(self.held)))

    def get(self, key: bytes) -> bytes | None:
        with self.lock:
            found = self.held.get(key)
            if found is None:
                return None
            if found[1] <= self.clock():
                self._drop(key)
                return None
            self.held.move_to_end(key)
            return found[0]

    def delete(self, key: bytes) -> bool:
        with self.lock:
            return self._drop(key)

    def _drop(self, key: bytes) -> bool:
        found = self.held.pop(key, None)
        if found is None:
            return False
        self.size -= len(key) + len(found[0])
        return True

    def set_with(self, key: bytes, value, encode: Callable[[object], bytes], seconds: float = 0) -> None:
        self.set(key, encode(value), seconds)

    def get_with(self, key: bytes, decode: Callable[[bytes], object]):
        found = self.get(key)
        return None if found is None else decode(found)
