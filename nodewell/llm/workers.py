"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from time import monotonic, sleep

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Run, seconds: float = 5) -> Run:
    """run, releasing memory every few seconds and at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = monotonic()
        for out in run(batches):
            yield out
            if monotonic() - last > seconds:
                release()
                last = monotonic()
        release()

    return tidied


class Kept:
    """What a worker keeps from one task of an operator to the next: given up by forget() some seconds after its last use, as
    workers live on, idle or with tasks of other operators, beside a JVM that needs the memory. Used inside `with`."""

    def __init__(self, forget: Callable[[], None], seconds: float = 5):
        self.forget, self.seconds = forget, seconds
        self.lock, self.last, self.watched = threading.Lock(), 0.0, False

    def __enter__(self) -> None:
        self.lock.acquire()
        if not self.watched:
            self.watched = True
            threading.Thread(target=self._watch, daemon=True).start()

    def __exit__(self, *_) -> None:
        self.last = monotonic()
        self.lock.release()

    def _watch(self) -> None:
        left = self.seconds
        while left > 0:
            sleep(left)
            with self.lock:
                left = self.last + self.seconds - monotonic()
                if left <= 0:
                    self.watched = False
                    self.forget()
        release()
