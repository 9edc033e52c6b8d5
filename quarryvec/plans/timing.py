"""Wall-clock phases of a build or a run."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Phases(dict):
    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        yield
        self[name] = self.get(name, 0.0) + time.perf_counter() - began
