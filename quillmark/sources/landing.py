"""Landing raw documents: a throttled getter and a read-through store.

This runs outside the engine, before Spark reads what has landed.  The opener is
passed in, so no network is needed to test it.
"""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any
from urllib.error import HTTPError

Opener = Callable[[str], bytes]


class Throttle:
    """Keeps at least ``gap`` seconds between calls."""

    def __init__(self, gap: float = 0.15, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = gap, clock, sleep, float("-inf")

    def wait(self) -> None:
        if (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def fetch_json(url: str, opener: Opener, throttle: Throttle | None = None, tries: int = 4, pause: Callable[[float], None] = time.sleep) -> Any:
    """A JSON document, gzipped or plain.

    Failed calls are tried again after a pause that grows by a second each
    time.  What isn't there (404) fails at once.
    """
    for n in range(1, tries + 1):
        try:
            if throttle:
                throttle.wait()
            raw = opener(url)
            return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        except HTTPError as e:
            if e.code == 404 or n == tries:
                raise
        except (OSError, ValueError):
            if n == tries:
                raise
        pause(float(n))
    raise ValueError("at least one try is needed")


def cached(path: str | Path, load: Callable[[], Any], refresh: bool = False) -> Any:
    """The document at ``path``, loaded and put there if it isn't or if it is to
    be refreshed.  The file appears at once or not at all."""
    p = Path(path)
    if p.exists() and not refresh:
        return json.loads(p.read_text(encoding="utf-8"))
    value = load()
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(p.suffix + ".part")
    part.write_text(json.dumps(value), encoding="utf-8")
    part.replace(p)
    return value


def land_each(keys: list[str], load: Callable[[str], Any], folder: str | Path, refresh: bool = False) -> dict[str, str]:
    """Land one document for each key; what fails is reported and doesn't stop
    the rest."""
    failed = {}
    for key in keys:
        try:
            cached(Path(folder) / f"{key}.json", lambda key=key: load(key), refresh)
        except Exception as e:  # noqa: BLE001 - whatever one source throws is its own
            failed[key] = repr(e)
    return failed
