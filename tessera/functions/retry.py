"""Trying again what fails for a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps
from typing import Any


def retried(f: Callable[..., Any], tries: int = 3, wait: float = 1.0, factor: float = 2.0, on: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)) -> Callable[..., Any]:
    """f, called up to `tries` times where it raises one of `on`, with waits that grow by factor; the last error is raised."""

    @wraps(f)
    def again(*args: Any, **kwargs: Any) -> Any:
        pause = wait
        for left in reversed(range(tries)):
            try:
                return f(*args, **kwargs)
            except on:
                if not left:
                    raise
                time.sleep(pause)
                pause *= factor

    return again
