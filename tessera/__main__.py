"""``python -m tessera --list-loaders``: a line a format or source that can be read, with the function that reads it and where that comes from."""

from __future__ import annotations

import sys
from collections.abc import Iterator


def readers() -> Iterator[tuple[str, str, str]]:
    """(extension, function, what it says of itself) of every registered reader."""
    from tessera.sources import registry

    for name in registry.known():
        reader = registry.get(name)
        said = (reader.__doc__ or "").strip().split("\n")[0]
        yield name, f"{reader.__module__}.{reader.__qualname__}", said


def main(given: list[str] | None = None) -> int:
    asked = sys.argv[1:] if given is None else given
    if "--list-loaders" not in asked:
        print(__doc__)
        return 1
    rows = list(readers())
    widths = [max((len(r[i]) for r in rows), default=0) for i in (0, 1)]
    for name, function, said in rows:
        print(f"{name:<{widths[0]}}  {function:<{widths[1]}}  {said}".rstrip())
    return 0


if __name__ == "__main__":
    sys.exit(main())
