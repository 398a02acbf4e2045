"""Settings: a variable of the environment goes before the file, and the file before the default."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from typing import Any

# The words for true and false, in any case.
TRUTH = dict.fromkeys(("1", "true", "yes", "y", "t"), True) | dict.fromkeys(("0", "false", "no", "n", "f"), False)

KINDS = {bool: lambda x: x if isinstance(x, bool) else TRUTH[str(x).strip().lower()], int: lambda x: int(float(x)), float: float}


def flat(config: Mapping, above: str = "") -> Iterator[tuple[str, Any]]:
    """Each value of nested mappings with its path, as ``a.b``; mappings are values too, and null values are left out."""
    for key, value in config.items():
        if value is not None:
            yield above + str(key), value
            if isinstance(value, Mapping):
                yield from flat(value, f"{above}{key}.")


def setting(config: Mapping, name: str, dotted: str, default: Any) -> Any:
    """The value of variable ``name``, else of path ``dotted`` in ``config``, else ``default``, as the default's type.

    A variable of white space alone counts as unset, and a value that does not convert gives the default. Items of a list
    are separated by commas in a variable; each becomes an int, else a float, else stays a string.
    """
    from_env = os.environ.get(name, "").strip()
    found = from_env or dict(flat(config)).get(dotted)
    if found is None:
        return default
    try:
        if isinstance(default, (list, tuple)):
            return [item(x.strip()) for x in from_env.split(",") if x.strip()] if from_env else list(default if isinstance(found, str) else found)
        return KINDS.get(type(default), lambda x: x)(found)
    except (KeyError, TypeError, ValueError, OverflowError):
        return default


def item(word: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word
