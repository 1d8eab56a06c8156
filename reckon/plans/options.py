"""What a comparison is asked to do, and profiles that name such sets of options."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

#: No broadcast: Spark has none for full outer joins.
STRATEGIES = ("auto", "sortmerge", "shuffle_hash")
_HINTS = {"sortmerge": "merge", "shuffle_hash": "shuffle_hash"}


class DiffError(ValueError):
    """A request that can't be carried out; the message names the culprit."""


@dataclass(frozen=True)
class Options:
    key: tuple[str, ...] = ()
    compare: tuple[str, ...] | None = None
    ignore: tuple[str, ...] = ()
    trim: bool = False
    ignore_case: bool = False
    empty_is_null: bool = False
    tolerance: float = 0.0
    max_rows: int = 50_000
    delimiter: str | None = None
    encoding: str | None = None
    strategy: str = "auto"
    #: Columns that order the rows of a DataFrame; files are ordered by place.
    order_by: tuple[str, ...] = ()

    def validate(self) -> Options:
        if not self.key:
            raise DiffError("a key column is needed")
        if not self.tolerance >= 0:
            raise DiffError("tolerance must be 0 or more")
        if self.max_rows <= 0:
            raise DiffError("max_rows must be more than 0")
        if self.delimiter is not None and len(self.delimiter) != 1:
            raise DiffError("delimiter must be one character")
        if self.strategy not in STRATEGIES:
            raise DiffError(f"unknown strategy {self.strategy}; known: {', '.join(STRATEGIES)}")
        return self

    @property
    def hint(self) -> str | None:
        return _HINTS.get(self.strategy)


def parse_list(text: str) -> tuple[str, ...]:
    """Comma-separated names, trimmed, empty ones dropped."""
    return tuple(x.strip() for x in text.split(",") if x.strip())


_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "kib": 2**10, "mib": 2**20, "gib": 2**30}


def parse_count(text: str) -> int:
    """10k, 2.5m, 1g."""
    low = text.strip().lower()
    number = low.rstrip("kmg")
    try:
        return round(float(number) * _UNITS[low[len(number) :]])
    except (ValueError, KeyError):
        raise DiffError(f"not a number of rows: {text}") from None


def parse_size(text: str) -> int:
    """Bytes: 8G and 8GiB are 8 * 2^30, 512MiB, 1024."""
    low = text.strip().lower()
    number = low.rstrip("kmgib")
    unit = low[len(number) :].removesuffix("b").removesuffix("i")
    try:
        return int(float(number) * {"": 1, "k": 2**10, "m": 2**20, "g": 2**30}[unit])
    except (ValueError, KeyError):
        raise DiffError(f"not a size: {text}") from None


def profiles(path: str | None = None) -> dict[str, dict]:
    """The [profiles.x] tables of a TOML file: the one named, else ./reckon.toml, else that of the user."""
    if path and not os.path.exists(path):
        raise DiffError(f"no such file: {path}")
    for p in [path] if path else ["reckon.toml", os.path.expanduser("~/.config/reckon/reckon.toml")]:
        if os.path.exists(p):
            with open(p, "rb") as f:
                try:
                    found = tomllib.load(f).get("profiles", {})
                except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                    raise DiffError(f"malformed profiles in {p}: {e}") from None
            if not isinstance(found, dict) or not all(isinstance(x, dict) for x in found.values()):
                raise DiffError(f"malformed profiles in {p}: tables [profiles.name] are wanted")
            return found
    return {}


def with_profile(base: Options, profile: dict) -> Options:
    """Known keys of a profile laid over the options (``engine`` is the strategy); unknown ones are passed over."""
    profile = {"strategy" if k == "engine" else k: v for k, v in profile.items()}
    known = {f.name for f in fields(Options)}
    given = {k: tuple(parse_list(v) if isinstance(v, str) else v) if k in ("key", "compare", "ignore", "order_by") else v for k, v in profile.items() if k in known}
    return replace(base, **given)
