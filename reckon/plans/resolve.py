"""Which columns take part: set algebra on the two headers."""

from __future__ import annotations

from dataclasses import dataclass

from .options import DiffError, Options


@dataclass(frozen=True)
class Resolved:
    key: tuple[str, ...]
    compared: tuple[str, ...]
    only_in_a: tuple[str, ...]
    only_in_b: tuple[str, ...]


def resolve(a: list[str], b: list[str], opt: Options) -> Resolved:
    """Keys and named columns must be in both files, ignored ones in either.

    Without a list the common columns are compared in A's order; with one, in the caller's, repeats kept.
    Keys and ignored columns are never compared.
    """
    in_a, in_b = set(a), set(b)

    def need(names, what):
        if missing := [x for x in names if x not in in_a or x not in in_b]:
            raise DiffError(f"{what} not in both tables: {', '.join(missing)}")

    need(opt.key, "key column")
    if missing := [x for x in opt.ignore if x not in in_a and x not in in_b]:
        raise DiffError(f"ignored column in neither table: {', '.join(missing)}")
    if opt.compare is not None:
        need(opt.compare, "compared column")
    common = [x for x in dict.fromkeys(a) if x in in_b]
    drop = {*opt.key, *opt.ignore}
    compared = [x for x in (common if opt.compare is None else opt.compare) if x not in drop]
    return Resolved(tuple(opt.key), tuple(compared), tuple(x for x in dict.fromkeys(a) if x not in in_b), tuple(x for x in dict.fromkeys(b) if x not in in_a))
