"""The keyed diff in plain Python, from its rules alone."""

import re

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def norm(v, trim=False, ignore_case=False, empty_is_null=False):
    if v is None or v == "":
        return None
    if trim:
        v = v.strip()
    if ignore_case:
        v = v.lower()
    return None if empty_is_null and v == "" else v


def differs(a, b, tolerance=0.0):
    if a == b:
        return False
    if tolerance and a is not None and b is not None and NUMBER.fullmatch(a.strip()) and NUMBER.fullmatch(b.strip()):
        return abs(float(a) - float(b)) > tolerance
    return True


def diff(a_names, a_rows, b_names, b_rows, key, compared, tolerance=0.0, **flags):
    def first(names, rows):
        out, n = {}, {}
        for r in rows:
            cell = {}
            for x, v in zip(names, r, strict=False):
                cell.setdefault(x, norm(v, **flags))
            k = tuple(cell.get(c) for c in key)
            out.setdefault(k, [cell.get(c) for c in compared])
            n[k] = n.get(k, 0) + 1
        return out, n

    a, na = first(a_names, a_rows)
    b, nb = first(b_names, b_rows)
    both = [k for k in a if k in b]
    stats = [[0, 0, 0] for _ in compared]
    changed = 0
    for k in both:
        hit = False
        for i, (x, y) in enumerate(zip(a[k], b[k], strict=True)):
            if differs(x, y, tolerance):
                hit = True
                stats[i][0] += 1
                stats[i][1] += y is None
                stats[i][2] += x is None
        changed += hit
    d = lambda n: [x for x in n.values() if x > 1]
    return {"a_rows": sum(na.values()), "b_rows": sum(nb.values()), "a_keys": len(a), "b_keys": len(b), "a_dup_keys": len(d(na)), "a_dup_rows": sum(d(na)), "b_dup_keys": len(d(nb)), "b_dup_rows": sum(d(nb)), "matched": len(both), "unchanged": len(both) - changed, "changed": changed, "added": len(b) - len(both), "removed": len(a) - len(both)}, stats
