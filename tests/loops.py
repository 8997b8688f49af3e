"""Brute-force versions of the rules, in plain loops, for comparison."""


def windows(rows, width):
    """Yield the rows of every anchored window, in time and line order."""
    rows = sorted(rows, key=lambda r: (r["ms"] or 0, r["line"]))
    for i, row in enumerate(rows):
        if row["ms"]:
            yield [r for r in rows[i:] if (r["ms"] or 0) - row["ms"] <= width]


def best(rows, width, measure):
    top, found = 0, []
    for inside in windows(rows, width):
        if measure(inside) > top:
            top, found = measure(inside), inside
    return top, found


def by_source(rows):
    groups = {}
    for r in rows:
        if r["ip"]:
            groups.setdefault((r["session"], r["ip"]), []).append(r)
    return groups


def count_findings(rows, width, threshold):
    out = {}
    for key, group in by_source(rows).items():
        top, found = best(group, width, len)
        if top > threshold:
            out[key] = (top, [r["raw"] for r in found[:3]])
    return out


def port_findings(rows, width, threshold):
    out = {}
    for key, group in by_source(rows).items():
        group = [r for r in group if r["port"] is not None]
        top, found = best(group, width, lambda w: len({r["port"] for r in w}))
        if top > threshold:
            ports = list(dict.fromkeys(r["port"] for r in found))[:10]
            out[key] = (top, ports, [r["raw"] for r in found[:3]])
    return out
