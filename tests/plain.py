"""Plain readings that tests compare with."""


def rowwise(plan, rows, span, on_fire):
    """(window start, step completed, fires, measure where a step is completed) of each row (key, time, flags, values), one after the other."""
    out, key = [], object()
    for own, t, flags, values in rows:
        if own != key:
            key, start = own, None
        if start is None or t >= start + span:
            start, at, fired_once, state = None, 0, False, None
        state = state or [[0, 0.0, set()] for _ in plan[at]]
        if not any(flags[at]):
            out.append((start, None, False, None))
            continue
        start = t if start is None else start
        met = None
        for (kind, least), (j, s) in zip(plan[at], enumerate(state), strict=True):
            if not flags[at][j]:
                continue
            v = values[at][j]
            s[0] += 1
            if kind == "distinct":
                s[2] |= set() if v is None else {v}
            elif kind != "count":
                s[1] += v or 0.0
            measure = float({"count": s[0], "distinct": len(s[2]), "sum": s[1], "avg": s[1] / s[0]}[kind])
            if met is None and measure >= least:
                met = measure
        if met is None:
            out.append((start, None, False, None))
            continue
        last = at == len(plan) - 1
        out.append((start, at, last and not (on_fire == "once" and fired_once), met))
        fired_once |= last
        if not (last and on_fire == "every"):
            at, state = 0 if last else at + 1, None
    return out
