"""Plain versions of rules, row by row, that tests hold the library to."""


def filter_pass(rows, scale, fps, step):
    """One pass of the ball's filters over (frame, x, y, conf) rows: round trips, then speed against the last kept."""
    per = lambda f: (min(1.19 * scale[f], 0.10), min(14.3 * scale[f], 1.2)) if scale.get(f) else (0.10, 1.2)
    hyp = lambda p, q: ((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2) ** 0.5
    if len(rows) >= 3:
        kept = rows[:1]
        for here, after in zip(rows[1:], rows[2:]):
            last = kept[-1]
            there, back, across = hyp(last, here), hyp(here, after), hyp(last, after)
            jump, gate = per(here[0])
            gate *= 0.5 + here[3]
            slow = there <= gate * max((here[0] - last[0]) / fps, 1e-3) and back <= gate * max((after[0] - here[0]) / fps, 1e-3)
            off_x = abs(here[1] - (last[1] + after[1]) / 2) * 16 / 9
            upright = abs(here[2] - (last[2] + after[2]) / 2) >= 2.0 * off_x
            judged = here[0] - last[0] <= 2 * step + 1
            if not (judged and there > jump and back > jump and across < there * 0.5 and not (slow and upright)):
                kept.append(here)
        rows = [*kept, rows[-1]]
    out = []
    for r in rows:
        if not out or hyp(out[-1], r) / max((r[0] - out[-1][0]) / fps, 1e-3) <= per(r[0])[1] * (0.5 + r[3]):
            out.append(r)
    return out
