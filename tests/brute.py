"""Slow, obvious versions of the window features, one event at a time, for comparison."""

import random
from collections import defaultdict

HOUR, TEN_MINUTES, START = 3_600_000, 600_000, 1_700_006_400_000
TX = "tx_id string, user_id string, ts_ms long, amount_minor long, mcc string"


def by_key(rows, key=1):
    groups = defaultdict(list)
    for r in rows:
        if r[key]:
            groups[r[key]].append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[0])) for k, v in groups.items()}


def sliding(rows):
    out = {}
    for events in by_key(rows).values():
        for i, (tx, _, t, _, _) in enumerate(events):
            seen = events[: i + 1]
            hour = [r for r in seen if r[2] > t - HOUR]
            gap = round((t - events[i - 1][2]) / 1000, 2) if i else -1.0
            out[tx] = (
                sum(r[2] > t - TEN_MINUTES for r in seen),
                sum(r[3] for r in hour),
                max([0, *[r[3] for r in hour]]),
                len({r[4] or "unknown" for r in hour}),
                gap,
                t,
            )
    return out


def busy_rows(n=2500, seed=7):
    """Ties, events exactly on window bounds, a user with most of the rows, empty and missing mcc."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        offset = rng.choice([rng.randrange(30 * HOUR), rng.randrange(180) * TEN_MINUTES, rng.randrange(30) * HOUR])
        user = rng.choice(["a", "a", "a", "b", "c", "d"])
        rows.append((f"t{i:05d}", user, START + offset, rng.randrange(10_000), rng.choice(["x", "y", "z", "", None])))
    return rows
