"""Plain-Python counterparts used to check the Spark operators on small inputs."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations
from statistics import fmean

SUMMED = {
    "steps", "sleep_minutes", "time_in_bed_minutes", "calories", "active_minutes", "very_active_minutes",
    "fairly_active_minutes", "lightly_active_minutes", "sedentary_minutes",
}
WIDE = ["steps", "sleep_minutes", "calories", "active_minutes", "resting_hr", "hrv"]


def overview(events):
    """events: (timestamp, metric, value, user) -> {(user, day): row}."""
    cells = defaultdict(list)
    for timestamp, metric, value, user in events:
        cells[user, timestamp.date(), metric].append(value)
    days = {}
    for (user, day, metric), values in cells.items():
        row = days.setdefault((user, day), dict.fromkeys(WIDE))
        if metric in WIDE:
            row[metric] = math.fsum(values) if metric in SUMMED else fmean(values)
    for row in days.values():
        steps, sleep, active = (row[m] or 0.0 for m in ("steps", "sleep_minutes", "active_minutes"))
        row["health_score"] = min(steps / 10000, 1) * 45 + max(0, 1 - abs(sleep - 480) / 240) * 35 + min(active / 60, 1) * 20
    by_user = defaultdict(list)
    for user, day in sorted(days):
        by_user[user].append(days[user, day])
    for rows in by_user.values():
        for i, row in enumerate(rows):
            for metric in ("steps", "sleep_minutes", "resting_hr", "hrv"):
                seen = [r[metric] for r in rows[max(0, i - 29) : i + 1] if r[metric] is not None]
                z = 0.0
                if len(seen) >= 3 and row[metric] is not None and len(set(seen)) > 1:
                    mean = fmean(seen)
                    z = (row[metric] - mean) / math.sqrt(math.fsum((v - mean) ** 2 for v in seen) / (len(seen) - 1))
                row[f"{metric}_z"] = z
    return days, by_user


def pairs(by_user):
    found = {}
    metrics = WIDE + ["health_score"]
    for user, rows in by_user.items():
        for lag in (0, 1):
            for a, b in combinations(metrics, 2):
                both = [(x[a], y[b]) for x, y in zip(rows, rows[lag:]) if x[a] is not None and y[b] is not None]
                if len(both) < 3 or len({x for x, _ in both}) == 1 or len({y for _, y in both}) == 1:
                    continue
                mx, my = fmean(x for x, _ in both), fmean(y for _, y in both)
                sxy = math.fsum((x - mx) * (y - my) for x, y in both)
                sxx, syy = math.fsum((x - mx) ** 2 for x, _ in both), math.fsum((y - my) ** 2 for _, y in both)
                found[user, a, b, lag] = (sxy / math.sqrt(sxx * syy), len(both))
    return found
