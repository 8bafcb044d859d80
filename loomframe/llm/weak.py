"""Weak supervision on vote tables: expectation maximisation for two classes, and a logistic classifier on its posteriors.

Both work on a table of vote patterns with counts, whose size is bounded by the number of patterns (3 ** labelers a
group), however many documents or spans were counted into it.
"""

import math


def log_odds(model, labeler, vote):
    return math.log(model["rules"][labeler][1][vote]) - math.log(model["rules"][labeler][0][vote])


def posterior(row, model):
    """Probability of class 1 for one row of votes (-1, 0, 1)."""
    z = math.log(model["prior"]) - math.log(1 - model["prior"]) + sum(log_odds(model, r, row[r]) for r in model["rules"])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def expectation_maximisation(patterns, start, prior, weight, rounds=100):
    """{"prior": p, "rules": {labeler: {class: {vote: p}}}} from (votes..., n) rows.

    Estimation begins at ``start`` (same shape as "rules") and keeps ``weight[c]`` times the counted rows of
    pseudo-counts there for class c, so that the classes can't change places. No rows: the start itself.
    """
    total = sum(r["n"] for r in patterns)
    model = {"prior": prior, "rules": {r: {c: dict(start[r][c]) for c in (0, 1)} for r in start}}
    for _ in range(rounds if total else 0):
        mass = {c: 0.0 for c in (0, 1)}
        seen = {r: {c: {v: 0.0 for v in (-1, 0, 1)} for c in (0, 1)} for r in start}
        for row in patterns:
            p = posterior(row, model)
            for c, q in ((1, p), (0, 1 - p)):
                mass[c] += q * row["n"]
                for r in start:
                    seen[r][c][row[r]] += q * row["n"]
        pseudo = {c: weight[c] * total for c in (0, 1)}
        least = min(pseudo.values())
        latest = {"prior": (mass[1] + least * prior) / (total + least), "rules": {r: {c: {v: (seen[r][c][v] + pseudo[c] * start[r][c][v]) / (mass[c] + pseudo[c]) for v in (-1, 0, 1)} for c in (0, 1)} for r in start}}
        moved = max(abs(latest["rules"][r][c][v] - model["rules"][r][c][v]) for r in start for c in (0, 1) for v in (-1, 0, 1))
        model = latest
        if moved < 1e-6:
            break
    return model


def logistic(patterns, features, target, rounds=400, rate=0.5, l2=1e-3):
    """{feature: weight} (with "bias") of a logistic regression on rows of 0/1 features, soft targets and counts n."""
    w = {f: 0.0 for f in features} | {"bias": 0.0}
    total = sum(r["n"] for r in patterns) or 1
    rows = [([f for f in features if r[f]], target(r), r["n"] / total) for r in patterns]
    square = {f: 1e-8 for f in w}
    for _ in range(rounds):
        grad = {f: l2 * w[f] for f in w}
        for on, y, c in rows:
            z = w["bias"] + sum(w[f] for f in on)
            d = (1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) - y) * c
            for f in [*on, "bias"]:
                grad[f] += d
        for f in w:
            square[f] += grad[f] ** 2
            w[f] -= rate * grad[f] / math.sqrt(square[f])
    return w
