"""Plain-Python definitions that the Spark operators are compared with."""

from __future__ import annotations

import itertools
import math
import random


def apart(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def gain(p, q):
    return math.exp(-apart(p, q))


def random_trips(count, longest, seed=7, box=0.4):
    rng = random.Random(seed)
    return {
        f"T{i:03d}": [(121 + rng.random() * box, 31 + rng.random() * box) for _ in range(rng.randint(1, longest))]
        for i in range(count)
    }


def similarity(trip, query):
    return sum(math.exp(-min(apart(p, q) for p in trip)) for q in query)


def top(scores, k, largest=True):
    sign = -1 if largest else 1
    return sorted(((t, round(v, 9)) for t, v in scores.items()), key=lambda r: (sign * r[1], r[0]))[:k]


def ordered(trip, query):
    """Best sum over all non-decreasing choices of a trip position per query point."""
    choices = itertools.combinations_with_replacement(range(len(trip)), len(query))
    return max(sum(gain(trip[i], q) for i, q in zip(pick, query)) for pick in choices)


def ordered_reuse(trip, query):
    """Best sum over all non-decreasing choices of a query position per trip point."""
    choices = itertools.combinations_with_replacement(range(len(query)), len(trip))
    return max(sum(gain(p, query[j]) for p, j in zip(trip, pick)) for pick in choices)


def ordered_dp(trip, query):
    if len(trip) < 2 or len(query) < 2:
        return 0.0
    return ordered_reuse(trip[1:], query[1:]) / len(trip)


def ordered_all(trip, query):
    """Best sum over monotone lattice paths from the first pair to the last."""
    n, m = len(trip), len(query)
    best = -math.inf
    for downs in itertools.combinations(range(n + m - 2), n - 1):
        i = j = 0
        total = gain(trip[0], query[0])
        for step in range(n + m - 2):
            i, j = (i + 1, j) if step in downs else (i, j + 1)
            total += gain(trip[i], query[j])
        best = max(best, total)
    return best


def lcss(trip, query, near=0.1):
    if len(trip) == 1 or len(query) == 1:
        return 0.0
    match = lambda p, q: abs(p[0] - q[0]) <= near and abs(p[1] - q[1]) <= near
    for size in range(min(len(trip), len(query)), 0, -1):
        for a in itertools.combinations(trip, size):
            if any(all(map(match, a, b)) for b in itertools.combinations(query, size)):
                return 1 - size / min(len(trip), len(query))
    return 1.0


def edwp(trip, query):
    """The greedy walk, on lists that are consumed from the left."""

    def foot(a, b, p):
        if a == b:
            return a
        vx, vy = b[0] - a[0], b[1] - a[1]
        t = (vx * (p[0] - a[0]) + vy * (p[1] - a[1])) / (vx * vx + vy * vy)
        return (a[0] + t * vx, a[1] + t * vy)

    left, right, cost = list(trip), list(query), 0.0
    while len(left) > 1 and len(right) > 1:
        (a, b), (c, d) = left[:2], right[:2]
        on_left, on_right = foot(a, b, d), foot(c, d, b)
        stop_left = (apart(a, c) + apart(on_left, d)) * (apart(a, on_left) + apart(c, d))
        stop_right = (apart(c, a) + apart(on_right, b)) * (apart(c, on_right) + apart(a, b))
        left.pop(0), right.pop(0)
        if stop_left < stop_right:
            cost += stop_left
            if on_left not in (a, b):
                left.insert(0, on_left)
        else:
            cost += stop_right
            if on_right not in (c, d):
                right.insert(0, on_right)
    if len(left) + len(right) > 2:
        longer, single = (left, right[0]) if len(left) > 1 else (right, left[0])
        cost += (apart(longer[0], single) + apart(longer[1], single)) * apart(longer[0], longer[1])
    return cost


def line_distance(p, a, b):
    if a == b:
        return apart(p, a)
    twice_area = abs((b[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (b[1] - a[1]))
    return twice_area / apart(a, b)


def outline(path, epsilon):
    """Kept positions, splitting intervals breadth first."""
    kept, todo = {0, len(path) - 1}, [(0, len(path) - 1)]
    while todo:
        s, e = todo.pop(0)
        inner = [(line_distance(path[i], path[s], path[e]), -i) for i in range(s + 1, e)]
        if inner and max(inner)[0] > epsilon:
            at = -max(inner)[1]
            kept.add(at)
            todo += [(s, at), (at, e)]
    return sorted(kept)


def heading(a, b):
    return math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360


def metres(a, b):
    lng1, lat1, lng2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def simplify(path, middle=25):
    """Kept positions of the weight-based simplification."""
    if len(path) <= 5:
        return list(range(len(path)))
    kept = []
    for base in range(0, len(path), 75):
        chunk = path[base:base + 75]
        n = len(chunk)
        if n < 5:
            kept += range(base, base + n)
            continue
        budget = n // 8 if n <= 25 else n // middle if n < 45 else n // 25
        turn = [heading(chunk[i], chunk[i + 1]) for i in range(n - 1)]
        nhc = [0.0] + [turn[i] - turn[i - 1] for i in range(1, n - 1)] + [0.0]
        ahc = [sum(nhc[max(0, i - 3):i + 4]) for i in range(n)]
        hop = [0.0] + [metres(chunk[i - 1], chunk[i]) for i in range(1, n)] + [0.0]
        weight = [(hop[i] + hop[i + 1]) * (abs(nhc[i]) + abs(ahc[i])) for i in range(n)]
        segs = [range(s, min(s + 6, n)) for s in range(0, n, 6)]
        raw = [
            sum(hop[i] for i in seg[1:]) * (nhc[seg[0]] + sum(abs(nhc[i]) for i in seg)) / len(seg) for seg in segs
        ]
        total, chosen = sum(raw), []
        for seg, r in zip(segs, raw):
            count = int((r / total if total else r) * budget)
            chosen += sorted(sorted(seg, key=lambda i: (-weight[i], i))[:count])
        if not chosen or chunk[chosen[0]] != chunk[0]:
            chosen.insert(0, 0)
        kept += [base + i for i in chosen]
    return kept


def cut(times, gap):
    """(r, seq) of each time in a sorted list of seconds."""
    out, r, seq = [], 0, 0
    for i, t in enumerate(times):
        if i and t - times[i - 1] > gap:
            r, seq = r + 1, 0
        out.append((r, seq))
        seq += 1
    return out
