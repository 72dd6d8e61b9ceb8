"""The adaptive filter against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import filters


def _loop(values, s):
    """The filter written with matrices and lists, all innovations kept."""
    mode, since, out = ("velocity" if s.velocity_first else "basic"), 0, []
    x = last = 0.0
    p, r, seen = s.covariance, s.noise, []
    pos, cov = [0.0, 0.0], [[s.position_covariance, 0.0], [0.0, s.velocity_covariance]]
    for i, z in enumerate(values, 1):
        if mode == "basic":
            velocity = x - last
            x += velocity
            last = x
            p += s.process
            k = p / (p + r)
            seen.append(z - x)
            x += k * (z - x)
            p *= 1 - k
            if s.window and i % s.every == 0 and len(seen[-s.window :]) >= 5:
                w = seen[-s.window :]
                mean = sum(w) / len(w)
                r = max(1.0, math.sqrt(abs(sum(v * v for v in w) / len(w) - mean * mean)) * s.scale)
            value, trend = x, x - last
        else:
            a = [pos[0] + pos[1], pos[1]]
            (p00, p01), (p10, p11) = cov
            m = [[p00 + p10 + p01 + p11 + s.position_process, p01 + p11], [p10 + p11, p11 + s.velocity_process]]
            k = [m[0][0] / (m[0][0] + s.velocity_noise), m[1][0] / (m[0][0] + s.velocity_noise)]
            pos = [a[0] + k[0] * (z - a[0]), a[1] + k[1] * (z - a[0])]
            cov = [[(1 - k[0]) * m[0][0], (1 - k[0]) * m[0][1]], [m[1][0] - k[1] * m[0][0], m[1][1] - k[1] * m[0][1]]]
            value, trend = pos[0], pos[1]
        since += 1
        if since >= s.hold:
            if mode == "basic" and abs(trend) > s.trend:
                mode, since, pos = "velocity", 0, [x, trend]
            elif mode == "velocity" and abs(trend) < s.stable:
                mode, since, x, last = "basic", 0, pos[0], pos[0] - pos[1]
        out.append((value, mode))
    return out


@pytest.mark.parametrize("settings", [filters.Adaptive(), filters.Adaptive(window=20), filters.Adaptive(velocity_first=True, hold=3, stable=0.2, window=7, every=4)])
def test_equals_a_loop(spark, settings):
    rnd = random.Random(1)
    series = {k: [rnd.gauss(0, 1) + (i * k / 5 if i % 90 < 45 else 0) for i in range(rnd.randrange(1, 300))] for k in range(6)}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)] + [(None, 1, 2.0), (3, 500, None)]
    rnd.shuffle(rows)
    got = {}
    for r in filters.kalman_adaptive(spark.createDataFrame(rows, "node int, ts long, value double"), settings=settings).orderBy("node", "n").collect():
        got.setdefault(r["node"], []).append((r["filtered"], r["mode"]))
    modes = set()
    for k, values in series.items():
        want = _loop(values, settings)
        assert [m for _, m in got[k]] == [m for _, m in want]
        assert [v for v, _ in got[k]] == pytest.approx([v for v, _ in want])
        modes |= {m for _, m in want}
    assert modes == {"basic", "velocity"} and set(got) == set(series)


def test_one_key_of_many_rows(spark):
    """A key's rows pass through one task; nothing but the state is kept."""
    n = 1_000_000
    rows = spark.range(n).selectExpr("1 as node", "id as ts", "sin(id / 50) as value")
    out = filters.kalman_adaptive(rows).agg(F.max("n"), F.count("*"), F.max(F.abs("filtered"))).first()
    assert out[0] == out[1] == n and out[2] < 10
