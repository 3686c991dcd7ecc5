"""Least-cost shots against the plain recurrence over all words of a clip."""
import random

import pytest

from voxtable.functions import fixed
from voxtable.operators.shot_cuts import cut_shots


def plain(rows):
    """rows (start, end, quality) -> [(first, last)]; the latest beginning wins a tie."""
    n, cost, back = len(rows), [0], [0]
    for j in range(n):
        best = None
        for i in range(j, -1, -1):
            took = rows[j][1] - rows[i][0]
            if took > fixed.SHOT_LOOKBACK_US and i < j:
                break
            d = took / 1e6
            c = (d - 2.5) * (d - 2.5)
            c += 40 * ((d - 3.0) * (d - 3.0)) + 4 if d > 3.0 else 0.0
            c += 25 * ((1.4 - d) * (1.4 - d)) + 2 if d < 1.4 else 0.0
            total = cost[i] + round(c * 1e9) - (0 if j == n - 1 else round(rows[j][2] * 1e9))
            if best is None or total < best[0]:
                best = (total, i)
        cost.append(best[0])
        back.append(best[1])
    out, j = [], n
    while j:
        out.append((back[j], j - 1))
        j = back[j]
    return out[::-1]


@pytest.mark.parametrize("size", [8, 32, 512])
def test_cut_shots(spark, size):
    r = random.Random(size)
    data, want = [], {}
    for clip, n in enumerate((1, 2, 7, 31, 32, 33, 64, 200, 700), 1):
        t, rows = 0, []
        for _ in range(n):
            # crowded stretches hold more than a block within the look-back; a word may outlast it
            end = t + r.choice([60_000, 200_000, 400_000, 400_000, 8_000_000 if r.random() < .05 else 300_000])
            rows.append((t, end, r.choice([3.0, 2.2, 1.4, 0.0, -2.5, 0.6])))
            t = end + r.choice([0, 20_000, 180_000, 600_000, 7_000_000 if r.random() < .1 else 0])
        if clip == 9:
            rows = [(k // 3 * 100_000, k // 3 * 100_000 + 90_000, q) for k, (_, _, q) in enumerate(rows)]
        want[clip] = plain(rows)
        data += [(clip, i, *row, i == n - 1) for i, row in enumerate(rows)]
    r.shuffle(data)
    q = spark.createDataFrame(data, "clip_id bigint, i int, start_us bigint, end_us bigint, bq double, last boolean")
    got = {}
    for x in cut_shots(q, size).orderBy("clip_id", "first_i").collect():
        got.setdefault(x.clip_id, []).append((x.first_i, x.last_i))
    assert got == want
