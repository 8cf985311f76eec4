import numpy as np
import pytest

from keyloom.llm import pfair_mixing as P


@pytest.mark.parametrize(
    "rows, weights",
    [
        ([1_000_000] * 3, None),
        ([3_000_000, 1_000_000, 1_000_000, 500_000, 500_000], None),
        ([2_000_000, 2_000_000], {"0": 1 - 1e-5, "1": 1e-5}),
        ([1_000_000, 800_000, 700_000], {"0": 0.37113, "1": 0.31417, "2": 0.3147}),
    ],
)
def test_lag_behind_the_weights_themselves(rows, weights):
    names = [str(i) for i in range(len(rows))]
    own = weights or P.tempered(dict(zip(names, rows, strict=True)))
    plan = P.phases(rows, P.tickets_of(own, names))
    blocks = [-(-n // P.BLOCK_ROWS) for n in rows]
    assert sum(blocks) > 100_000
    at = np.full(sum(blocks), -1)
    for i, n in enumerate(blocks):
        mine = [p for p in plan if len(p.slots[i])]
        j = np.arange(n)
        k = np.searchsorted([p.served[i] for p in mine], j, "right") - 1
        for a, p in enumerate(mine):
            b = j[k == a] - p.served[i]
            at[p.first_slot + b // len(p.slots[i]) * p.length + p.slots[i][b % len(p.slots[i])]] = i
    assert (at >= 0).all()
    for a, p in enumerate(plan):
        end = plan[a + 1].first_slot if a + 1 < len(plan) else len(at)
        part, active = at[p.first_slot : end], [i for i in range(len(rows)) if p.served[i] < blocks[i]]
        total = sum(own[names[i]] for i in active)
        for i in active:
            lag = np.cumsum(part == i) - np.arange(1, len(part) + 1) * (own[names[i]] / total)
            assert np.abs(lag).max() < 1 + 1e-6
