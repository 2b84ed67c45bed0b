import time

import numpy as np

from tidemark.llm import toxicity


def unlinked(scores, gaps):
    """The search without links."""
    out, total = [], 0.0
    for k, s in enumerate(scores):
        total -= gaps[k] if k else 0.0
        new, total = [k, k, total, total + s], total + s
        while (j := next((j for j in reversed(range(len(out))) if out[j][2] < new[2]), -1)) >= 0 and out[j][3] < new[3]:
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
        out.append(new)
    return [(a, b, r - low) for a, b, low, r in out]


def test_links_change_no_segment():
    rng = np.random.default_rng(4)
    for _ in range(100):
        k = int(rng.integers(0, 200))
        scores, gaps = rng.uniform(0.1, 3, k).tolist(), rng.uniform(0, 3, k).tolist()
        assert toxicity.maximal_segments(scores, gaps) == unlinked(scores, gaps)


def test_the_search_is_linear():
    n = 30_000
    began = time.process_time()
    assert len(toxicity.maximal_segments([1.0] * n, [2.0] * n)) == n
    assert time.process_time() - began < 3
