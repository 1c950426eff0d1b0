"""Long texts are cut to stretches without losing a window."""

import numpy as np
import pytest

from siskin.llm import substrings


@pytest.mark.parametrize("most", [1 << 20, 4096, 1000, 101])
def test_every_window_is_in_one_run(most):
    rng = np.random.default_rng(0)
    docs = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 99, 100, 5000, 30_000, 7, 20_000)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    r = substrings.runs(np.concatenate(docs), at, most)
    got = sorted((int(a), int(s) + k) for a, s, w in zip(r["row"], r["start"], r["windows"], strict=True) for k in range(int(w)))
    assert got == [(i, p) for i, d in enumerate(docs) for p in range(len(d) - 99)]


def test_buckets_follow_from_windows_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 400).astype(np.uint8)
    found = []
    for before in (0, 13, 220):
        text = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), shared])
        r = substrings.runs(text, np.array([0, len(text)]))
        by_window = {int(s) + k - before: int(b) for s, w, b in zip(r["start"], r["windows"], r["bucket"], strict=True) for k in range(int(w))}
        found.append({p: b for p, b in by_window.items() if p >= 0})
    assert found[0] == found[1] == found[2]
