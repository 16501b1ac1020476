"""The suffix sort takes a round for a few bytes, however many strings are tied, and its classes are the equal strings."""

from __future__ import annotations

import numpy as np
import pytest

from finsheet.llm.suffix_dedup import Suffixes


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_rounds_and_classes(letters, monkeypatch):
    rng = np.random.default_rng(letters)
    data = rng.integers(97, 97 + letters, 5000).astype(np.uint8)
    start = np.append(rng.integers(0, 4950, 3000), 4950)  # with repeats; the last string ends with the data
    group = rng.integers(0, 3, 3001)
    sorts, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(len(a[0])) or argsort(*a, **k))
    order, classes = Suffixes(data, 50).classes(start, group)
    assert 1 <= len(sorts) <= 1 + -(-50 // 6)
    keys = [(g, data[s : s + 50].tobytes()) for g, s in zip(group[order], start[order], strict=True)]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(3001))
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == (np.diff(classes) == 0).tolist()
