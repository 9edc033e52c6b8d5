"""Long lists of children that all differ are matched as short ones are."""

import random

import numpy as np

from llm import html_text


def listed(cells):
    """A root whose children have these children, by label."""
    parents, labels = [-1], [0]
    for row in cells:
        at = len(parents)
        parents.append(0)
        labels.append(1)
        for c in row:
            parents.append(at)
            labels.append(c)
    return parents, labels


def best(x, y):
    """The largest matching of two such trees, by its definition."""

    def common(a, b):
        w = [0] * (len(b) + 1)
        for p in a:
            w, above = [0], w
            for k, q in enumerate(b):
                w.append(max(above[k + 1], w[k], above[k] + (p == q)))
        return w[-1]

    w = np.zeros(len(y) + 1, int)
    for a in x:
        row = w[:-1] + [1 + common(a, b) for b in y]
        w = np.append(0, np.maximum.accumulate(np.maximum(w[1:], row)))
    return 1 + w[-1]


def test_long_lists_have_the_largest_matching(monkeypatch):
    r = random.Random(8)
    for n, m in ((6, 7), (150, 140), (260, 200)):
        x, y = ([[r.randrange(2, 6) for _ in range(r.randrange(1, 7))] for _ in range(k)] for k in (n, m))
        out = html_text.align(listed(x), listed(y))
        assert sum(s >= 0 for s in out) == best(x, y)
        used = [s for s in out if s >= 0]
        assert used == sorted(set(used))
    monkeypatch.setattr(html_text, "HELD", 50, raising=False)
    monkeypatch.setattr(html_text, "CELLS", 300, raising=False)
    assert html_text.align(listed(x), listed(y)) == out  # what isn't remembered is worked out again
