import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

@pytest.fixture(scope="session")
def corpus():
    """Small texts with shared passages, exact and near copies, repeats, blanks and one long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(80))
    base = " ".join(word() for _ in range(150))
    rows = [(1, ""), (2, None), (3, "short"), (4, base), (5, base), (6, base.replace(" ", "  ", 3))]
    for i in range(7, 30):
        t = " ".join(word() for _ in range(rng.randint(5, 150)))
        if i % 3 == 0:
            t = f"{t}\n{passage} {word()}"
        if i % 7 == 0:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    rows.append((30, "again and again. " * 60))
    rows.append((31, "é ü ñ " * 90 + passage))
    rows.append((32, " ".join(word() for _ in range(4000)) + " " + passage))
    return rows
