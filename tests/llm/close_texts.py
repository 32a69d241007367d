"""Groups of texts that are near copies of each other."""

import random


def near_group(n: int, words: int, changes: int, seed: int) -> list[str]:
    """``n`` texts that differ from one base in a few words."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(changes):
            copy[draw.randrange(words)] = f"x{i}y{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out
