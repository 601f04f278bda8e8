"""Edit distance with bit vectors."""

from __future__ import annotations

from os.path import commonprefix


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced characters."""
    n = len(commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) or len(b)
    return _scan(a, b, 1)[-1]


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring, and where the first such one ends."""
    if not pattern or not text:
        return len(pattern), 0
    scores = _scan(pattern, text, 0)
    best = min(scores)
    return (best, scores.index(best) + 1) if best < len(pattern) else (len(pattern), 0)


def _scan(pattern: str, text: str, carry: int) -> list[int]:
    """Distance of the pattern to text up to each character; carry 0 lets a match begin anywhere."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, scores = full, 0, size, []
    for c in text:
        same = places.get(c, 0)
        x = same | down
        diagonal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1 | carry) & full
        minus = minus << 1 & full
        up = minus | (full & ~(x | plus))
        down = plus & x
        scores.append(score)
    return scores
