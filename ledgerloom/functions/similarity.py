"""String similarity for label matching, by published definitions: indel ratio, token ratios, partial ratio, weighted ratio.

These run on distinct labels only, in Arrow batches against the fixed list of variants.
"""

from __future__ import annotations


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200 * common_subsequence(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows cut off at the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    best = 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        best = max(best, ratio(short, window))
        if best == 100:
            break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared, only_a, only_b = " ".join(sorted(left & right)), " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    with_a, with_b = " ".join(filter(None, (shared, only_a))), " ".join(filter(None, (shared, only_b)))
    best = ratio(with_a, with_b)
    if shared:
        best = max(best, ratio(shared, with_a), ratio(shared, with_b))
    return best


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    if set(a.split()) & set(b.split()):
        return 100.0
    return partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if size < 1.5:
        return max(plain, 0.95 * token_ratio(a, b))
    scale = 0.9 if size <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), scale * 0.95 * partial_token_ratio(a, b))
