"""Dividing a total by shares, between least and most amounts."""

from __future__ import annotations


def filled(wanted: list[float], least: list[float], most: list[float], total: float) -> list[float]:
    """Amounts within [least, most] that sum to ``total`` and are in proportion to ``wanted`` elsewhere.

    What a bound takes or leaves is made good by the others, in proportion.  If
    the bounds don't allow the total, all amounts are at the bound next to it;
    entries that want nothing stay at their least.
    """
    low = [min(a, b) for a, b in zip(least, most, strict=True)]
    at = lambda f: [min(max(f * w, a), b) for w, a, b in zip(wanted, low, most, strict=True)]
    top = [b if w > 0 else a for w, a, b in zip(wanted, low, most, strict=True)]
    if sum(top) <= total:
        return top
    # the sum is linear between the factors at which an entry meets a bound
    turns = sorted({x / w for w, a, b in zip(wanted, low, most, strict=True) if w > 0 for x in (a, b)} | {0.0})
    before = 0.0
    for factor in turns:
        if sum(at(factor)) >= total:
            break
        before = factor
    else:
        return top
    under = sum(at(before))
    free = sum(w for w, a, b in zip(wanted, low, most, strict=True) if w > 0 and a / w <= before and b / w >= factor)
    return at(before + (total - under) / free) if free and total > under else at(before)
