"""Edit distances of many pairs at once, by bit vectors (Myers 1999, Hyyro 2003).

A pair takes a word for every 64 characters of its shorter text. Word ``w`` works
on a column of the distance table one step after word ``w - 1``, so that all words
of all pairs do the same step together: a step is some twenty numpy operations.
"""

from __future__ import annotations

import numpy as np

LANES = 8192  # words that work together, over all pairs
SHARED = 128  # so many letters have one numbering for all pairs
BEGINNING = 0.42  # of a text
TOP, ONE = np.uint64(63), np.uint64(1)


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The Levenshtein distance of each pair."""
    return _in_classes([(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs], None)


def within(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Which pairs are at most ``most`` edits apart.

    Most of those that are not need more edits for the beginning of the shorter text alone.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    begun = [64 * max(round(BEGINNING * len(a) / 64), 1) for a, _ in pairs]
    near = np.ones(len(pairs), bool)
    some = [i for i, x in enumerate(begun) if x < len(pairs[i][0])]
    parts = [(pairs[i][0][: begun[i]], pairs[i][1][: begun[i] + m]) for i, m in zip(some, most[some].tolist(), strict=True)]
    gap = np.array([len(pairs[i][0]) - begun[i] - len(pairs[i][1]) for i in some], np.int64)
    near[some] = _in_classes(parts, gap) <= most[some]
    left = np.flatnonzero(near)
    near[left] = _in_classes([pairs[i] for i in left.tolist()], None) <= most[left]
    return near


def _in_classes(pairs: list[tuple[str, str]], gap: np.ndarray | None) -> np.ndarray:
    """Distances of pairs whose first text is the shorter one.

    With ``gap`` (0 at most) the least over the beginnings of the second text, of its distance
    and of how much longer what is left of one is than of the other: ``gap`` and the beginning's length.
    """
    sizes = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    found, words = sizes[:, 1].copy(), -(-sizes[:, 0] // 64)
    order = np.argsort(-words, kind="stable")
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        count = int(words[order[at]])
        end = min(at + max(LANES // count, 1), int(np.searchsorted(-words[order], -(count // 2), "right")))
        some = order[at : max(end, at + 1)]
        at += len(some)
        # A common beginning changes no distance; with it all first texts have as many words.
        fill = np.maximum(64 * count - 63 - sizes[some, 0], 0)
        longest = np.argsort(-(sizes[some, 1] + fill), kind="stable")
        some, fill = some[longest], fill[longest]
        texts = [tuple("\n" * x + y for y in pairs[i]) for i, x in zip(some.tolist(), fill.tolist(), strict=True)]
        found[some] = _distances(texts, sizes[some] + fill[:, None], count, None if gap is None else gap[some] - fill)
    return found


def _distances(pairs: list[tuple[str, str]], sizes: np.ndarray, words: int, gap: np.ndarray | None) -> np.ndarray:
    """Of pairs whose first texts have ``words`` words each; second texts come longest first."""
    n, steps = len(pairs), int(sizes[0, 1])
    where, masks, letters = _masks(pairs, sizes, words, steps)
    base = (np.arange(words)[:, None] * n + np.arange(n)) * letters
    last = ((sizes[:, 0] - 1) % 64).astype(np.uint64)
    score = sizes[:, 0].copy()
    best = None if gap is None else score + np.abs(gap)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    # What enters a word from the one before it: the first row grows by one a column.
    more, less = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    more[0] = ONE
    # Word w is at column step - w; pairs that are through with all columns are the last ones.
    through = np.searchsorted(sizes[::-1, 1], np.arange(steps + words - 1) - words + 1, "right")
    for step, alive in enumerate((n - through).tolist()):
        part = slice(0, min(step + 1, words)), slice(0, alive)
        columns = where[step : step + words][::-1][part]
        match = masks.take(base[part] + columns)
        p, m, plus, minus = up[part], down[part], more[part], less[part]
        vertical = match | m
        match |= minus
        across = match & p
        across += p
        across ^= p
        across |= match
        right = ~(across | p)
        right |= m
        left = p & across
        if step >= words - 1:
            score[:alive] += ((right[-1] >> last[:alive]) & ONE).astype(np.int64)
            score[:alive] -= ((left[-1] >> last[:alive]) & ONE).astype(np.int64)
            if gap is not None:
                np.minimum(best[:alive], score[:alive] + np.abs(gap[:alive] + (step - words + 2)), out=best[:alive])
        out_plus, out_minus = right[: words - 1] >> TOP, left[: words - 1] >> TOP
        right <<= ONE
        right |= plus
        left <<= ONE
        left |= minus
        up[part] = left | ~(vertical | right)
        down[part] = right & vertical
        held = slice(1, 1 + len(out_plus)), part[1]
        more[held], less[held] = out_plus[: words - 1], out_minus[: words - 1]
    return score if gap is None else best


def _masks(pairs: list[tuple[str, str]], sizes: np.ndarray, words: int, steps: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the letter in each column of each pair, the places of each letter, and how many letters there are.

    0 stands for letters that the first texts have not. Many letters are numbered within each pair.
    """
    n = len(pairs)
    first, second = (
        np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in zip(*pairs, strict=True)
    )
    (pair, place), (other, column) = (_places(x) for x in sizes.T)
    number = np.zeros(max(int(first.max()), int(second.max(initial=0))) + 1, np.int64)
    number[first] = 1
    letters = int(number.sum()) + 1
    if letters <= SHARED:
        number[number > 0] = np.arange(1, letters)
        letter, found = number[first], number[second]
    else:
        names, letter = np.unique(pair << 21 | first, return_inverse=True)
        starts = np.searchsorted(names, np.arange(n + 1) << 21)
        letters = int(np.diff(starts).max()) + 1
        letter = letter - starts[pair] + 1
        at = np.minimum(np.searchsorted(names, other << 21 | second), len(names) - 1)
        found = np.where(names[at] == other << 21 | second, at - starts[other] + 1, 0)
    masks = np.zeros(words * n * letters, np.uint64)
    # No two places give the same bit, so their sum is their union.
    np.add.at(masks, ((place >> 6) * n + pair) * letters + letter, ONE << (place & 63).astype(np.uint64))
    where = np.zeros((steps + 2 * words, n), np.int64)
    where[column + words - 1, other] = found
    return where, masks, letters


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character of the texts the number of its text, and its place there."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
