"""Merging of Burrows-Wheeler transforms by iterative interleave refinement, for shards that fit in memory.

The interleave says, for every place of the merged transform, which shard it comes from. One round sorts the
places stably by their transform symbol, which orders the suffixes by one symbol more than before. Places
that part company in round h share a prefix of h - 1 symbols, so the common prefixes come out of the rounds
and no suffix is sorted again. Rounds stop once prefixes of the wanted length are told apart.

One round costs a pass over all places and there are as many rounds as bytes in a window, which is why
``repeats.py`` does the corpus job another way (figures in the README); the tests hold the two against each
other. Every string ends with its own terminator, so matches never cross strings; empty strings are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Terminator; bytes are shifted up by one.
STOP = 0


@dataclass
class Shard:
    """Transform symbols with, for each, the string and offset of the suffix it precedes."""

    symbols: np.ndarray
    string: np.ndarray
    offset: np.ndarray


def build(strings: list[bytes], first: int = 0) -> Shard:
    """Transform of a few strings by sorting their suffixes; string numbers start at ``first``."""
    places = [(s, o) for s, b in enumerate(strings) for o in range(len(b) + 1)]
    places.sort(key=lambda p: (strings[p[0]][p[1] :], p[0]))
    before = [strings[s][o - 1] + 1 if o else STOP for s, o in places]
    return Shard(np.array(before, dtype=np.int16), np.array([s + first for s, _ in places], dtype=np.int64), np.array([o for _, o in places], dtype=np.int64))


def merge(shards: list[Shard], depth: int) -> tuple[Shard, np.ndarray]:
    """The merged transform, ordered by the first ``depth`` symbols, and the common prefix of each place with the one before (at most ``depth``)."""
    source = np.repeat(np.arange(len(shards)), [len(s.symbols) for s in shards])
    starts = np.cumsum([0, *[len(s.symbols) for s in shards]])[:-1]
    symbols, string, offset = (np.concatenate([getattr(s, c) for s in shards]) for c in ("symbols", "string", "offset"))
    n = len(source)
    common = np.full(n, depth, dtype=np.int64)
    common[:1] = 0
    block = np.zeros(n, dtype=np.int64)
    # place of the k-th entry of its shard under the present interleave
    here = np.arange(n)
    for h in range(1, depth + 1):
        c = symbols[here]
        order = np.argsort(c, kind="stable")
        c, old = c[order], block[order]
        apart = np.ones(n, dtype=bool)
        apart[1:] = (c[1:] != c[:-1]) | (old[1:] != old[:-1]) | (c[1:] == STOP)
        new = apart & (common == depth)
        common[new] = np.minimum(common[new], h - 1)
        block = np.cumsum(apart)
        source = source[order]
        # a shard's own order never changes: its k-th place is its k-th entry
        turn = np.argsort(source, kind="stable")
        here = np.empty(n, dtype=np.int64)
        here[turn] = np.arange(n) - np.repeat(starts, [len(s.symbols) for s in shards]) + starts[source[turn]]
        if apart.all():
            break
    return Shard(symbols[here], string[here], offset[here]), common


def repeated_starts(strings: list[bytes], window: int, per_shard: int = 4) -> set[tuple[int, int]]:
    """(string, offset) of every ``window``-byte string that starts in more than one place."""
    shards = [build(strings[lo : lo + per_shard], lo) for lo in range(0, len(strings), per_shard)]
    if not shards:
        return set()
    whole, common = merge(shards, window)
    near = common >= window
    twice = near | np.append(near[1:], False)
    return set(zip(whole.string[twice].tolist(), whole.offset[twice].tolist(), strict=True))
