"""A minimal acyclic transducer: a set of terms as an automaton whose paths add up to a term's place in their order.

The sorted terms make a trie, a level at a time. States whose right languages (all that may follow) are equal are one
state: bottom-up, a state's two 64-bit digests come from whether a term ends there and from its children's labels and
digests; states of equal digests are merged, after their edges have been compared. An edge carries how many terms come
before those behind it, counted from its state; the right language alone decides that, so merged states agree. The sum
along the path of a term is its ordinal, its place among all terms by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 bits in which every bit of ``x`` counts."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SALTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


@dataclass
class Transducer:
    """State 0 is the start. Edges are sorted by ``keys``: 256 times their state, plus the byte they read."""

    keys: np.ndarray
    targets: np.ndarray
    adds: np.ndarray
    final: np.ndarray

    def ordinals(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The ordinals of words, given as bytes and their borders; -1 for those that aren't terms."""
        lengths = np.diff(borders)
        out, state, alive, depth = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.arange(len(lengths)), 0
        while len(alive):
            ended = lengths[alive] == depth
            done, alive = alive[ended], alive[~ended]
            out[done[~self.final[state[done]]]] = -1
            key = state[alive] * 256 + data[borders[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(alive), bool)
            out[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            out[alive] += self.adds[at]
            state[alive] = self.targets[at]
            depth += 1
        return out


def build(data: np.ndarray, borders: np.ndarray) -> Transducer:
    """The minimal transducer of terms that are sorted by their bytes, distinct and not empty."""
    lengths = np.diff(borders)
    # The trie, level by level: of every node its parent, label and first term, and whether a term ends there.
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    ends = [np.zeros(1, bool)]
    active, node, base, depth = np.flatnonzero(lengths > 0), np.zeros(len(lengths), np.int64), 0, 0
    while len(active):
        label, parent = data[borders[active] + depth].astype(np.int64), node[active]
        new = np.ones(len(active), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
        node[active] = np.cumsum(new) - 1
        levels.append((parent[new] + base, label[new], active[new]))
        base += len(levels[-2][0])
        ended = np.zeros(int(new.sum()), bool)
        ended[node[active[lengths[active] == depth + 1]]] = True
        ends.append(ended)
        depth += 1
        active = active[lengths[active] > depth]
    parents, labels, firsts = (np.concatenate([level[i] for level in levels]) for i in range(3))
    final = np.concatenate(ends)
    starts = np.cumsum([0] + [len(level[0]) for level in levels])

    # Digests of right languages, from the deepest level up.
    digests = [_mixed(final.astype(np.uint64), salt) for salt in SALTS]
    for low, high in zip(starts[-2:0:-1], starts[:1:-1]):
        for digest, salt in zip(digests, SALTS):
            np.add.at(digest, parents[low:high], _mixed(digest[low:high] * np.uint64(257) + labels[low:high].astype(np.uint64), salt))
    # Merged states are numbered by their first node: the root, whose language is the longest, is state 0.
    order = np.lexsort(digests)  # stable: the first of equal ones is the first node
    new = np.ones(len(order), bool)
    new[1:] = (digests[0][order[1:]] != digests[0][order[:-1]]) | (digests[1][order[1:]] != digests[1][order[:-1]])
    kept = order[new]
    number = np.empty(len(kept), np.int64)
    number[np.argsort(kept)] = np.arange(len(kept))
    state = np.empty(len(order), np.int64)
    state[order] = number[np.cumsum(new) - 1]
    kept = np.sort(kept)

    # Edges by state and label: children of one node lie side by side, in the order of their labels.
    child = np.arange(1, len(parents))
    counts = np.bincount(parents[1:], minlength=len(parents))
    first_child = np.concatenate([[0], np.cumsum(counts)])[:-1]
    own = np.isin(parents[1:], kept)
    keys = state[parents[1:]] * 256 + labels[1:]
    adds = firsts[1:] - firsts[parents[1:]]
    # Nodes of one state must agree with the node that was kept, edge by edge.
    like = kept[state[parents[1:]]]
    place = child - 1 - first_child[parents[1:]]
    other = np.minimum(first_child[like] + place, max(len(child) - 1, 0))
    same = (counts[like] == counts[parents[1:]]) & (keys[other] == keys) & (state[1:][other] == state[1:]) & (adds[other] == adds)
    if not (same.all() and (final == final[kept[state]]).all()):
        raise ArithmeticError("two states of different right languages have equal digests")
    order = np.argsort(keys[own], kind="stable")
    return Transducer(keys[own][order], state[1:][own][order], adds[own][order], final[kept])
