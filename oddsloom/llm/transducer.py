"""Minimal acyclic transducer over a sorted vocabulary: terms to ordinals in lexicographic order of bytes.

Terms are added in order; a state is frozen once no later term can reach it, and a frozen state equal to an earlier
one is replaced by it, so the automaton is minimal. Each transition carries how many terms sort before it in its
state; the sum of these along a term's path is the term's ordinal.

Transitions lie in an open-addressed table keyed by state and byte, so that all words of a buffer walk side by side:
one step of the walk reads one byte of each word that is still alive.
"""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _State:
    __slots__ = ("arcs", "final", "terms", "number")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, state], in order
        self.final = False
        self.terms = 0
        self.number = -1


def _states(terms: list[bytes]) -> list[_State]:
    """Distinct states of the automaton, the root first."""
    root, register = _State(), {}
    path = [root]

    def freeze(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            state.terms = state.final + sum(s.terms for _, s in state.arcs)
            key = (state.final, *[(b, id(s)) for b, s in state.arcs])
            path[-1].arcs[-1][1] = register.setdefault(key, state)

    before = b""
    for term in terms:
        if term <= before and before:
            raise ValueError("terms must rise")
        common = 0
        for a, b in zip(before, term):
            if a != b:
                break
            common += 1
        freeze(common)
        for byte in term[common:]:
            state = _State()
            path[-1].arcs.append([byte, state])
            path.append(state)
        path[-1].final = True
        before = term
    freeze(0)
    out = [root, *register.values()]
    for number, state in enumerate(out):
        state.number = number
    return out


def build(terms: list[bytes]) -> bytes:
    """The transducer of rising, distinct, non-empty terms, as bytes."""
    states = _states(terms)
    keys, targets, outputs = [], [], []
    for state in states:
        sum_before = int(state.final)
        for byte, target in state.arcs:
            keys.append(state.number * 256 + byte)
            targets.append(target.number)
            outputs.append(sum_before)
            sum_before += target.terms
    bits = max(4, (2 * len(keys) - 1).bit_length())
    key, target, output = np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32)
    table = np.full(1 << bits, -1, np.int64)
    values = np.zeros((1 << bits, 2), np.int32)
    left, slot = np.arange(len(key)), _slots(key, bits)
    while len(left):
        free = table[slot[left]] < 0
        table[slot[left[free]]] = key[left[free]]  # of several arcs for one slot the last one gets it
        placed = table[slot[left]] == key[left]
        values[slot[left[placed]], 0] = target[left[placed]]
        values[slot[left[placed]], 1] = output[left[placed]]
        left = left[~placed]
        slot[left] = (slot[left] + 1) & (len(table) - 1)
    final = np.packbits(np.array([s.final for s in states], bool))
    head = np.array([len(terms), len(states), bits], "<i8")
    return b"".join(a.tobytes() for a in (head, table.astype("<i8"), values.astype("<i4"), final))


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


class Transducer:
    """Reads what ``build`` made."""

    def __init__(self, data: bytes):
        self.n_terms, n_states, self.bits = (int(v) for v in np.frombuffer(data, "<i8", 3))
        size = 1 << self.bits
        self.table = np.frombuffer(data, "<i8", size, 24)
        values = np.frombuffer(data, "<i4", 2 * size, 24 + 8 * size).reshape(size, 2)
        self.target, self.output = values[:, 0].astype(np.int64), values[:, 1].astype(np.int64)
        self.final = np.unpackbits(np.frombuffer(data, np.uint8, -1, 24 + 16 * size))[:n_states].astype(bool)
        # Most steps start in the root: its arcs by byte.
        self.first = np.full(256, -1, np.int64)
        self.first_output = np.zeros(256, np.int64)
        roots = np.flatnonzero((self.table >= 0) & (self.table < 256))
        self.first[self.table[roots]] = self.target[roots]
        self.first_output[self.table[roots]] = self.output[roots]

    def ordinals(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinal of each word data[begin:end]; -1 where it is no term."""
        found = np.full(len(begin), -1, np.int64)
        if not self.n_terms or not len(begin):
            return found
        word = np.flatnonzero(end > begin)
        byte = data[begin[word]]
        state = self.first[byte]
        word, byte, state = word[state >= 0], byte[state >= 0], state[state >= 0]
        total = self.first_output[byte]
        at, stop = begin[word] + 1, end[word]
        mask = len(self.table) - 1
        while len(word):
            over = at == stop
            if over.any():
                ends = over & self.final[state]
                found[word[ends]] = total[ends]
                more = ~over
                word, state, total, at, stop = word[more], state[more], total[more], at[more], stop[more]
            if not len(word):
                break
            key = state * 256 + data[at]
            slot = _slots(key, self.bits)
            held = self.table[slot]
            wrong = np.flatnonzero((held != key) & (held >= 0))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & mask
                held[wrong] = self.table[slot[wrong]]
                wrong = wrong[(held[wrong] != key[wrong]) & (held[wrong] >= 0)]
            known = held == key
            if not known.all():
                word, slot, total, at, stop = word[known], slot[known], total[known], at[known], stop[known]
            state = self.target[slot]
            total = total + self.output[slot]
            at = at + 1
        return found
