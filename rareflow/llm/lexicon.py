"""A word lexicon as a minimal acyclic transducer in one string of bytes.

Words are byte strings, outputs are places in an array of id sequences. Equal suffixes share their
states (built from sorted words, one register of finished states). Each arc carries how many words
come before those behind it, so the sum along a path is the word's place: outputs are shared along
with the suffixes.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np


def _minimal(words: list[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States as (final, arcs (byte, state)) with children first, and the start state."""
    register: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    # The open path of the last word: per depth [final, finished arcs, byte of the open arc].
    path: list[list] = [[False, [], -1]]

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs, _ = path.pop()
            state = (final, tuple(arcs))
            if state not in register:
                register[state] = len(states)
                states.append(state)
            path[-1][1].append((path[-1][2], register[state]))

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        close(common)
        for byte in word[common:]:
            path[-1][2] = byte
            path.append([False, [], -1])
        path[-1][0] = True
        last = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    return states, len(states) - 1


def compile_lexicon(entries: dict[bytes, np.ndarray]) -> bytes:
    """The bytes of a lexicon for words with their ids."""
    words = sorted(entries)
    states, start = _minimal(words)
    behind = np.zeros(len(states), dtype=np.int64)
    first = np.zeros(len(states) + 1, dtype=np.int32)
    final = np.zeros(len(states), dtype=np.uint8)
    labels, targets, before = bytearray(), [], []
    for i, (is_final, arcs) in enumerate(states):
        final[i] = is_final
        count = int(is_final)
        for byte, target in arcs:
            labels.append(byte)
            targets.append(target)
            before.append(count)
            count += int(behind[target])
        behind[i] = count
        first[i + 1] = len(labels)
    lengths = [len(entries[w]) for w in words]
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    ids = np.concatenate([entries[w] for w in words]) if words else np.zeros(0)
    head = np.array([len(states), len(labels), len(words), len(ids), start], dtype=np.int32)
    parts = [head, first, np.array(targets, np.int32), np.array(before, np.int32), offsets, ids.astype("<u4"), final]
    return b"".join(p.tobytes() for p in parts) + bytes(labels)


class Lexicon:
    """Look-ups in a compiled lexicon, straight in the broadcast bytes: no file is written anywhere."""

    def __init__(self, content: bytes):
        self.map = content
        n_states, n_arcs, n_words, n_ids, self.start = (int(x) for x in np.frombuffer(self.map, np.int32, 5))
        at = 20

        view = memoryview(self.map)

        def take(n: int) -> memoryview:
            nonlocal at
            found = view[at : at + 4 * n].cast("i")
            at += 4 * n
            return found

        self.first, self.targets, self.before = take(n_states + 1), take(n_arcs), take(n_arcs)
        self.offsets, self.ids_at = take(n_words + 1), at
        at += 4 * n_ids
        self.final_at, self.labels_at = at, at + n_states

    @classmethod
    def of(cls, content: bytes) -> Lexicon:
        """The lexicon of a broadcast content."""
        return cls(content)

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None."""
        state, place, find, base = self.start, 0, self.map.find, self.labels_at
        first, targets, before = self.first, self.targets, self.before
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            place += before[arc]
            state = targets[arc]
        if not self.map[self.final_at + state]:
            return None
        at = self.ids_at
        return self.map[at + 4 * self.offsets[place] : at + 4 * self.offsets[place + 1]]

    def get_many(self, words: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is found, and the words that are not in the lexicon."""
        found, missing = {}, []
        for word in words:
            ids = self.get(word.encode("utf-8", "surrogatepass"))
            if ids is None:
                missing.append(word)
            else:
                found[word] = ids
        return found, missing
