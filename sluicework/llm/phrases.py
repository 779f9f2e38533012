"""Aho-Corasick over words: each known word is one character of the scanned string.

Texts become strings of one character per word, so a pattern of n words is n characters, matches
end at word boundaries by construction, and a position is a word number that maps back to bytes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa

from sluicework.llm.text import ALNUM, Words

_UNKNOWN, _BOUNDARY, _FIRST = 1, 2, 16
#: Distinct words an automaton can name; the surrogates are left out.
VOCABULARY = 0x10FFFF - 0x800 - _FIRST


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text: runs of ASCII letters and digits and of other characters."""
    w = Words(pa.array([text], pa.string()), ALNUM, lower=True)
    return [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]


class Phrases:
    """Finds every place of every pattern; a pattern is a list of words, with a value."""

    def __init__(self, patterns: dict[tuple[str, ...], object]):
        vocabulary = sorted({w for p in patterns for w in p})
        if len(vocabulary) > VOCABULARY:
            raise ValueError("too many distinct words for one automaton")
        encoded = Words(pa.array(vocabulary, pa.string()), ALNUM, lower=True).hashes()
        codes = np.arange(len(vocabulary), dtype=np.uint32) + _FIRST
        codes[codes >= 0xD800] += 0x800
        char = {w: chr(c) for w, c in zip(vocabulary, codes.tolist(), strict=True)}
        order = np.argsort(encoded)
        self.known, self.codes = encoded[order], codes[order]
        self.automaton = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            self.automaton.add_word("".join(char[w] for w in pattern), (len(pattern), value))
        self.automaton.make_automaton()
        self.empty = not patterns

    def find(self, words: Words) -> list[tuple[int, int, object]]:
        """(first word, word after the last, value) of every match, by numbers over all rows."""
        hashes, rows = words.hashes(), words.rows()
        if self.empty or not len(hashes):
            return []
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        stream = np.full(len(hashes) + len(words.counts), _BOUNDARY, np.uint32)
        place = np.arange(len(hashes)) + rows
        stream[place] = np.where(self.known[at] == hashes, self.codes[at], _UNKNOWN)
        back = np.full(len(stream), -1, np.int64)
        back[place] = np.arange(len(hashes))
        text = stream.tobytes().decode("utf-32-le")
        return [(int(back[end]) + 1 - n, int(back[end]) + 1, value) for end, (n, value) in self.automaton.iter(text)]
