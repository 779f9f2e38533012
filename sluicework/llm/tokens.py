"""Token ids of whole texts, encoding each distinct piece of a text once.

Both tokenizers treat a run of white space with the run of other characters after it on its own,
and end a run of letters before punctuation, so the ids of a text are those of such pieces in turn.
Texts are cut only where the character before a space is surely none itself (ASCII above the space,
or a two-byte letter from U+00C0), and between an ASCII letter and ASCII punctuation.
Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sluicework.llm.text import LOWER, SEPARATORS, buffers

#: Distinct pieces kept between batches; then only those repeated in the last batch stay.
MEMORY = 300_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 2 << 20

_LETTER = (LOWER >= 0x61) & (LOWER <= 0x7A)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _byte_level() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte of Latin letters, asked of the library."""
    whole = ByteLevel(add_prefix_space=False, use_regex=False)
    asked = "".join(map(chr, [*range(0x20, 0x7F), *range(0xC0, 0x280)]))
    return dict(zip(asked.encode(), whole.pre_tokenize_str(asked)[0][0], strict=True))


class Encoder:
    """Ids by one vocabulary file; ``lower`` where the vocabulary itself lower-cases and drops white space."""

    def __init__(self, path: str, lower: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.lower = lower
        self.written = _byte_level()
        self._forget([], [])

    def _forget(self, pieces: list[bytes], ids: list[list[int]]):
        """Start the memory anew with these pieces."""
        self.places: dict[bytes, int] = dict(zip(pieces, range(len(pieces)), strict=True))
        self.bounds = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 17, np.int32)
        self.n = 0
        self._append(ids)

    def _append(self, ids: list[list[int]]):
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        used = int(self.bounds[self.n])
        while self.n + len(ids) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while used + counts.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.bounds[self.n + 1 : self.n + 1 + len(ids)] = used + np.cumsum(counts)
        self.flat[used : used + int(counts.sum())] = [i for x in ids for i in x]
        self.n += len(ids)

    def _ids(self, piece: bytes) -> list[int]:
        """Ids of one piece; a word of Latin letters needs no splitting and goes to the model at once."""
        if piece.isascii() or max(piece) < 0xCA:
            text = piece.decode()
            if self.lower:
                text = text.strip(" ").lower()
            if text.isalpha() or text[:1] == " " and text[1:].isalpha():
                return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.written))]
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def _learn(self, pieces: list[bytes], indices: np.ndarray) -> np.ndarray:
        """Places of distinct pieces in the memory."""
        if self.n > MEMORY:
            often = np.flatnonzero(np.bincount(indices, minlength=len(pieces)) > 1)
            known = [(p, self.places[p]) for p in map(pieces.__getitem__, often.tolist()) if p in self.places]
            self._forget([p for p, _ in known], [self.flat[self.bounds[i] : self.bounds[i + 1]].tolist() for _, i in known])
        get = self.places.get
        places = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            places[new] = np.arange(self.n, self.n + len(new))
            self.places.update(zip(fresh, range(self.n, self.n + len(new)), strict=True))
            self._append([self._ids(p) for p in fresh])
        return places

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, ``end`` after each, and the offsets of the rows."""
        if self.lower:
            texts = pc.ascii_lower(texts)
        data, offsets = buffers(texts)
        rows = len(offsets) - 1
        if not len(data):
            return np.full(rows, end, np.int32), np.arange(rows + 1)
        before = np.zeros(len(data), np.uint8)
        before[1:] = data[:-1]
        lead = np.zeros(len(data), np.uint8)
        lead[2:] = data[:-2]
        solid = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead < 0xE0))
        cut = (SEPARATORS[data] & solid) | (_PUNCTUATION[data] & _LETTER[before])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        indices = pieces.indices.to_numpy()
        places = self._learn(pieces.dictionary.to_pylist(), indices)[indices]
        begins = self.bounds[places]
        counts = self.bounds[places + 1] - begins
        # Each row has one more place for its end.
        heads = np.searchsorted(starts, offsets)
        running = np.concatenate([[0], np.cumsum(counts)])
        out_offsets = running[heads] + np.arange(rows + 1)
        flat = np.arange(int(running[-1]), dtype=np.int32)
        tokens = self.flat[flat + np.repeat((begins - running[:-1]).astype(np.int32), counts)]
        out = np.full(out_offsets[-1], end, np.int32)
        keep = np.ones(len(out), bool)
        keep[out_offsets[1:] - 1] = False
        out[keep] = tokens
        return out, out_offsets


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, lower: bool = False) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if (path, lower) not in _ENCODERS:
        _ENCODERS[path, lower] = Encoder(path, lower)
    return _ENCODERS[path, lower]
