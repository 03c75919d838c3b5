"""Token ids of whole texts, through a bounded cache of pieces between white space.

The tokenizer's rules never look across ASCII white space, so a text's ids are those of its pieces, one
after the other. A piece's case may be folded (A-Z) and one closing comma or stop after a letter A-Z split
off, since the tokenizer lower-cases and splits there itself. Texts with ``<|`` may hold special tokens,
which are case sensitive: they go to the tokenizer whole. The shortcut holds for tokenizer files that declare
just those rules (``splits_at_space``); any other encodes whole texts.

A slice's pieces are hashed (64 bits) and made distinct at once; only those that the worker doesn't know
yet go to the tokenizer. What is known is a few arrays, some megabytes in all; once it has grown to
``_MOST_CACHED`` pieces, those that were met once only are forgotten.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from runledger.llm import textvec

END = 1
#: Pieces kept by a worker: about 40 bytes each.
_MOST_CACHED = 300_000
#: Fixed value: the pattern in the tokenizer's file, and its meaning for lower-case ASCII.
_DECLARED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_WORD, _PLAIN = re.compile(rb"[a-z]+"), re.compile(rb"[!-~]+")
#: Latin signs without white space: none is changed by NFC, and their classes are the same in every Unicode version.
_LATIN, _LATIN_PARTS = re.compile("[!-~¡-ɏ]+"), regex.compile(_DECLARED)
#: Byte-level tokenizers show printable bytes as themselves and the others as the characters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = _ALPHA[65:91] = True
_ALL = np.ones(256, bool)
_ALL[[9, 10, 11, 12, 13, 32]] = False


class Encoder:
    """encode(body, offsets): the ids of texts in a byte buffer, and where those of each text end."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.splits = splits_at_space(path)
        self.closing = [self._whole(c) for c in ",."] if self.splits else []
        self._forget()

    def _forget(self, kept: np.ndarray | None = None) -> None:
        """Start anew, with the kept places of what is known."""
        if kept is None:
            self.hashes, self.at, self.n, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        else:
            self.hashes, self.n, self.known = self.hashes[kept], self.n[kept], self.known[_ranges(self.at[kept], self.n[kept])]
            self.at = np.cumsum(self.n) - self.n
        self.again = np.zeros(len(self.hashes), bool)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of a piece with A-Z in lower case: its parts by the tokenizer's model where their bounds are plain, else by the whole tokenizer."""
        tokenize = self.tokenizer.model.tokenize
        if _WORD.fullmatch(piece):
            return [t.id for t in tokenize(piece.decode())]
        if _PLAIN.fullmatch(piece):
            return [t.id for part in _PARTS.findall(piece.decode()) for t in tokenize(part)]
        word = piece.decode("utf-8", "replace")
        if _LATIN.fullmatch(word):
            return [t.id for part in _LATIN_PARTS.findall(word.lower()) for t in tokenize(part.encode().decode("latin-1").translate(_BYTE_CHARS))]
        small = "".join(c.lower() for c in word)
        if small.isalpha() and unicodedata.is_normalized("NFC", small) and unicodedata.is_normalized("NFC", word):
            return [t.id for t in tokenize(small.encode().decode("latin-1").translate(_BYTE_CHARS))]
        return self._whole(word)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces (sorted by hash, none known yet)."""
        new = [self._piece(p) for p in pieces]
        n = np.array([len(x) for x in new], np.int64)
        spot = np.searchsorted(self.hashes, hashes)
        self.at = np.insert(self.at, spot, len(self.known) + np.cumsum(n) - n)
        self.hashes, self.n, self.again = np.insert(self.hashes, spot, hashes), np.insert(self.n, spot, n), np.insert(self.again, spot, False)
        self.known = np.concatenate([self.known, np.array([i for x in new for i in x], np.uint32)])

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends): text i has the ids ends[i]:ends[i + 1]."""
        whole = self._special(body, offsets) if self.splits else np.arange(len(offsets) - 1)
        if len(whole):
            return self._mixed(body, offsets, whole)
        starts, ends = textvec.runs(body, offsets, _ALL)
        counts = np.searchsorted(starts, offsets)
        last = body[ends - 1]
        closed = (ends - starts > 1) & ((last == 44) | (last == 46)) & _ALPHA[body[np.maximum(ends - 2, 0)]]
        found, first, place = np.unique(textvec.span_hashes(body, starts, ends - closed), return_index=True, return_inverse=True)
        if len(self.hashes) > _MOST_CACHED:
            self._forget(np.flatnonzero(self.again))
            if len(self.hashes) > _MOST_CACHED // 2:
                self._forget()
        spot = np.minimum(np.searchsorted(self.hashes, found), max(0, len(self.hashes) - 1))
        new = self.hashes[spot] != found if len(self.hashes) else np.ones(len(found), bool)
        self.again[spot[~new]] = True
        if new.any():
            at = first[new]
            self._learn(found[new], [body[a:b].tobytes().lower() for a, b in zip(starts[at], (ends - closed)[at], strict=True)])
            spot = np.searchsorted(self.hashes, found)
        # a closing comma or stop is a piece of its own behind its word
        known = np.concatenate([self.known, *(np.array(c, np.uint32) for c in self.closing)])
        own_at, own_n = self.at[spot][place], self.n[spot][place]
        comma, stop = len(self.closing[0]), len(self.closing[1])
        more_at = len(self.known) + np.where(last == 44, 0, comma)
        more_n = np.where(closed, np.where(last == 44, comma, stop), 0)
        at, n = np.stack([own_at, more_at], axis=1).reshape(-1), np.stack([own_n, more_n], axis=1).reshape(-1)
        total = np.concatenate([[0], np.cumsum(own_n + more_n)])
        return known[_ranges(at, n)], total[counts]

    @staticmethod
    def _special(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold ``<|``."""
        at = np.flatnonzero((body[:-1] == 60) & (body[1:] == 124)) if len(body) else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, at, "right") - 1
        return np.unique(row[at + 1 < offsets[row + 1]])

    def _mixed(self, body: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of texts as usual, the whole ones by the tokenizer."""
        parts, lengths, at = [], [], 0
        for i in [*whole, len(offsets) - 1]:
            if i > at:
                ids, ends = self.encode(body[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at])
                parts.append(ids)
                lengths.append(np.diff(ends))
            if i < len(offsets) - 1:
                parts.append(np.array(self._whole(body[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32))
                lengths.append([len(parts[-1])])
            at = i + 1
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], *lengths]).cumsum()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian uint32 bytes."""
        body, offsets = textvec.buffers(pa.array(texts, pa.string()))
        flat, ends = self.encode(body, offsets)
        return [flat[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each length, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def splits_at_space(path: str) -> bool:
    """Whether the file declares the rules that the shortcut stands on."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = [(s.get("type"), (s.get("pattern") or {}).get("Regex")) for s in (rules.get("normalizer") or {}).get("normalizers") or []]
    pieces = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and [p.get("type") for p in pieces] == ["Split", "ByteLevel"] and pieces[0].get("invert") is True and (pieces[0].get("pattern") or {}).get("Regex") == _DECLARED


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
