"""Ids of the lower-casing word BPE, equal to the tokenizers library's, with pieces looked up in bulk.

White space ends pieces and is dropped, so a text is cut at ASCII white space and each chunk stands alone. In a chunk of
plain characters (letters, numbers and signs that compose with nothing and have a one-character lower case) a piece is a run
of letters, one number, or a run of signs. Chunks with any other character, a contraction or the look of a special token
are pieces of their own that go to the library whole. Pieces are told apart by a 64-bit hash with length, first and last character, and the
ids of known ones come from a table of bounded size; only new ones are encoded: letters by ranks of the same vocabulary, all else by the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain
from pathlib import Path

import numpy as np

from tarnwick.llm.common import inverse, mix, powers, spread

SPACE, LETTER, NUMBER, SIGN, ODD = range(5)
#: Characters of one vectorised step, of the longest remembered piece, and slots of the table of pieces, which is emptied when half full.
STEP, LONGEST, SLOTS = 100_000, 64, 1 << 21
#: Blocks of characters that compose with nothing inside them, by first and last code point.
PLAIN = ((0x21, 0x7E), (0xA1, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
_BASE = 0xD6E8FEB86659FD93
_TOP = 0x10000
_CUT = re.compile(r"[ \t-\r]")
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Class, lower case and hash constant of each code point below 2 ** 16; the last entry is for all above."""
    if not _TABLES:
        kind, lower = np.full(_TOP + 1, ODD, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
        kind[[0x20, 9, 10, 11, 12, 13]] = SPACE
        for first, last in PLAIN:
            for c in range(first, last + 1):
                s, group = chr(c), unicodedata.category(chr(c))
                if len(s.lower()) == 1 and group[0] in "LNPS" and not unicodedata.combining(s) and unicodedata.is_normalized("NFC", s) and ord(s.lower()) < _TOP:
                    kind[c] = {"L": LETTER, "N": NUMBER}.get(group[0], SIGN)
                    lower[c] = ord(s.lower())
        _TABLES.update(kind=kind, lower=lower, constant=mix(lower.astype(np.uint64) + np.uint64(1)))
    return _TABLES


class WordIds:
    """Encodes lists of texts to one array of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.t = Tokenizer.from_file(path), _tables()
        self._letters = self._ranked(path)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.checks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.first, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0

    def forget(self) -> None:
        """Workers that wait for other stages hold no pieces."""
        self._empty()

    @staticmethod
    def _ranked(path: str):
        """The vocabulary as ranks of byte strings. The last byte of a word is written as another one that no lower-case letter has."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        inner = {*range(0x61, 0x7B), *range(0x80, 0x100)}
        ranks = {}
        for token, i in json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"].items():
            word = token.removesuffix("</w>")
            if any(c not in byte_of for c in word):
                continue
            b = bytes(byte_of[c] for c in word)
            if word != token:
                if b[-1] not in _LAST:
                    continue
                b = b[:-1] + bytes([_LAST[b[-1]]])
            if set(b[:-1]) <= inner:
                ranks[b] = i
        return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode(self, piece: str, letters: bool) -> list[int]:
        if letters:
            b = piece.encode()
            return self._letters(b[:-1] + bytes([_LAST[b[-1]]]))
        return self.lib.encode(piece, add_special_tokens=False).ids

    def _put(self, ids: np.ndarray) -> int:
        """Appends ids to the pool and returns where they begin."""
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each known piece, or -1."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        k = self.keys[slot]
        hit = (k == h) & (self.checks[slot] == check)
        out = np.where(hit, slot, -1)
        left = np.flatnonzero(~hit & (k != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            k = self.keys[slot[left]]
            hit = (k == h[left]) & (self.checks[slot[left]] == check[left])
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (k != 0)]
        return out

    def _add(self, h: np.ndarray, check: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """New pieces of distinct hashes."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            got = free[self.keys[slot[free]] == h[free]]
            self.checks[slot[got]], self.first[slot[got]], self.count[slot[got]] = check[got], first[got], count[got]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.known += len(h)

    def _pieces(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, whether each is an odd chunk, hash and check of each."""
        at = np.minimum(cp, _TOP).astype(np.intp)
        kind = self.t["kind"].take(at)
        n = len(cp)
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        inside = kind != SPACE
        start = inside & ((kind != before) | (kind == NUMBER))
        head = inside & (before == SPACE)
        odd = kind == ODD
        for sign, follow in ((0x3C, "|"), (0x27, "stmdrvl")):  # special tokens and contractions
            at_sign = np.flatnonzero(cp[:-1] == sign)
            if sign == 0x27:
                at_sign = at_sign[before[at_sign] != SIGN]
            odd[at_sign[np.isin(cp[at_sign + 1] | 0x20, [ord(c) for c in follow])]] = True
        value = self.t["constant"].take(at)
        whole = np.zeros(n, bool)
        if odd.any():
            chunk = np.cumsum(head)
            marked = np.zeros(int(chunk[-1]) + 1, bool)
            marked[chunk[odd]] = True
            whole = marked[chunk] & inside
            start = np.where(whole, head, start)
            value[whole] = mix(cp[whole].astype(np.uint64) + np.uint64(1 << 32))
        edge = np.append(np.flatnonzero(start | ~inside), n)
        first = start[edge[:-1]]
        a, b = edge[:-1][first], edge[1:][first]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * powers(_BASE, n), out=sums[1:])
        size = (b - a).astype(np.uint64)
        h = mix((sums[b] - sums[a]) * powers(inverse(_BASE), n + 1)[a] + size) | np.uint64(1)
        check = size << np.uint64(42) | self._low(cp[a]).astype(np.uint64) << np.uint64(21) | self._low(cp[b - 1]).astype(np.uint64)
        return a, b, whole[a], h, check

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        offs = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        a, b, whole, h, check = self._pieces(cp)
        if self.known + len(a) > SLOTS // 2:  # a step has STEP pieces or some more
            self._empty()
        slot = self._find(h, check)
        missing = np.flatnonzero(slot < 0)
        own, kept = missing[:0], self.used
        if len(missing):
            long = (b - a)[missing] > LONGEST
            own = missing[long]
            some = missing[~long]
            some = some[np.unique(h[some], return_index=True)[1]]
            asked = np.concatenate([some, own])
            at = np.minimum(cp[a[asked]], _TOP)
            letters = (self.t["kind"][at] == LETTER) & ~whole[asked]
            raw, lower = cp.tobytes().decode("utf-32-le"), self._low(cp).astype("<u4").tobytes().decode("utf-32-le")
            ids = [self._encode((raw if w else lower)[s:e], x) for s, e, w, x in zip(a[asked].tolist(), b[asked].tolist(), whole[asked].tolist(), letters.tolist(), strict=True)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            begins = kept + np.cumsum(n) - n
            self._put(np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())))
            kept += int(n[: len(some)].sum())
            self._add(h[some], check[some], begins[: len(some)], n[: len(some)])
            slot[missing] = self._find(h[missing], check[missing])
            if (slot[some] < 0).any():
                raise RuntimeError("two pieces share a hash")
        first, count = self.first[slot], self.count[slot].astype(np.int64)
        if len(own):
            first[own], count[own] = begins[len(some) :], n[len(some) :]
        ids = self.pool[np.repeat(first, count) + spread(count)]
        self.used = kept  # long pieces lay behind the remembered ones for this step only
        total = np.append(0, np.cumsum(count))[np.searchsorted(a, offs)]
        return ids, np.diff(total)

    def _low(self, cp: np.ndarray) -> np.ndarray:
        return np.where(cp < _TOP, self.t["lower"][np.minimum(cp, _TOP)], cp)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); a null is empty."""
        parts, owner, ids, counts, have = [], [], [], np.zeros(len(texts), np.int64), 0

        def flush() -> None:
            found, n = self._step(parts)
            ids.append(found)
            np.add.at(counts, owner, n)

        for i, text in enumerate(texts):
            at = 0
            while text and at < len(text):
                cut = _CUT.search(text, at + STEP)
                to = cut.end() if cut else len(text)
                parts.append(text[at:to])
                owner.append(i)
                have += to - at
                at = to
                if have >= STEP:
                    flush()
                    parts, owner, have = [], [], 0
        if parts:
            flush()
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


#: Last byte of a word of lower-case letters -> the byte that stands for it at a word's end: upper-case letters and low bytes, which such words lack.
_LAST = {c: c - 0x20 for c in range(0x61, 0x7B)} | {c: c - 0x80 for c in range(0x80, 0xC0)}
