"""Exact token ids of whole texts, a piece at a time.

The vocabularies first cut a text into pieces (runs of letters, digits or
symbols, with at most one leading space) and then merge inside each piece, so
a text cut only where a piece must end has the same ids as the whole. The
cuts made here are such *stable boundaries*: each is proven by the characters
next to it, whatever else the text holds.

* Before a run of white space, behind an ASCII character or a Latin-1 letter.
* Before the last character of a longer run that ends there, and behind that
  character unless it is a space, which joins the word that follows.
* Between a letter and an ASCII sign or digit. An apostrophe may open a
  contraction, so nothing is cut right behind one.

Everything else (other scripts, other white space, combining marks) stays
inside a piece, which the library itself encodes. Strings of special tokens
cut a text first, as the library does by default.

Pieces repeat, so each worker keeps the ids of those it has met, by their
bytes, and only new ones reach the library. A text that isn't UTF-8 has U+FFFD
for what isn't, before anything else.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa

from .common import held_by_worker, valid_utf8
from .hashes import span_hashes

#: pieces that a worker keeps; it starts over when that many others came by
MAX_PIECES = 300_000
#: longer pieces are not kept, so the cache is bounded in bytes too
MAX_PIECE_BYTES = 64
#: bytes worked on at once
BLOCK = 1 << 19

_OTHER, _SPACE, _BLANK, _LETTER, _APOSTROPHE, _SIGN, _LATIN = range(7)
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.uint8)
    kind[:128] = _SIGN
    kind[[9, 10, 11, 12, 13]] = _BLANK
    kind[32], kind[39], kind[0xC3] = _SPACE, _APOSTROPHE, _LATIN
    kind[65:91] = kind[97:123] = _LETTER
    return kind


def _pairs() -> np.ndarray:
    """By the classes of two neighbours: 1 a boundary between them, 2 one if
    the next character is certainly not white space."""
    cut = np.zeros((8, 8), np.uint8)
    solid = [_LETTER, _APOSTROPHE, _SIGN]
    for blank in (_SPACE, _BLANK):
        cut[solid, blank] = 1
        cut[[_SPACE, _BLANK], blank] = 2
    cut[_BLANK, [*solid, _LATIN]] = 1
    cut[_LETTER, [_APOSTROPHE, _SIGN]] = 1
    cut[_SIGN, _LETTER] = 1
    return cut.ravel()


_KIND, _CUT = _classes(), _pairs()
_CERTAIN = np.isin(np.arange(8), [_LETTER, _APOSTROPHE, _SIGN, _LATIN])


def stable_boundaries(data: np.ndarray) -> np.ndarray:
    """Positions in ``data`` (UTF-8 bytes) where a piece certainly starts."""
    if not data.size:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    tail = data[second]
    kind[second] = np.where((tail != 0x97) & (tail != 0xB7), _LETTER, _OTHER)
    cut = _CUT[kind[:-1] * 8 + kind[1:]]
    maybe = np.flatnonzero(cut) + 1
    if_next = cut[maybe - 1] == 2
    following = kind[np.minimum(maybe + 1, len(kind) - 1)]
    keep = ~if_next | (_CERTAIN[following] & (maybe + 1 < len(kind)))
    return maybe[keep]


def load_tokenizer(path: str):
    """The library's tokenizer; one thread, as Spark already runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def _byte_signs() -> str:
    """The printable sign that byte-level vocabularies write for each byte:
    itself if it is printable in Latin-1, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
    return "".join(chr(rest.get(b, b)) for b in range(256))


class PieceTokenizer:
    """Token ids of whole texts through kept pieces."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.model, self.signs = self.tok.model, _byte_signs()
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {s.encode(): i for s, i in special.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        norm = self.tok.normalizer
        self.lower = norm is not None and norm.normalize_str("ÀB") == "àb"
        self.space = self.tok.pre_tokenizer.pre_tokenize_str(" a")[0][0].removesuffix("a")
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.store = np.zeros(1 << 20, np.uint32)
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.n = self.used = 0

    def _keep(self, ids: list[int], ends: list[int]) -> None:
        """Keeps the ids of new pieces, those of a block at once. ``ends``:
        where those of each piece end."""
        ends = np.array(ends, np.int64)
        sizes = np.diff(ends, prepend=0)
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store) + len(ids), np.uint32)])
        while self.n + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.begin[self.n:self.n + len(sizes)], self.size[self.n:self.n + len(sizes)] = self.used + ends - sizes, sizes
        self.store[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += len(sizes)

    def _word(self, piece: bytes) -> str | None:
        """What the vocabulary's merges get of a plain word, which needs no
        more cutting; None for other pieces."""
        space = piece[:1] == b" "
        raw = piece[1:] if space else piece
        if raw.isalpha():  # ASCII letters
            word = (raw.lower() if self.lower else raw).decode()
        else:
            word = raw.decode()
            if not _WORD.fullmatch(word):
                return None
            word = word.lower() if self.lower else word
            word = charmap_decode(word.encode(), "strict", self.signs)[0]
        return self.space + word if space else word

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of the pieces are kept. Words that differ only by what
        the vocabulary takes away (a space before them, capitals) share one."""
        get, tokenize = self.at.get, self.model.tokenize
        places = np.array([get(p, -1) for p in pieces], np.int64)
        ids: list[int] = []
        ends: list[int] = []
        words: dict[str, int] = {}
        for k in np.flatnonzero(places < 0).tolist():
            piece = pieces[k]
            word = self._word(piece)
            place = None if word is None else words.get(word)
            if place is None:
                place = self.n + len(ends)
                if word is None:
                    ids += self.tok.encode(piece.decode(), add_special_tokens=False).ids
                else:
                    words[word] = place
                    ids += [t.id for t in tokenize(word)]
                ends.append(len(ids))
            places[k] = place
            if len(piece) <= MAX_PIECE_BYTES:
                self.at[piece] = place
        if ends:
            self._keep(ids, ends)
        return places

    def _block(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each piece that starts at ``starts``, its place among those
        kept. Hashes only group the block's pieces: each is then compared,
        byte by byte, with the first of its group."""
        ends = np.append(starts[1:], len(data))
        grouped = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
        codes, found = grouped.indices.to_numpy(), grouped.dictionary
        if self.n + len(found) > MAX_PIECES:
            self._clear()
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        like, sizes = first[codes], ends - starts
        fits = sizes == sizes[like]
        index = np.arange(len(data)) + np.repeat(np.where(fits, starts[like] - starts, 0), sizes)
        fits &= np.add.reduceat(data != data[index], starts, dtype=np.int64) == 0
        raw = data.tobytes()
        places = self._places([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])[codes]
        odd = np.flatnonzero(~fits)  # other bytes of the same hash
        if odd.size:
            places[odd] = self._places([raw[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist())])
        return places

    def pieces(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of ``data`` start and which of those kept they are.
        ``first``: where its texts start (strictly rising, from 0)."""
        is_start = np.zeros(len(data), bool)
        is_start[first] = is_start[stable_boundaries(data)] = True
        starts = np.flatnonzero(is_start)
        return starts, self._block(data, starts)

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        index = np.repeat(self.begin[places] - ends + sizes, sizes)
        index += np.arange(len(index))
        return self.store[index]

    def segments(self, text: bytes) -> list[bytes]:
        """The text cut at special tokens, which are at the odd places."""
        return self.split.split(text) if any(s in text for s in self.special) else [text]


def piece_tokenizer(path: str) -> PieceTokenizer:
    return held_by_worker(PieceTokenizer, path)


def batched(texts: list[bytes], tok: PieceTokenizer, with_ids: bool):
    """(number of ids, ids or None) of each text, in order; texts are worked on
    about ``BLOCK`` bytes at a time."""
    out: list = [(0, array("I") if with_ids else None)] * len(texts)
    group: list[tuple[int, bytes]] = []
    size = 0

    def work() -> None:
        first = np.cumsum([0] + [len(t) for _, t in group])
        starts, places = tok.pieces(np.frombuffer(b"".join(t for _, t in group), np.uint8), first[:-1])
        at = np.searchsorted(starts, first)
        ends = np.concatenate([[0], np.cumsum(tok.size[places])])[at]
        ids = tok.ids_at(places) if with_ids else None
        for (k, _), a, b in zip(group, ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = (b - a, ids[a:b] if with_ids else None)

    for k, text in enumerate(texts):
        text = valid_utf8(text)
        parts = tok.segments(text)
        if len(parts) > 1:
            done = []
            for odd, part in enumerate(parts):
                if odd % 2:
                    done.append((1, np.array([tok.special[part]], np.uint32)))
                else:
                    done += batched([part], tok, with_ids)
            ids = np.concatenate([np.asarray(x, np.uint32) for _, x in done]) if with_ids else None
            out[k] = (sum(n for n, _ in done), ids)
        elif text:
            if group and size + len(text) > BLOCK:
                work()
                group, size = [], 0
            group.append((k, text))
            size += len(text)
    if group:
        work()
    return out
