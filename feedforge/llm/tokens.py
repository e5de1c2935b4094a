"""Token ids by the tokenizers library, with the pieces of a text cached.

A text is cut where its tokenizer always has a boundary, and equal pieces are encoded once: a byte
BPE with GPT-2's pattern never joins a character that is not white space with white space after it;
a word BPE that drops white space never joins anything across it. Ids of a piece are two bytes each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from feedforge.llm.common import give_back
from feedforge.llm.shingles import mix, powers

# every core has a task of its own, and each thread of the library would hold memory of its own
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker remembers; past that it keeps those of the last batch only.
REMEMBERED = 300_000

#: White space as the tokenizers' patterns have it; Python's own class also holds 1C to 1F.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_UNSAFE = re.compile(r"\s |\0")
_RUNS = re.compile(f"[^{_WS}]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_keys(text: str) -> list[str]:
    """Keys of the pieces of a text under GPT-2's pattern, each a run without white space after the white space before it.

    A key stands for itself after one space; with a null character before it, for itself alone.
    """
    if _UNSAFE.search(text):
        return ["\0" + x for x in _PIECES.findall(text)]
    keys = text.split(" ")
    keys[0] = "\0" + keys[0]
    return keys


def byte_piece(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


def word_pieces(text: str) -> list[str]:
    """Runs without white space."""
    return _RUNS.findall(text) if _ODD.search(text) else text.split()


class CachedEncoder:
    """Encodes batches of texts: `cut` gives the keys of a text's pieces, `piece` the piece of a key, and encode_pieces the bytes of the ids of different pieces."""

    def __init__(self, cut: Callable[[str], list[str]], piece: Callable[[str], str], encode_pieces: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.cut, self.piece, self.encode_pieces, self.remembered = cut, piece, encode_pieces, remembered
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            # the first pieces that a worker met are the frequent ones
            self.known = dict(islice(self.known.items(), self.remembered // 2))
        known = self.known
        cut = [self.cut(t) for t in texts]
        found = [list(map(known.get, pieces)) for pieces in cut]
        late = [i for i, ids in enumerate(found) if None in ids]
        if late:
            new = list({x for i in late for x, ids in zip(cut[i], found[i], strict=True) if ids is None})
            known.update(zip(new, self.encode_pieces(list(map(self.piece, new))), strict=True))
            for i in late:
                found[i] = list(map(known.__getitem__, cut[i]))
        return [b"".join(ids) for ids in found]


def _library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    if max(tokenizer.get_vocab(with_added_tokens=True).values()) >= 1 << 16:
        raise ValueError("ids of two bytes are held for a vocabulary of at most 65,536 tokens")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class LibraryPieces:
    """Encodes pieces by the library.

    Pieces of Latin letters, with or without a space before them, are one pre-token of either
    pattern: such go to the library many at a time, parted by a character that only separates them.
    All other pieces go to the library as they are.
    """

    def __init__(self, path: str, together: int = 500):
        self.together, self.whole, self.parts = together, _library(path), _library(path)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def __call__(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def letters(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of Latin letters one after another, and how many each piece has."""
        groups = [pieces[i : i + self.together] for i in range(0, len(pieces), self.together)]
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self.parts.encode_batch([b"\0".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids.append(np.array(found.ids, "<u2"))
            sizes.append(np.bincount(found.word_ids, minlength=len(group)))
        return np.concatenate(ids), np.concatenate(sizes)


class _Store:
    """Ids by 64-bit key in flat arrays, sorted by key."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.first, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def trim(self) -> None:
        """Forget the newer half when there are too many; the first pieces that a worker met are the frequent ones."""
        if len(self.keys) > self.most:
            middle = np.partition(self.first, len(self.first) // 2)[len(self.first) // 2]
            old = self.first < middle
            self.keys, self.first, self.size, self.pool = self.keys[old], self.first[old], self.size[old], self.pool[:middle].copy()

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        first = np.cumsum(sizes) - sizes + len(self.pool)
        self.pool = np.concatenate((self.pool, ids))
        both = np.concatenate((self.keys, keys))
        order = np.argsort(both, kind="stable")
        self.keys, self.first, self.size = both[order], np.concatenate((self.first, first))[order], np.concatenate((self.size, sizes))[order]


#: Bytes of text that are cut at a time; longer texts go piece by piece.
BLOCK = 1 << 20
#: What a text must not hold to be cut by bytes: runs of white space, white space beyond space and
#: line feed; the tokenizer's special tokens come to it.
_HARD = [b"  ", b"\n ", b" \n", b"\n\n", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe3\x80\x80"]
_CONTROL = b"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_HARD_E2 = re.compile(rb"\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)")
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.zeros(256, bool)
_MARK[[44, 46]] = True


class BlockEncoder:
    """Encodes batches of texts, cutting whole blocks of bytes at once.

    Pieces begin at each space and line feed, after a line feed, and at a full stop or comma after a
    letter; all are boundaries of the patterns. Pieces are told apart by a 64-bit hash and encoded
    once a worker; texts that cannot be cut so go to `slow`.
    """

    def __init__(self, kind: str, slow: CachedEncoder, pieces: LibraryPieces, remembered: int = 500_000):
        self.kind, self.slow, self.pieces = kind, slow, pieces
        self.known = _Store(remembered)
        self.hard = [*_HARD, *(t.content.encode() for t in pieces.whole.get_added_tokens_decoder().values())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        hard = [len(r) > BLOCK or len(r.translate(None, _CONTROL)) < len(r) or any(x in r for x in self.hard) or (b"\xe2" in r and _HARD_E2.search(r) is not None) for r in raws]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip([i for i, h in enumerate(hard) if h], self.slow([t for t, h in zip(texts, hard, strict=True) if h]), strict=True):
            out[i] = ids
        group: list[int] = []
        size = 0
        for i in [i for i, h in enumerate(hard) if not h and raws[i]]:
            if size + len(raws[i]) > BLOCK:
                self._block(raws, group, out)
                group, size = [], 0
            group.append(i)
            size += len(raws[i])
        if group:
            self._block(raws, group, out)
        give_back(0)
        return out

    def _learn(self, raw: bytes, letter: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Encode new pieces and remember them."""
        letters = np.concatenate(([0], np.cumsum(letter)))
        lead = np.frombuffer(raw, np.uint8)[start] == 32
        plain = (letters[stop] - letters[start + lead] == stop - start - lead) & (stop - start > lead)
        cut = lambda on: [raw[a:b] for a, b in zip(start[on].tolist(), stop[on].tolist(), strict=True)]
        ids, sizes = self.pieces.letters(cut(plain))
        rest = self.pieces([x.decode() for x in cut(~plain)])
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        sizes = np.concatenate((sizes, np.array([len(x) // 2 for x in rest], np.int64)))
        self.known.add(keys[order], sizes, np.concatenate((ids, np.frombuffer(b"".join(rest), "<u2"))))

    def _block(self, raws: list[bytes], group: list[int], out: list[bytes]) -> None:
        raw = b"".join([raws[i] for i in group])
        ends = np.cumsum([len(raws[i]) for i in group])
        data = np.frombuffer(raw, np.uint8)
        blank = (data == 32) | (data == 10)
        letter = _LETTER[data]
        pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= pair
        letter[:-1] |= pair
        cut = blank.copy()
        cut[1:] |= (_MARK[data[1:]] & letter[:-1]) | (data[:-1] == 10)
        cut[0] = True
        cut[ends[:-1]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(data))
        if self.kind == "word":  # white space is dropped
            start = start + blank[start]
            start, stop = start[start < stop], stop[start < stop]
        up, down = powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
        keys = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        found, at, which = np.unique(keys, return_index=True, return_inverse=True)
        self.known.trim()
        where = self.known.find(found)
        new = np.flatnonzero(where < 0)
        if len(new):
            self._learn(raw, letter, found[new], start[at[new]], stop[at[new]])
            where = self.known.find(found)
        sizes, first, flat = self.known.size[where], self.known.first[where], self.known.pool
        lengths = sizes[which]
        total = np.cumsum(lengths)
        all_ids = flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first[which] - total + lengths, lengths)]
        # ids of a document end with its last piece
        last = np.searchsorted(start, ends)
        bounds = np.concatenate(([0], total))[last].tolist()
        lo = 0
        for i, hi in zip(group, bounds, strict=True):
            out[i] = all_ids[lo:hi].tobytes()
            lo = hi


_encoders: dict[tuple[str, str], BlockEncoder] = {}


def library_encoder(path: str, kind: str) -> BlockEncoder:
    """The worker's encoder for a vocabulary file; kind is "byte" or "word"."""
    if (path, kind) not in _encoders:
        cut, piece = {"byte": (byte_keys, byte_piece), "word": (word_pieces, str)}[kind]
        pieces = LibraryPieces(path)
        _encoders[path, kind] = BlockEncoder(kind, CachedEncoder(cut, piece, pieces, REMEMBERED // 4), pieces)
    return _encoders[path, kind]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
