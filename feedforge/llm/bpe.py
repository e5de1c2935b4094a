"""Byte-pair encoding by backtracking, and decoding by an offset table (operator 5).

A piece of text is covered from left to right by the longest tokens that an Aho-Corasick automaton
finds at each place. A token is accepted after another only if the pair is compatible, that is if
merging the bytes of both by the vocabulary's rules would leave the border between them; otherwise
the next shorter token is tried, and when none is left the last token is taken back. A bit for each
place that can't be part of the answer keeps the whole linear. The result is exactly that of
merging pairs by rank, as only one sequence of tokens has compatible neighbours everywhere.

Ids ascend in the order of merges. Decoding gathers bytes of a concatenated vocabulary by offsets.
Texts are first cut by the vocabulary's pattern, and pieces are cached by each worker.

Edge cases: null and empty texts have no ids; the end-of-text string in a text is its own token, as
the library has it; repeated rows are coded each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import slices
from feedforge.llm.tokens import CachedEncoder, byte_keys, byte_piece, texts_of

# Fixed value: the pattern that cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a vocabulary file: printable bytes for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and tables of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_text = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        size = max([*by_text.values(), *self.special.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids of two bytes are held for a vocabulary of at most 65,536 tokens")
        self.tokens: list[bytes] = [b""] * size
        for text, i in by_text.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.order = [-1] * size  # of the merge that makes a token; single bytes come before all
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (by_text[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = by_text[merge.replace(" ", "") if isinstance(merge, str) else "".join(merge)]
            self.rank[left, right] = rank
            self.order[made] = rank
            self.halves.setdefault(made, (left, right))
        self.by_bytes = {self.tokens[i]: i for i in by_text.values()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.by_bytes.items():
            self.automaton.add_word(text.decode("latin-1"), i)
        self.automaton.make_automaton()
        # the next shorter token that begins a token, or -1
        self.shorter = [-1] * size
        for text, i in self.by_bytes.items():
            for n in range(len(text) - 1, 0, -1):
                if (k := self.by_bytes.get(text[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.compatible_cache: dict[int, bool] = {}
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes leaves the border between them alone.

        Both sides are taken apart in the reverse order of their merges; at no time may the two
        tokens at the border merge sooner than the merge that was just undone.
        """
        key = left << 32 | right
        known = self.compatible_cache.get(key)
        if known is not None:
            return known
        # the rank of the merge undone last; the left pair wins where ranks are equal
        limit, last_left, a, b, ok = 1 << 60, False, left, right, True
        while True:
            joint = self.rank.get((a, b))
            if joint is not None and (joint < limit or (joint == limit and not last_left)):
                ok = False
                break
            ra, rb = self.order[a], self.order[b]
            if ra < 0 and rb < 0:
                break
            # undo the later merge; of equal ones, the right one, which came last
            if ra > rb:
                limit, last_left, a = ra, True, self.halves[a][1]
            else:
                limit, last_left, b = rb, False, self.halves[b][0]
        if len(self.compatible_cache) > 1_000_000:
            self.compatible_cache.clear()
        self.compatible_cache[key] = ok
        return ok

    def longest(self, text: bytes) -> list[int]:
        """The longest token that starts at each place."""
        at = [self.by_bytes[text[i : i + 1]] for i in range(len(text))]
        size = [1] * len(text)
        for end, i in self.automaton.iter(text.decode("latin-1")):
            n = len(self.tokens[i])
            start = end - n + 1
            if n > size[start]:
                at[start], size[start] = i, n
        return at

    def encode_piece(self, text: bytes) -> list[int]:
        """The ids of one piece."""
        longest, n, tokens = self.longest(text), len(text), self.tokens
        out: list[int] = []
        possible = bytearray(b"\x01" * (n + 1))
        place = 0
        token = longest[0] if n else -1
        while place < n:
            while True:
                end = place + len(tokens[token])
                if possible[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    place = end
                    token = longest[place] if place < n else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                # no token fits here: the last one is taken back, and as its end is impossible now,
                # a shorter one is tried in its place
                possible[place] = 0
                token = out.pop()
                place -= len(tokens[token])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each one's run of the concatenated vocabulary."""
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.data[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + sizes, sizes)].tobytes()


def piece_encoder(vocabulary: Vocabulary):  # noqa: ANN201
    cut, special = regex.compile(PATTERN), vocabulary.special
    known: dict[str, bytes] = {}
    part = regex.compile("(" + "|".join(regex.escape(x) for x in special) + ")")

    def one(piece: str) -> bytes:
        found = known.get(piece)
        if found is None:
            found = np.array(vocabulary.encode_piece(piece.encode()), "<u2").tobytes()
            known[piece] = found
        return found

    def encode(pieces: list[str]) -> list[bytes]:
        if len(known) > 300_000:
            known.clear()
        out = []
        for text in pieces:
            if special and part.search(text):
                ids = [np.array([special[x]], "<u2").tobytes() if x in special else b"".join(map(one, cut.findall(x))) for x in part.split(text)]
            else:
                ids = map(one, cut.findall(text))
            out.append(b"".join(ids))
        return out

    return encode


_loaded: dict[str, tuple[Vocabulary, CachedEncoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, CachedEncoder]:
    if path not in _loaded:
        v = Vocabulary(path)
        _loaded[path] = v, CachedEncoder(byte_keys, byte_piece, piece_encoder(v))
    return _loaded[path]


def _coded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    vocabulary, encode = loaded(path)
    for batch in slices(batches, 1):
        found = [np.frombuffer(x, "<u2") for x in encode(texts_of(batch.column(1)))]
        wide = [x.astype("<u4") for x in found]
        decoded = [vocabulary.decode(x.astype(np.int64)).decode("utf-8", "replace") for x in found]
        if digest:
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            last, names = [sha(x.tobytes() for x in wide), sha(x.encode() for x in decoded)], ["ids_sha256", "decoded_sha256"]
        else:
            last, names = [pa.array([x.tolist() for x in wide], pa.list_(pa.int32())), pa.array(decoded)], ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), *last], names=["doc_id", "n_tokens", *names])


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text, or digests of both."""
    last = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_coded, path=tokenizer, digest=digest), f"doc_id long, n_tokens long, {last}"
    )
