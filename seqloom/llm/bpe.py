"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is cut into leaves that are encoded on their own. Neighbours are joined up a binary tree:
around each join a window is encoded anew and grown until it starts with a token of the left side
and ends with one of the right side at token borders where the text may be cut for good. What
lies outside the window is then what encoding the whole would give.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the public pattern that byte-level vocabularies of this kind split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters than this are cut in halves, and those again.
LEAF_CHARS = 32_768
#: Bytes on each side of a join in the first window.
FIRST_WINDOW = 64


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Codec:
    """Encoder and decoder of one vocabulary file (JSON, byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {
            bytes(alphabet[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        # Merges are listed in the order of their ids, so an id is also the rank of its merge.
        self.inner = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.pieces = {i: token for token, i in vocab.items()}
        self.pieces.update({i: s.encode() for s, i in self.special.items()})
        size = max(self.pieces) + 1
        self.table = [self.pieces.get(i, b"") for i in range(size)]
        self.names = [str(i) for i in range(size)]
        self.splitter = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.pretokens = regex.compile(PATTERN)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.table[i] for i in ids]).decode("utf-8", errors="replace")

    def encode_many(self, texts: list[str], leaf_chars: int = LEAF_CHARS) -> list[list[int]]:
        """Ids of each text. Special strings in a text are the special tokens, as the library has it."""
        plan: list[list[int | tuple[int, int]]] = []
        leaves: list[str] = []
        for text in texts:
            parts: list[int | tuple[int, int]] = []
            for piece in self.splitter.split(text) if self.splitter else [text]:
                if piece in self.special:
                    parts.append(self.special[piece])
                elif piece:
                    cut = _leaves(piece, leaf_chars)
                    parts.append((len(leaves), len(leaves) + len(cut)))
                    leaves.extend(cut)
            plan.append(parts)
        encoded = self.inner.encode_ordinary_batch(leaves, num_threads=1) if leaves else []
        out = []
        for parts in plan:
            ids: list[int] = []
            for part in parts:
                if isinstance(part, int):
                    ids.append(part)
                else:
                    ids.extend(self._tree(leaves, encoded, *part))
            out.append(ids)
        return out

    def _tree(self, leaves: list[str], encoded: list[list[int]], low: int, high: int) -> list[int]:
        if high - low == 1:
            return encoded[low]
        mid = (low + high + 1) // 2
        return self.join(self._tree(leaves, encoded, low, mid), self._tree(leaves, encoded, mid, high))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring texts as one text, from the ids of each."""
        size = FIRST_WINDOW
        while True:
            a, left_all = self._back(left, size)
            b, right_all = self._forth(right, size)
            head, tail = left[a:], right[:b]
            text = b"".join([self.table[i] for i in head + tail]).decode("utf-8")
            merged = self._agreed(text, head, tail, left_all, right_all)
            if merged is not None:
                return left[:a] + merged + right[b:]
            size *= 2

    def _back(self, ids: list[int], size: int) -> tuple[int, bool]:
        """Where a window of about ``size`` bytes at the end starts, at a character's start."""
        at, taken = len(ids), 0
        while at and taken < size:
            at -= 1
            taken += len(self.table[ids[at]])
        while at and self.table[ids[at]][0] & 0xC0 == 0x80:
            at -= 1
        return at, at == 0

    def _forth(self, ids: list[int], size: int) -> tuple[int, bool]:
        at, taken = 0, 0
        while at < len(ids) and taken < size:
            taken += len(self.table[ids[at]])
            at += 1
        while at < len(ids) and self.table[ids[at]][0] & 0xC0 == 0x80:
            at += 1
        return at, at == len(ids)

    def _agreed(self, text: str, head: list[int], tail: list[int], left_all: bool, right_all: bool):
        """Ids of the window if both sides agree with it, else None.

        The window's own edges are guesses unless they are the text's edges. Agreement needs, on the
        left, a pretoken border of the window's text at which the left ids and the window's ids have
        the same bytes behind them and two whole pretokens of equal ids before it; on the right a
        border with a pretoken of equal ids behind it. From a border on, how a text is split depends
        on what follows only, so the two splits coincide for good from there.
        """
        ids = self.inner.encode_ordinary(text)
        if left_all and right_all:
            return ids
        old = head + tail
        sizes_new = np.cumsum([len(self.table[i]) for i in ids])
        sizes_old = np.cumsum([len(self.table[i]) for i in old])
        join_at = int(sizes_old[len(head) - 1]) if head else 0
        # Byte offsets of the window's pretoken borders.
        borders, at = [0], 0
        for match in self.pretokens.finditer(text):
            at += len(match.group().encode())
            borders.append(at)
        new_at = {0: 0, **{int(s): n + 1 for n, s in enumerate(sizes_new)}}
        old_at = {0: 0, **{int(s): n + 1 for n, s in enumerate(sizes_old)}}
        left_cut = right_cut = None
        if left_all:
            left_cut = 0
        else:
            # The window's first pretoken may be the rest of a longer one; take a later border.
            for k in range(2, len(borders) - 2):
                x, y = borders[k], borders[k + 1]
                if y >= join_at:
                    break
                if x in old_at and y in old_at and ids[new_at[x] : new_at[y]] == old[old_at[x] : old_at[y]]:
                    if old_at[y] < len(head):
                        left_cut = x
                        break
        if right_all:
            right_cut = borders[-1]
        else:
            # The last two pretokens may go on behind the window.
            for k in range(len(borders) - 4, 0, -1):
                x, y = borders[k], borders[k + 1]
                if x < join_at:
                    break
                if x in old_at and y in old_at and ids[new_at[x] : new_at[y]] == old[old_at[x] : old_at[y]]:
                    right_cut = y
                    break
        if left_cut is None or right_cut is None or left_cut > right_cut:
            return None
        return old[: old_at[left_cut]] + ids[new_at[left_cut] : new_at[right_cut]] + (
            [] if right_all else old[old_at[right_cut] :]
        )


def _leaves(text: str, leaf_chars: int) -> list[str]:
    if len(text) <= leaf_chars:
        return [text]
    mid = len(text) // 2
    return _leaves(text[:mid], leaf_chars) + _leaves(text[mid:], leaf_chars)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(path)


def encode(text: Column, vocab_path: str) -> Column:
    """Ids of each text as an array. A null text is an empty one: no ids."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        out = codec(vocab_path).encode_many([x or "" for x in texts.to_pylist()])
        return pa.array(out, pa.list_(pa.int32()))

    return ids_of(text)


def decode(ids: Column, vocab_path: str) -> Column:
    """The text of each array of ids; a null array is an empty text. Special tokens keep their string."""

    @F.arrow_udf("string")
    def text_of(arrays: pa.Array) -> pa.Array:
        inner = codec(vocab_path)
        return pa.array([inner.decode(x or []) for x in arrays.to_pylist()], pa.string())

    return text_of(ids)


def digest(text: Column, vocab_path: str, leaf_chars: int = LEAF_CHARS) -> Column:
    """A struct of ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text.

    Encodes, decodes the ids and hashes both in one pass, so that no id array leaves the worker.
    A null or empty text has no tokens. Texts come in slices of bounded size, whole.
    """

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digest_of(texts: pa.Array) -> pa.Array:
        inner = codec(vocab_path)
        counts, encoded, decoded = [], [], []
        for start in range(0, len(texts), 256):
            some = [x or "" for x in texts.slice(start, 256).to_pylist()]
            for ids in inner.encode_many(some, leaf_chars):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join([inner.names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(inner.decode(ids).encode("utf-8", "replace")).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return digest_of(text)
