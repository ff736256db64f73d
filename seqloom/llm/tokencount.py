"""Token counts from compiled finite-state transducers, without producing tokens.

Two machines count what a word-level BPE tokenizer (lower case, pieces by a pattern, merges with an
end-of-word mark) would emit:

* The splitter has seven states over six character classes. A text is cut into chunks; each chunk's
  map from entry state to exit state is found for all states side by side, the maps are composed by a
  parallel prefix scan, and the known entry states then give every piece border at once.
* The counter reads a piece's bytes. Its transitions are annotated with the number of tokens they add,
  which may be zero or negative when a merge takes tokens back. States and transitions are compiled as
  they are met and kept, up to a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CHUNK = 128
#: Compiled states and counted pieces kept in a worker; beyond it they are compiled anew.
MAX_STATES = 150_000
MAX_PIECES = 600_000

# Character classes. The letters of the contractions need a class each.
SPACE_CLASS, LETTER, NUMBER, OTHER, QUOTE = 0, 1, 2, 3, 4
S_ONE, R_, V_, L_, E_ = 5, 6, 7, 8, 9  # s t m d | r | v | l | e: letters that follow a quote
N_CLASSES = 10
# States: between pieces, in letters, in other signs, after a quote at a border, after 'r, 'v, 'l.
GAP, LETTERS, SIGNS, Q, QR, QV, QL = range(7)
N_STATES = 7


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """``to[state, class]`` and ``starts[state, class]``: pieces that begin with this character (1),
    with the one before it (2), or both (3)."""
    to = np.zeros((N_STATES, N_CLASSES), np.uint8)
    starts = np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = [LETTER, S_ONE, R_, V_, L_, E_]
    for state in range(N_STATES):
        for c in range(N_CLASSES):
            if c == SPACE_CLASS:
                to[state, c] = GAP
            elif c == NUMBER:
                to[state, c], starts[state, c] = GAP, 1
            elif c in letters:
                to[state, c], starts[state, c] = LETTERS, state != LETTERS
            elif c == QUOTE and state != SIGNS:
                to[state, c], starts[state, c] = Q, 1
            else:
                to[state, c], starts[state, c] = SIGNS, state != SIGNS
    # A quote at a border: with the right letters it is a piece, else signs go on or letters begin.
    for c in (OTHER, QUOTE):
        to[Q, c], starts[Q, c] = SIGNS, 0
    to[Q, S_ONE], starts[Q, S_ONE] = GAP, 0
    for c, after, last in ((R_, QR, E_), (V_, QV, E_), (L_, QL, L_)):
        to[Q, c], starts[Q, c] = after, 0
        # The letter after the quote turns out to begin a run of letters, unless the pair is complete.
        for d in range(N_CLASSES):
            if d == last:
                to[after, d], starts[after, d] = GAP, 0
            elif d in letters:
                to[after, d], starts[after, d] = LETTERS, 2
            else:
                from_letters = starts[LETTERS, d]
                to[after, d], starts[after, d] = to[LETTERS, d], 2 + from_letters
    return to, starts


TO, STARTS = _splitter()


def split_points(classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in an array of classes that starts between pieces and ends in white space."""
    rows = -(-len(classes) // CHUNK)
    padded = np.full(rows * CHUNK, SPACE_CLASS, np.uint8)
    padded[: len(classes)] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    to, starts = TO.ravel(), STARTS.ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))
    for column in grid:  # all chunks and all entry states at once
        maps *= N_CLASSES
        maps += column
        maps = to.take(maps)
    # Inclusive prefix scan of the maps under composition, doubling the distance each round.
    step = 1
    while step < rows:
        later = maps.copy()
        later[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        maps = later
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[GAP, :-1]
    found = np.empty((CHUNK, rows), np.uint8)
    for i, column in enumerate(grid):
        at = state * N_CLASSES + column
        found[i] = starts.take(at)
        state = to.take(at)
    marks = found.T.ravel()[: len(classes)]
    begins = (marks & 1).astype(bool)
    begins[np.flatnonzero(marks & 2) - 1] = True
    return np.flatnonzero(begins)


class Counter:
    """Counts the tokens of one vocabulary file (JSON, lower case, end-of-word mark)."""

    def __init__(self, path: str, classes: np.ndarray):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        mark = model["end_of_word_suffix"]
        self.classes = classes
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
        alphabet = byte_alphabet()

        def symbols(token: str) -> tuple[bytes, bool]:
            last = token.endswith(mark)
            return bytes(alphabet[c] for c in (token[: -len(mark)] if last else token)), last

        # A token is its bytes and whether it ends a piece; tokens of both kinds may share their bytes.
        self.inner: set[bytes] = set()
        self.final: set[bytes] = set()
        for token in model["vocab"]:
            if token not in specials:
                data, last = symbols(token)
                (self.final if last else self.inner).add(data)
        self.prefixes = {b""}
        for data in (*self.inner, *self.final):
            self.prefixes.update(data[:n] for n in range(1, len(data)))
        self.ranks = {}
        #: Of each merged token: the rank of its merge and the two halves.
        self.made: dict[tuple[bytes, bool], tuple[int, tuple]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pair = symbols(left), symbols(right)
            self.ranks[pair] = rank
            self.made.setdefault((pair[0][0] + pair[1][0], pair[1][1]), (rank, pair))
        self.fits: dict[tuple, bool] = {}
        self.pieces: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        start = (b"", ((None, 0),))
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, int] = {}

    def _adjacent(self, left: tuple[bytes, bool] | None, right: tuple[bytes, bool]) -> bool:
        """Whether the two can stand side by side, that is, no merge across their border comes first.

        Undo the younger of the two, again and again, and ask at each step for a merge of the
        parts at the border that is older than the merges undone so far.
        """
        if left is None:
            return True
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits = {}
            known = self.fits[key] = self._no_older_merge(left, right)
        return known

    def _no_older_merge(self, a: tuple[bytes, bool], b: tuple[bytes, bool]) -> bool:
        ranks, made = self.ranks, self.made
        age_a, half_a = made.get(a, (-1, None))
        age_b, half_b = made.get(b, (-1, None))
        # A merge across the border must come before the merge undone last. Of equal merges the left
        # one comes first: across the border before one in b, but after one in a.
        limit = 1 << 60
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < limit:
                return False
            if age_a > age_b:
                limit = age_a
                a = half_a[1]
                age_a, half_a = made.get(a, (-1, None))
            elif half_b is None:
                return True
            else:
                limit = age_b + 1
                b = half_b[0]
                age_b, half_b = made.get(b, (-1, None))

    def _compile(self, number: int, symbol: int) -> int:
        """The transition of a state on a byte (256 more: on the byte that ends the piece).

        A state is the longest suffix read that can still grow into a token, with the last token and
        the relative count at each position of it. Exactly one token can end the encoding of what has
        been read: the one that fits beside the last token where it begins.
        """
        suffix, history = self.states[number]
        last = symbol >= 256
        grown = suffix + bytes([symbol & 255])
        tokens = self.final if last else self.inner
        for back in range(len(suffix), -1, -1):
            token = grown[len(suffix) - back :]
            before, count = history[back]
            if token in tokens and self._adjacent(before and (before, False), (token, last)):
                break
        else:
            raise ValueError(f"No token of the vocabulary ends {grown!r}")
        added = count + 1
        if last:
            return added + 512
        cut = 0
        while grown[cut:] not in self.prefixes:
            cut += 1
        kept = grown[cut:]
        state = (kept, ((token, 0), *((t, c - added) for t, c in history[: len(kept)])))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        return (target << 10) | (added + 512)

    def count_piece(self, piece: str) -> int:
        if len(self.states) > MAX_STATES:
            self._clear()
        data = piece.encode("utf-8")
        moves, state, total = self.moves, 0, 0
        for byte in data[:-1]:
            key = state << 9 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._compile(state, byte)
            total += (move & 1023) - 512
            state = move >> 10
        key = state << 9 | data[-1] | 256
        move = moves.get(key)
        if move is None:
            move = moves[key] = self._compile(state, data[-1] | 256)
        return total + (move & 1023) - 512

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special string in a text is one token and a border."""
        extra = np.zeros(len(texts), np.int64)
        cleaned = []
        for i, text in enumerate(texts):
            if "<" in text:
                parts = self.special.split(text)
                extra[i] = len(parts) - 1
                text = " ".join(map(normal, parts))
            else:
                text = normal(text)
            cleaned.append(text)
        joined = " ".join(cleaned) + " "
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        begins = split_points(classes)
        stops = np.sort(np.concatenate([begins, np.flatnonzero(classes == SPACE_CLASS)]))
        ends = stops[np.searchsorted(stops, begins, side="right")]
        pieces, known = self.pieces, []
        for a, b in zip(begins.tolist(), ends.tolist()):
            piece = joined[a:b]
            n = pieces.get(piece)
            if n is None:
                n = self.count_piece(piece)
                if b - a <= 64:
                    pieces[piece] = n
            known.append(n)
        if len(pieces) > MAX_PIECES:
            self.pieces = {}
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in cleaned]), begins, side="right")
        return extra + np.bincount(owner, weights=known, minlength=len(texts)).astype(np.int64)


def normal(text: str) -> str:
    """NFC and lower case of each character by itself (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(rest)}}


def character_classes(path: str) -> np.ndarray:
    """The class of every code point, read off the file's own splitting pattern.

    In ``acc`` a letter ``c`` gives one piece, another sign two, a number three and white space one
    piece of one character.
    """
    splitter = Tokenizer.from_file(path).pre_tokenizer
    table = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, 4096):
        # What Unicode assigns to nobody is no letter, number or space.
        points = [p for p in range(low, low + 4096) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs")]
        seen: dict[int, list[int]] = {p: [] for p in points}
        text = "".join(f"a{chr(p)}{chr(p)} " for p in points)
        for _, (a, b) in splitter.pre_tokenize_str(text):
            seen[points[a // 4]].append(b - a)
        for p, sizes in seen.items():
            if sizes == [3]:
                table[p] = LETTER
            elif sizes == [1]:
                table[p] = SPACE_CLASS
            elif sizes == [1, 1, 1]:
                table[p] = NUMBER
    table[ord("'")] = QUOTE
    for letters, c in (("stmd", S_ONE), ("r", R_), ("v", V_), ("l", L_), ("e", E_)):
        for letter in letters:
            table[ord(letter)] = c
    return table


_counters: dict[str, Counter] = {}


def count_tokens(spark: SparkSession, text: Column, vocab_path: str) -> Column:
    """The number of tokens of each text (null: an empty one, 0), as a long.

    Any text is counted whole, in slices of bounded size; a piece of any length is read in one pass.
    The broadcast is one byte for each code point.
    """
    classes = spark.sparkContext.broadcast(character_classes(vocab_path).tobytes())

    @F.arrow_udf("bigint")
    def counts(texts: pa.Array) -> pa.Array:
        if vocab_path not in _counters:
            _counters[vocab_path] = Counter(vocab_path, np.frombuffer(classes.value, np.uint8))
        counter, out, held, size = _counters[vocab_path], [], [], 0
        for value in texts.to_pylist():
            held.append(value or "")
            size += len(held[-1])
            if size > 1_000_000:
                out.append(counter.count(held))
                held, size = [], 0
        if held:
            out.append(counter.count(held))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return counts(text)
