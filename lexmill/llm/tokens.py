"""Vocabulary files and the split before merges, shared by the operators that work on subword ids."""

from __future__ import annotations

import base64
import functools
import re
import sys

import numpy as np

#: The split of the public byte-level vocabularies is
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker before older ones go.
CACHE_WORDS = 250_000


#: Keys longer than this aren't remembered, so that a memory's bound in entries is one in bytes too.
LONGEST_KEY = 128
OTHER, LETTER, NUMBER, SPACE = range(4)


def _marked(letter: str, number: str, space: str) -> np.ndarray:
    """The class of each code point, by strings of all letters, numbers and spaces."""
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for chars, kind in ((letter, LETTER), (number, NUMBER), (space, SPACE)):
        out[np.frombuffer(chars.encode("utf-32-le"), dtype="<u4")] = kind
    return out


def _every() -> str:
    """All code points that texts may have, in order."""
    return "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))


@functools.cache
def code_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE by code point, as the tokenizer libraries' patterns have them.

    Python's and the `regex` module's tables are of other Unicode versions. An encoding of single bytes returns what a pattern
    matches and nothing else."""
    import tiktoken

    every, single = _every(), {bytes([b]): b for b in range(256)}
    matched = lambda p: bytes(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
    return _marked(matched(r"\p{L}"), matched(r"\p{N}"), matched(r"\s"))


def _ranges(wanted: np.ndarray) -> str:
    """A character class of the code points that are wanted."""
    at = np.flatnonzero(np.diff(np.concatenate([[False], wanted, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in at.reshape(-1, 2).tolist())


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    classes = code_classes()
    letter, number, space = (_ranges(classes == k) for k in (LETTER, NUMBER, SPACE))
    exact = rf"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    quick = rf" ?[^\W\d_]+|{CONTRACTIONS}| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    own = _marked(*("".join(re.findall(p, _every())) for p in (r"[^\W\d_]+", r"\d+", r"\s+")))
    odd = _ranges(classes != own)
    return re.compile(exact), re.compile(quick), re.compile(f"[{odd}]")


def pieces(text: str) -> list[str]:
    """The matches of the split. Python's own classes are equal to it but for a few code points; texts with those take the exact form."""
    exact, quick, odd = _patterns()
    return (exact if odd.search(text) else quick).findall(text)


def unlike(text: str) -> bool:
    """Whether the text has code points that Python's own classes take for others than the library's."""
    return _patterns()[2].search(text) is not None


def parts(text: str) -> list[str]:
    """The text cut at each blank before something that isn't white space; the blanks go.

    Words never cross such a place, and what comes before it is split the same whatever follows."""
    return (_BLANK.split if _SPACES.search(text) else _split)(text)


_SPACES, _BLANK = re.compile(r" \s| $"), re.compile(r" (?=\S)")


def _split(text: str) -> list[str]:
    return text.split(" ")


class Encoder:
    """Text to the concatenated codes of its words, each a binary; remembers words and parts of texts."""

    def __init__(self, code_of_word):
        word = Memo(code_of_word, CACHE_WORDS // 4).__getitem__
        self.first = lambda part: b"".join(map(word, pieces(part)))
        # Letters after a blank are one word, and remembered as the part that they are.
        self.rest = Memo(lambda part: code_of_word(" " + part) if part.isalpha() else b"".join(map(word, pieces(" " + part)))).__getitem__

    def __call__(self, text: str) -> bytes:
        first, *rest = parts(text)
        return self.first(first) + b"".join(map(self.rest, rest))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Memo(dict):
    """A dict that computes what it lacks. When it is full its entries become the old ones, and those used again move
    back, so that frequent keys stay. Texts longer than LONGEST_KEY are computed anew each time: memory is bounded by
    twice `most` short keys, results don't change."""

    def __init__(self, compute, most: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if isinstance(key, (str, bytes)) and len(key) > LONGEST_KEY:
                return value
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold ranked merges over the bytes of one word: again and again the leftmost pair of the lowest rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != NONE:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
    return [ranks[p] for p in parts]


NONE = 1 << 60


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, so that a word of n bytes takes n log n steps."""
    import heapq

    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0: no part starts there
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out
