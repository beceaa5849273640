"""Token counts by finite-state transducers.

Two deterministic machines. The splitter runs over character classes and marks where words begin; it has 13 states, so
the map of states of any stretch of text is one element of a small finite monoid, and maps compose by a table. A batch
of texts is cut into chunks of equal length; all chunks compute their maps in lockstep, a parallel prefix scan composes
them into each chunk's first state, and a second run marks the words. The merger runs over the bytes of words, all
words in lockstep; each of its transitions is annotated with the change of the number of emitted tokens. A state of the
merger is what later merges can still depend on: the end of the word so far that may continue a token, and which token
the encoding ends with at each place of it. States are compiled as texts need them and are exact for any input.

Null and empty texts have no tokens. The vocabulary's special string inside a text is one token and splits the text.
Repeated rows are counted each, very long texts in many chunks; empty tables give empty results; other columns pass through, but one named as
the result is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, documents, slices
from . import tokens
from .tokens import NONE, Memo, merge, read_ranks

SPECIAL = "<|endoftext|>"
CHUNK = 512
#: States of the merger, of 1 KB each, before those that no word stands at are forgotten; words that run in lockstep.
MOST_STATES, MOST_WORDS = 120_000, 1 << 17
#: A transition holds its state and, in this many low bits, the change of the count plus HALF.
COUNT_BITS = 8
HALF = 1 << (COUNT_BITS - 1)

# Character classes: letters are apart where contractions need them.
LETTER, STMD, R, V, L, E, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, END, PAD = range(13)
# States of the splitter: nothing open; in letters, numbers, others; after ', 'r, 'v, 'l; a contraction ended; one blank
# or other space open; several, the last a blank or another space.
NEW, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE, BLANK1, SPACE1, BLANKS, SPACES = range(13)


@functools.cache
def _classes() -> np.ndarray:
    of = np.zeros(4, dtype=np.uint8)
    of[[tokens.OTHER, tokens.LETTER, tokens.NUMBER, tokens.SPACE]] = OTHER, LETTER, NUMBER, SPACE
    table = of[tokens.code_classes()]
    for chars, k in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = k
    return table


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and marks by state and class; mark 1: a word begins at this character, 2: at the one before."""
    to, marks = np.zeros((13, 13), dtype=np.int16), np.zeros((13, 13), dtype=np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    for state in range(13):
        for c in range(13):
            fresh = LETTERS if c in letters else {NUMBER: NUMBERS, BLANK: BLANK1, SPACE: SPACE1, APOSTROPHE: QUOTE, OTHER: OTHERS, END: NEW}.get(c, state)
            joined = LETTERS if c in letters else {NUMBER: NUMBERS, APOSTROPHE: OTHERS, OTHER: OTHERS}.get(c)
            go, mark = fresh, 1
            if c == PAD:
                go, mark = state, 0
            elif state == LETTERS and c in letters or state == NUMBERS and c == NUMBER:
                go, mark = state, 0
            elif state in (OTHERS, QUOTE) and c in (APOSTROPHE, OTHER):
                go, mark = OTHERS, 0
            elif state == QUOTE and c in (STMD, R, V, L):
                go, mark = {STMD: DONE, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if state == QUOTE_L else E):
                    go, mark = DONE, 0
                else:
                    go, mark = (LETTERS, 2) if c in letters else (fresh, 3)
            elif state in (BLANK1, SPACE1, BLANKS, SPACES):
                several = state in (BLANKS, SPACES)
                if c in (BLANK, SPACE):
                    go, mark = BLANKS if c == BLANK else SPACES, 0
                elif c != END:
                    attaches = state in (BLANK1, BLANKS)
                    go, mark = (joined, 2 * several) if attaches else (fresh, 1 + 2 * several)
            to[state, c], marks[state, c] = go, mark
    return to, marks


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maps of states that texts can make: (maps, map of each class, composition table: first row, then column)."""
    to, _ = _splitter()
    generators = [tuple(int(x) for x in to[:, c]) for c in range(13)]
    index = {g: i for i, g in enumerate(dict.fromkeys([generators[PAD], *generators]))}
    found = list(index)
    for m in found:
        for g in generators:
            n = tuple(g[x] for x in m)
            if n not in index:
                index[n] = len(found)
                found.append(n)
    maps = np.array(found, dtype=np.int16)
    compose = np.empty((len(found), len(found)), dtype=np.int16)
    for i, m in enumerate(found):
        compose[i] = [index[tuple(int(x) for x in row)] for row in maps[:, list(m)]]
    return maps, np.array([index[g] for g in generators], dtype=np.int16), compose


def word_marks(classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each character; `classes` starts where nothing is open. Text ends are words of their own."""
    n = len(classes)
    to, marks = _splitter()
    maps, of_class, compose = _monoid()
    grid = np.full(-(-n // CHUNK) * CHUNK, PAD, dtype=np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
    total = of_class[columns[0]]
    for column in columns[1:]:
        total = compose[total, of_class[column]]
    step = 1  # inclusive prefix scan over the chunks' maps
    while step < len(total):
        total = np.concatenate([total[:step], compose[total[:-step], total[step:]]])
        step *= 2
    state = np.concatenate([[NEW], maps[total[:-1], NEW]]).astype(np.int16)
    out = np.empty_like(columns)
    for i, column in enumerate(columns):
        out[i] = marks[state, column]
        state = to[state, column]
    flat = out.T.reshape(-1)[:n]
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return begins


class Merger:
    """The transducer over the bytes of a word. `next` holds state, count change plus HALF in the low COUNT_BITS, or -1 where not compiled yet."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.states: list[tuple] = []
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.token = {r: t for t, r in ranks.items()}
        self.fits = Memo(lambda pair: merge(self.token[pair[0]] + self.token[pair[1]], ranks) == list(pair), 1 << 17)
        self.forget([])

    def forget(self, live: list[int]) -> None:
        """Drop all states but the first and those in `live`, which get the numbers from 1 on in their order."""
        kept = [self.states[i] for i in live]
        #: (bytes that may continue a token, last token at each place before and between them, count at each place)
        self.states = [(b"", (-1,), (0,))]
        self.states += kept
        self.index = {x: i for i, x in enumerate(self.states)}
        self.next = np.full((max(1024, len(self.states)), 256), -1, dtype=np.int32)

    def compile(self, state: int, byte: int) -> int:
        tail, last, counts = self.states[state]
        x = tail + bytes([byte])
        for at in range(len(x)):
            t = self.ranks.get(x[at:], NONE)
            if t != NONE and (last[at] == -1 or self.fits[last[at], t]):
                break
        count = counts[at] + 1
        last, counts = (*last, t), (*counts, count)
        cut = next((i for i in range(max(0, len(x) - self.longest), len(x)) if x[i:] in self.prefixes), len(x))
        # A place counts only if a token may still begin there; others are alike, which makes many states one.
        live = [i == len(x) or x[i:] in self.prefixes for i in range(cut, len(x) + 1)]
        key = (x[cut:], tuple(t if yes else -2 for t, yes in zip(last[cut:], live, strict=True)), tuple(c - count if yes else 0 for c, yes in zip(counts[cut:], live, strict=True)))
        found = self.index.get(key)
        if found is None:
            found = self.index[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next[: max(1024, len(self.next) // 4)], -1)])
        if not -HALF <= count < HALF:
            raise OverflowError(f"a byte changes the count by {count}")
        self.next[state, byte] = value = (found << COUNT_BITS) + HALF + count
        return value

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of tokens of each word data[start : start + length], MOST_WORDS words at a time in lockstep."""
        return np.concatenate([self._count(data, starts[at : at + MOST_WORDS], lengths[at : at + MOST_WORDS]) for at in range(0, len(starts), MOST_WORDS)] or [np.zeros(0, dtype=np.int64)])

    def _count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        for i, n in enumerate(active):
            if len(self.states) > MOST_STATES:  # also amid long words
                live, place = np.unique(state[:n], return_inverse=True)
                some = live[live > 0]
                self.forget(some.tolist())
                state[:n] = place + (1 - (len(live) - len(some)))
            byte = data[starts[:n] + i]
            value = self.next[state[:n], byte]
            missing = np.flatnonzero(value < 0)
            if len(missing):
                for pair in np.unique(state[missing] * 256 + byte[missing]):
                    self.compile(int(pair) >> 8, int(pair) & 255)
                value = self.next[state[:n], byte]
            state[:n] = value >> COUNT_BITS
            total[:n] += (value & (2 * HALF - 1)) - HALF
        out = np.empty_like(total)
        out[order] = total
        return out


def count_batch(texts: list[str], merger: Merger) -> np.ndarray:
    """The number of tokens of each text."""
    parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        split = text.split(SPECIAL) if SPECIAL in text else [text]
        extra[i] = len(split) - 1
        parts += split
        owner += [i] * len(split)
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    classes = _classes()[points]
    classes[ends] = END
    begins = np.flatnonzero(word_marks(classes))
    sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = offsets[begins]
    lengths = np.diff(np.concatenate([starts, offsets[-1:]]))
    word = classes[begins] != END
    begins, starts, lengths = begins[word], starts[word], lengths[word]
    counts = merger.count(np.frombuffer(joined.encode(), dtype=np.uint8), starts, lengths)
    of = np.array(owner, dtype=np.int64)[np.searchsorted(ends, begins)]
    return extra + np.bincount(of, counts, len(texts)).astype(np.int64)


@functools.lru_cache(1)
def _merger(path: str) -> Merger:
    """A worker's machine; what one task has compiled serves the next."""
    return Merger(read_ranks(path))


def token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each text under the byte-level vocabulary of ranks at `path`."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.LongType(), False)])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for b in slices(batches, 512):
            n = pa.array(count_batch(as_text(b.column(text)), merger), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, name])

    return df.mapInArrow(run, schema)


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank file has the vocabulary of byte_bpe_50k.json."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
