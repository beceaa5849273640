"""Sentences and size-bounded pieces of one text: the sequential helpers that chunking runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa

#: Rows and bytes of an Arrow batch that are turned into Python objects at once; a row over the bytes is alone.
SLICE_ROWS, SLICE_BYTES = 128, 1_000_000

#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = frozenset(
    "ст пп гл разд абз подп ред изм гг см ср напр др пр прим им руб коп тыс млн млрд рис табл стр тел доп обл кв мин сек мп".split()
)
_TOKEN = re.compile(r"\S+")
#: What may stand between a stop and the blank after it, before a token, and at the beginning of a sentence.
_CLOSERS, _OPENERS, _STOPS = "\"»”)]", "(«\"“[", ".!?…"
_LAST = frozenset(_STOPS + _CLOSERS)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few rows, so that Python objects exist for a small part of a batch at a time, however large batches are."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(SLICE_ROWS, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield batch.slice(at, n)
            at += n


def _ends_sentence(token: str, leads: bool) -> bool:
    """Whether a token closes a sentence if something that can open one follows; leads: it is the text's first."""
    bare = token.rstrip(_CLOSERS)
    word = bare.rstrip(_STOPS)
    stops = bare[len(word) :]
    if not stops.startswith("."):
        return bool(stops)
    word = word.lstrip(_OPENERS).lower()
    initials = word and all(len(x) == 1 and x.isalpha() for x in word.split("."))
    numbering = leads and word and not word.strip("0123456789.")
    return not (word in ABBREVIATIONS or initials or numbering)


def sentences(text: str) -> list[str]:
    """One pass over the tokens; a sentence ends between a token that closes one and a token that can open the next."""
    tokens = text.split()
    ends = list(accumulate(map(len, tokens), lambda at, n: at + 1 + n))
    starts, found = [0], []
    for i, token in enumerate(tokens[:-1]):
        if token[-1] in _LAST and ((first := tokens[i + 1][0]).isupper() or first.isdigit() or first in _OPENERS) and _ends_sentence(token, not i):
            found.append(i + 1)
    if not ends or ends[-1] == len(text):  # single blanks between tokens, so that places follow from lengths
        starts += [ends[i - 1] + 1 for i in found]
    else:
        places = [m.start() for m in _TOKEN.finditer(text)]
        starts += [places[i] for i in found]
    return [s for a, z in zip(starts, [*starts[1:], len(text)], strict=True) if (s := text[a:z].strip())]


def pack(parts: list[str], limit: int, glue: str, least: int = 0, most: int | None = None) -> list[str]:
    """Greedy groups of at most `limit` characters; a last one under `least` joins the one before if that stays within `most`."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(glue) + len(part) <= limit:
            out[-1] += glue + part
        else:
            out.append(part)
    if len(out) > 1 and most is not None and len(out[-1]) < least and len(out[-2]) + len(glue) + len(out[-1]) <= most:
        out[-2:] = [out[-2] + glue + out[-1]]
    return out


#: Ways to cut, coarse to fine; words are never cut.
_CUTS = (sentences, lambda t: [p.strip() for p in re.split(r"(?<=;)(?=\s)", t) if p.strip()], lambda t: [p.strip() for p in re.split(r"(?<=,)(?=\s)", t) if p.strip()])


def fit(text: str, limit: int, least: int = 0, most: int | None = None) -> list[str]:
    """Pieces of one paragraph within `limit`, cut as coarsely as possible."""
    if len(text) <= limit:
        return [text]
    parts = next((p for cut in _CUTS if len(p := cut(text)) > 1), None)
    if parts is None:
        return pack(text.split(" "), limit, " ", least, most)
    return pack([x for p in parts for x in fit(p, limit)], limit, " ", least, most)
