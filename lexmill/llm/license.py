"""License scans: Aho-Corasick over normalised words, and licence expressions by a shunting-yard parser.

One automaton finds identifier tags and notice phrases in a text of lower-case words joined by single blanks, so that a
phrase matches where its words stand consecutively, whatever stands between them. An expression after an identifier
tag is put in postfix order and evaluated: with binds tighter than and, and tighter than or.

Null and empty texts have no words and no labels. Repeated rows are scanned each, very long texts and expressions whole; empty tables give empty results; other
columns pass through, but those named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import LOWER_BYTES, as_bytes, documents, slices

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of further notices.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common public license": "cpl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "business source license": "busl",
    "boost software license": "bsl",
    "academic free license": "afl",
    "open software license": "osl",
    "artistic license": "artistic",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "university of illinois ncsa open source license": "ncsa",
    "creative commons attribution": "cc-by",
    "cc0 1 0 universal": "cc0",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document": "wtfpl",
    "licensed under the apache license": "apache",
    "distributed under the boost software license": "bsl",
}
TAG = "spdx license identifier"
#: Families of licence identifiers by how they begin; a version or variant may follow. A longer beginning comes before a shorter.
FAMILIES = {
    "0bsd": "bsd", "aal": "aal", "afl": "afl", "agpl": "agpl", "aladdin": "aladdin", "apache": "apache", "apsl": "apsl", "artistic": "artistic", "beerware": "beerware", "blueoak": "blueoak", "bsd": "bsd", "bsl": "bsl",
    "busl": "busl", "bzip2": "bzip2", "cc-by-nc-nd": "cc-by-nc", "cc-by-nc-sa": "cc-by-nc", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0", "cddl": "cddl",
    "cecill-b": "cecill-b", "cecill-c": "cecill", "cecill": "cecill", "cpal": "cpal", "cpl": "cpl", "curl": "curl", "ecl": "ecl", "efl": "efl", "elastic": "elastic", "entessa": "entessa", "epl": "epl", "eupl": "eupl",
    "fsfap": "fsfap", "ftl": "ftl", "gfdl": "gfdl", "gpl": "gpl", "hpnd": "hpnd", "icu": "icu", "ijg": "ijg", "intel": "intel", "ipl": "ipl", "isc": "isc", "json": "json", "lgpl": "lgpl", "libpng": "libpng", "libtiff": "libtiff",
    "lppl": "lppl", "miros": "miros", "mit-0": "mit", "mit": "mit", "mpl": "mpl", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "mulanpsl": "mulanpsl", "ncsa": "ncsa", "npl": "npl", "ntp": "ntp", "odbl": "odbl", "odc-by": "odc-by",
    "ofl": "ofl", "openssl": "openssl", "osl": "osl", "pddl": "pddl", "php": "php", "postgresql": "postgresql", "psf": "psf", "python": "psf", "qpl": "qpl", "ruby": "ruby", "sleepycat": "sleepycat", "sspl": "sspl", "tcl": "tcl",
    "unicode": "unicode", "unlicense": "unlicense", "upl": "upl", "vim": "vim", "w3c": "w3c", "wtfpl": "wtfpl", "x11": "mit", "xnet": "mit", "zend": "zend", "zlib": "zlib", "zpl": "zpl",
}
#: Families whose terms pass on to derived works or restrict use.
COPYLEFT = {
    "agpl", "aladdin", "apsl", "busl", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cddl", "cecill", "cpal", "cpl", "elastic", "epl", "eupl", "gfdl", "gpl", "ipl", "lgpl", "mpl", "ms-rl", "npl", "odbl", "osl", "qpl", "sleepycat", "sspl",
}
PRIORITY = {"or": 1, "and": 2, "with": 3}

#: Lower-cases and turns ASCII other than letters and digits into blanks.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)
_WORD = re.compile(rb"[^ ]+")
_AFTER_TAG = re.compile(rb"[^\r\n:a-z0-9]*(:?)[ \t]*([^\r\n]*)")
_VARIANT = re.compile(r"v?[0-9][0-9.]*([-+].*)?|[-+].*|")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-]*")


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: an expression in postfix order, or None where it isn't well formed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether one has just ended
    for t in tokens:
        if t in PRIORITY:
            if not operand:
                return None
            while stack and stack[-1] != "(" and PRIORITY[stack[-1]] >= PRIORITY[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand or "(" not in stack:
                return None
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def family(identifier: str) -> str:
    return next((label for start, label in FAMILIES.items() if identifier.startswith(start) and _VARIANT.fullmatch(identifier[len(start) :])), "other")


def complete(tokens: list[str]) -> int:
    """How many tokens the longest well-formed beginning has, in one pass."""
    end, depth, operand = 0, 0, False
    for i, t in enumerate(tokens, 1):
        if operand != (t in PRIORITY or t == ")") or t == ")" and not depth:
            break
        if t in PRIORITY:
            operand = False
        elif t in "()":
            depth += 1 if t == "(" else -1
        else:
            operand = True
        if operand and not depth:
            end = i
    return end


def evaluate(text: str) -> tuple[set[str], bool] | None:
    """(labels, whether one may choose terms without copyleft) of an expression; the longest well-formed beginning counts."""
    tokens = _TOKEN.findall(text)
    order = postfix(tokens[: complete(tokens)])
    if order is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for t in order:
        if t not in PRIORITY:
            label = family(t)
            stack.append(({label}, label not in COPYLEFT and label != "other"))
            continue
        (right, free_right), (left, free_left) = stack.pop(), stack.pop()
        if t == "with":  # an exception changes terms, it is no licence
            stack.append((left, free_left))
        else:
            stack.append((left | right, free_left or free_right if t == "or" else free_left and free_right))
    return stack[0]


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            entries.setdefault(f" {phrase} ", []).append((kind, label, len(phrase)))
    for key, value in entries.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def after(text: bytes, joined: str, ends: list[int]) -> Iterator[tuple[bool, str]]:
    """What stands in the line behind the words that end at these places of the joined words, in lower case, and whether a colon parts it."""
    if ends:
        wanted, at, n = [], 0, 0
        for end in ends:  # they come in order
            n += joined.count(" ", at, end)
            at = end
            wanted.append(n)
        lowered, places = text.translate(LOWER_BYTES), iter(wanted)
        place = next(places)
        for i, word in enumerate(_WORD.finditer(text.translate(_WORDS)), 1):
            while i == place:
                found = _AFTER_TAG.match(lowered, word.end())
                yield bool(found[1]), found[2].decode(errors="replace").strip()
                place = next(places, -1)


def scan(text: bytes, found) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive) of one text."""
    words = text.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    base: set[str] = set()
    labels: set[str] = set()
    n_base, first, last, at, word, score = 0, None, None, 0, 0, 0.0
    starts: list[int] = []
    tags: list[int] = []
    for end, entries in found.iter(joined):
        for kind, label, length in entries:
            if kind == "tag":
                tags.append(end)  # the blank after the tag's last word
                continue
            labels.add(label)
            score = max(score, 0.6 if kind == "base" else 0.8)
            if kind == "base":
                base.add(label)
                n_base += 1
                starts.append(end - length)
    for start in sorted(starts):
        word += joined.count(" ", at, start)
        at = start
        first, last = (word - 1 if first is None else first), word - 1
    expressions, permissive = [], None
    for rest in after(text, joined, tags):
        colon, written = rest
        got = evaluate(written)
        # Without a colon it may be prose about tags: it counts if all of it is known.
        if got is not None and (colon or "other" not in got[0]):
            labels |= got[0]
            permissive = got[1] if permissive is None else permissive and got[1]
            score = 1.0
            expressions.append(written)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, permissive


_LONG, _TEXT = T.LongType(), T.StringType()
RESULTS = T.StructType(
    [T.StructField(c, _LONG) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(c, _TEXT) for c in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(_TEXT)), T.StructField("permissive", T.BooleanType())]
)


def licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of RESULTS."""
    kept = [f for f in df.schema.fields if f.name not in RESULTS.names]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in slices(batches):
            rows = [scan(x, found) for x in as_bytes(b.column(text))]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *columns], names=[f.name for f in kept] + RESULTS.names)

    return df.mapInArrow(run, T.StructType(kept + RESULTS.fields))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[c for c in RESULTS.names if c not in ("expressions", "permissive")])
