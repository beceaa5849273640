"""Language identification by spans.

Learning counts, over all labelled texts, hashed character n-grams of words by language, and the scripts of letters.
A word's score for a language is the mean log-probability of its n-grams, times a weight that grows with the word's
length up to a bound; languages that don't use the word's script can't have it. Viterbi over the words with a penalty for switching
labels spans of mixed-language text; all texts of a group run in lockstep.

A null text or one without a letter is `und` with score 0 and no spans. Labels may be any strings; rows with a null
label or text aren't learned from. Ties go to the language that sorts first. Without a label to learn from all texts are `und`. Repeated rows are learned
from and labelled each, very long texts as a group of their own; empty tables give empty results. Other columns pass through, but those named as results are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, boxed, documents, held_out, slices, unboxed

#: n-grams are hashed into so many buckets; the model has languages x BUCKETS numbers.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: A model holds languages x BUCKETS numbers on the driver and in each worker; more labels than this are an error, none is left out.
MAX_LANGUAGES = 2000
SWITCH_PENALTY = 6.0
#: A script counts for a language if it has at least this share of the language's letters.
SCRIPT_SHARE = 0.01
#: Texts and words that run in lockstep at a time, and words a worker remembers; fewer where words x languages would exceed CELLS.
GROUP_TEXTS, GROUP_WORDS, KNOWN_WORDS, CELLS = 8192, 1 << 22, 200_000, 1 << 26

#: Where ranges of scripts begin, by code point, and what they hold.
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "kana", "other", "han", "other", "hangul", "other", "han", "other")
SCRIPT_NAMES = tuple(dict.fromkeys(SCRIPTS))
FIRST_OTHER = chr(SCRIPT_STARTS[1])
#: Combining marks continue a word: scripts such as Devanagari and Thai write vowels with them.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c)[0] == "M")
_LETTERS, _WORD, _MARK, _HIGH = map(re.compile, (r"[^\W\d_]+", rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*", f"[{_MARKS}]", "[\u0300-\U0010ffff]"))


def script_of(word: str) -> int:
    return 0 if word < FIRST_OTHER else SCRIPT_NAMES.index(SCRIPTS[bisect_right(SCRIPT_STARTS, ord(word[0])) - 1])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams of one to three characters, ends marked, and which word each is of."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array(list(map(len, words)), dtype=np.int64) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters from here to the word's end
    buckets, of = [], []
    mixed = np.zeros(len(points), dtype=np.uint64)
    for n in (1, 2, 3):
        mixed = (mixed[: len(points) - n + 1] * np.uint64(0x9E3779B1) + points[n - 1 :] + np.uint64(n)) & np.uint64(0xFFFFFFFF)
        fits = left[: len(mixed)] >= n
        buckets.append((mixed[fits] * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BUCKET_BITS))
        of.append(owner[: len(mixed)][fits])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(of)


def words_of(text: str) -> list[str]:
    text = text.lower()
    pattern = _WORD if _HIGH.search(text) and _MARK.search(text) else _LETTERS
    return [w for w in pattern.findall(text) if w.isalpha() or any(map(str.isalpha, w))]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        smoothed = counts + 0.5
        self.logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.uses = share >= SCRIPT_SHARE
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), dtype=np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): 0 for the best language, less for the others."""
        buckets, owner = grams(words)
        sizes = np.bincount(owner, minlength=len(words))
        fits = np.stack([np.bincount(owner, row[buckets], len(words)) for row in self.logs], axis=1) / sizes[:, None]
        fits *= np.minimum(np.array(list(map(len, words))), 12)[:, None]
        uses = self.uses[:, list(map(script_of, words))].T
        out = np.where(uses, fits - fits.max(axis=1, keepdims=True), -30.0)
        out[~uses.any(axis=1)] = 0.0
        return out

    def look_up(self, words: list[str]) -> np.ndarray:
        """The row of `scores` of each word."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh:
            at = len(self.index)
            while at + len(fresh) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(4096, len(self.scores)), len(self.languages)), dtype=np.float32)])
            self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            self.scores[at : at + len(fresh)] = self.score(fresh)
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Each text's words' languages: the best path of scores less the penalty of every switch."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order])
        flat = np.concatenate([rows[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        cell = np.min_scalar_type(len(self.languages))
        # Where a path comes from, a bit for each word and language, and the language that a switch at a word comes from.
        stays, tops = np.zeros((len(flat), -(-len(self.languages) // 8)), dtype=np.uint8), np.zeros(len(flat), dtype=cell)
        best = self.scores[flat[starts]]
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        end = best.copy()
        for t in range(1, steps):
            n = active[t]
            prior = end[:n]
            top = prior.argmax(axis=1)
            switched = prior[np.arange(n), top][:, None] - SWITCH_PENALTY
            stay = prior >= switched
            stays[starts[:n] + t], tops[starts[:n] + t] = np.packbits(stay, axis=1), top
            end[:n] = np.where(stay, prior, switched) + self.scores[flat[starts[:n] + t]]
        at = end.argmax(axis=1)
        path = np.zeros(len(flat), dtype=cell)
        path[starts + lengths - 1] = at
        for t in range(steps - 1, 0, -1):
            n = active[t]
            here, now = starts[:n] + t, at[:n]
            at[:n] = np.where(stays[here, now >> 3] >> (7 - (now & 7)) & 1, now, tops[here])
            path[starts[:n] + t - 1] = at[:n]
        out: list = [None] * len(rows)
        for k, i in enumerate(order):
            out[i] = path[starts[k] : starts[k] + lengths[k]]
        return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all texts with a label. Each task sums into a table of languages x BUCKETS; Spark adds the tables up."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = [r["lang"] for r in known.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels to learn from")
    languages.sort()
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scripts = np.zeros((len(languages), BUCKETS), dtype=np.int64), np.zeros((len(languages), len(SCRIPT_NAMES)), dtype=np.int64)
        seen: list[dict[str, int]] = [{} for _ in languages]

        def flush() -> None:
            for i, of in enumerate(seen):
                if of:
                    buckets, owner = grams(list(of))
                    total[i] += np.bincount(buckets, np.array(list(of.values()))[owner], BUCKETS).astype(np.int64)
                    for w, n in of.items():
                        scripts[i, script_of(w)] += n * len(w)
                    of.clear()

        for b in slices(batches):
            for label, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if label in number:
                    of = seen[number[label]]
                    for w in words_of(text):
                        of[w] = of.get(w, 0) + 1
            if sum(map(len, seen)) > KNOWN_WORDS:
                flush()
        flush()
        for kind, table in ((0, total), (1, scripts)):
            i, k = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind), pa.int32()), pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(table[i, k], pa.int64())], names=["kind", "i", "k", "n"])

    rows = known.mapInArrow(count, "kind int, i int, k int, n long").groupBy("kind", "i", "k").agg(F.sum("n").alias("n")).toPandas()
    counts, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(SCRIPT_NAMES)))
    for kind, table in ((0, counts), (1, scripts)):
        own = rows[rows["kind"] == kind]
        table[own["i"], own["k"]] = own["n"]
    return Model(languages, counts, scripts)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())]))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the share of words in spans of that language) and spans (of words, from 0)."""
    own = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("spans", SPANS)])
    kept = [f for f in df.schema.fields if f.name not in own.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        texts = words = 0
        most = CELLS // max(1, len(model.languages))
        for b in slices(batches):
            if len(model.index) > min(KNOWN_WORDS, most) and not group:
                model.index.clear()
            group.append((b, [model.look_up(words_of(x)) if model.languages else np.zeros(0, dtype=np.int64) for x in as_text(b.column(text))]))
            texts, words = texts + b.num_rows, words + sum(map(len, group[-1][1]))
            if texts >= GROUP_TEXTS or words >= min(GROUP_WORDS, most):
                yield from settle(group)
                group, texts, words = [], 0, 0
        yield from settle(group)

    def settle(group: list) -> Iterator[pa.RecordBatch]:
        rows = [x for _, r in group for x in r]
        worded = [x for x in rows if len(x)]
        paths = iter(model.label(worded) if worded else [])
        for b, r in group:
            langs, scores, spans = [], [], []
            for x in r:
                if not len(x):
                    langs.append("und"), scores.append(0.0), spans.append([])
                    continue
                path = next(paths)
                counts = np.bincount(path, minlength=len(model.languages))
                langs.append(model.languages[int(counts.argmax())])
                scores.append(float(counts.max() / len(path)))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans.append([{"start": a, "stop": z, "lang": model.languages[path[a]]} for a, z in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, SPAN)], names=[*(f.name for f in kept), *own.names])

    return df.mapInArrow(run, T.StructType(kept + own.fields))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 3, 1)
    model = learn(docs.filter(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def langid_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that holds at least half of their words, learned from the stage's own labelled rows.

    Texts that are null or without a letter go, and all do where no row has a label; nulls in other columns stay. Very long texts are labelled whole. Of languages that
    tie the first label by name is taken. Repeated rows count as often as they are there and are judged alike. An empty table stays empty. Columns that are named as
    the operator's results keep their own values."""
    model = learn(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    return unboxed(identify(boxed(docs, "text"), model).filter("lang_pred <> 'und' and score >= 0.5"), docs)
