"""Language-model scoring with causal self-attention over subword ids.

Words are lower-cased runs without white space, and an end token closes each text. The model spells a word by the ids of a public vocabulary
and predicts each id in two steps: its class by one layer of causal self-attention over the ids before it, trained in
numpy, and the id in its class by its share of all training tokens. Texts are scored in overlapping windows, each id once,
many windows at a time. Classes are groups of ids that occur in alike company, cut by frequency; those of ids that begin words are
apart, so that the model gives proper probabilities to whole words. A word that training has seen is also predicted as a whole: the class of its first
id by attention, and the word in that class by its share of all training words. With S the share of words seen once among training tokens:

    P(word) = (1 - S) * P_attention(class of the first id) * c / (words of that class) + S * P_attention(ids of the word)

Texts are cut into passages at words chosen by their hash, and passages that training has more than once are remembered.
With M the share of training passages that repeat an earlier one:

    P(passage) = (1 - M) * product of P(word) + (c - 1) / (all training passages)

Counts of words, ids and passages, ids' company and the attention's weights come from every training text: the driver starts on some windows
of about FIRST_TEXTS of them, then every task goes on with all windows of its own texts, and Spark averages the tasks' weights by their windows.
Words with a share of HOT_SHARE for each 32 bytes, which hold 32 MB in all at most, are looked up where texts are; the others meet their counts in a join.

Null and empty texts have the end token only. Null ids count as the empty text where ids decide what to learn from. Repeated rows are
learned and scored each. Without training texts counts are zero, the attention model predicts alike classes, and words are only
spelled. Very long texts are many windows and passages. Empty tables give empty results; other columns than doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import LOWER_BYTES, as_bytes, documents, held_out, release, slices, written
from .tokens import LONGEST_KEY, PATTERN, Memo, pieces, read_ranks, unlike

WIDTH, WINDOW, STRIDE = 24, 32, 24
#: Groups of ids of alike company among those that begin words and among the others, and frequency tiers of each.
GROUPS, BEGIN_TIERS, OTHER_TIERS, EMBEDDED = 8, 3, 5, 1024
#: Ids whose frequency in a text describes its company.
ANCHORS = 48
HOT_SHARE = 1e-6
FIRST_TEXTS, FIRST_WINDOWS = 3000, 8
STEPS, BATCH, RATE, LATER_RATE = 600, 64, 0.01, 0.002
END, START, IDS = 50256, 50257, 50258
#: A passage ends after one word in so many; passages with at least this share of all are joined by broadcast, of which there can't be more than 1 / HOT_MARKS.
PASSAGE, HOT_MARKS = 64, 1e-4
#: Windows that run through the model at a time, and words counted before they are handed on.
GROUP, COUNTED = 256, 1_000_000
SEED = 11


class Speller(Memo):
    """word (bytes, lower case) -> its ids as 16-bit bytes; the first stands for the blank before it too."""

    def __init__(self, path: str):
        import tiktoken

        self.ranks, self.begins = read_ranks(path), begins_word(path)
        one = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.whole = tiktoken.Encoding("all", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

        def spell(word: bytes) -> bytes:
            text = word.decode(errors="replace")
            if text.isalpha():  # one piece
                return array("H", one.encode_ordinary(" " + text)).tobytes()
            return array("H", [i for p in pieces(" " + text) for i in one.encode_ordinary(p)] if word else [END]).tobytes()

        super().__init__(spell)

    def learn(self, words: Iterator[bytes]) -> None:
        """Spells what it lacks of words in one call; what might run into the next word, and what Python takes for other characters than the library, is left to be spelled alone."""
        new = [w for w in set(words) if w and w not in self and w not in self.old and len(w) <= LONGEST_KEY]
        joined = b" ".join(new).decode(errors="replace")
        if _OTHER_SPACE.search(joined) or unlike(joined):
            new = [w for w in new if not (_OTHER_SPACE.search(t := w.decode(errors="replace")) or unlike(t))]
            joined = b" ".join(new).decode(errors="replace")
        if new:
            ids = np.array(self.whole.encode_ordinary(" " + joined), dtype="<u2")
            starts = (2 * np.flatnonzero(self.begins[ids])).tolist()  # exactly one id of a word begins one
            codes = ids.tobytes()
            for word, a, z in zip(new, starts, [*starts[1:], len(codes)], strict=True):
                self.keep(word, codes[a:z])

    def codes(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.get, words))
        if lacked := {w for w, code in zip(words, found, strict=True) if code is None}:
            self.learn(lacked)
            found = [self[w] if code is None else code for w, code in zip(words, found, strict=True)]
        return found


@functools.cache
def speller(path: str) -> Speller:
    """One for all tasks of a worker, so that words are spelled once."""
    return Speller(path)


def begins_word(path: str) -> np.ndarray:
    """Whether each id begins a word: exactly one of a word's ids does."""
    out = np.zeros(IDS, dtype=bool)
    out[END] = True
    for token, rank in read_ranks(path).items():
        out[rank] = token[:1] == b" "
    return out


class Words:
    """Ids of words back to the words, many at a time."""

    def __init__(self, path: str):
        tokens = [b""] * IDS
        for token, rank in read_ranks(path).items():
            tokens[rank] = token.removeprefix(b" ")
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=IDS)
        self.starts, self.all = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        chars = self.all[np.repeat(self.starts[ids] - ends + n, n) + np.arange(n.sum())]
        at = np.append(0, np.append(0, ends)[np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.tobytes()), pa.py_buffer(chars.tobytes()))


def clusters(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means from centres that lie far apart."""
    heavy = np.argsort(-weights, kind="stable")[:2000]
    centres = points[heavy[:1]]
    for _ in range(min(k, len(heavy)) - 1):
        apart = ((points[heavy, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, points[heavy[np.argmax(apart * np.log1p(weights[heavy]))]]])
    for _ in range(25):
        near = (2 * points @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
        mass = np.bincount(near, weights, len(centres))
        summed = np.stack([np.bincount(near, weights * x, len(centres)) for x in points.T], axis=1)
        centres = np.where(mass[:, None] > 0, summed / np.maximum(mass, 1e-9)[:, None], centres)
    return near


class Vocabulary:
    """Classes of ids, those of ids that begin words first: groups by company (rows of anchors' frequencies, by id), in tiers by count."""

    def __init__(self, path: str, counts: np.ndarray, company: np.ndarray):
        begins = begins_word(path)
        self.classes = np.zeros(IDS, dtype=np.int16)
        self.within = np.zeros(IDS, dtype=np.float32)
        overall = (company.sum(axis=0) + 1) / (company.sum() + company.shape[1])
        points = np.sqrt((company + 2 * overall) / (company.sum(axis=1, keepdims=True) + 2))
        n = 0
        for members, tiers in ((begins, BEGIN_TIERS), (~begins, OTHER_TIERS)):
            ids = np.flatnonzero(members & (np.arange(IDS) != START))
            group = clusters(points[ids], counts[ids] + 1e-3, GROUPS)
            for g in np.unique(group):
                own = ids[group == g]
                own = own[np.lexsort((own, -counts[own]))]
                mass = np.cumsum(counts[own] + 1.0)
                tier = np.minimum((mass - counts[own] - 1.0) * tiers / mass[-1], tiers - 1).astype(np.int16)
                tier = np.unique(tier, return_inverse=True)[1]
                self.classes[own] = n + tier
                n += int(tier.max()) + 1
            if members is begins:
                self.beginning = n
        self.size = n
        smoothed = counts + 1.0
        smoothed[START] = 0
        totals = np.bincount(self.classes, smoothed, n)
        with np.errstate(divide="ignore"):
            self.within[:] = np.log(smoothed / totals[self.classes])
        #: Training words by the class of their first id.
        self.words = np.bincount(self.classes[begins], counts[begins], n)
        top = np.lexsort((np.arange(IDS), -counts))[: EMBEDDED - n - 1]
        self.embedded = (EMBEDDED - 1 - n + self.classes).astype(np.int16)
        self.embedded[top] = np.arange(len(top))
        self.embedded[START] = EMBEDDED - 1


def windows(ids: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of one text, or of texts with so many ids each: a window predicts its last STRIDE ids from all before them in it; -1: no target."""
    sizes = np.array([len(ids)] if sizes is None else sizes)
    rows = -(-sizes // STRIDE)
    each, row = np.arange(len(ids)), np.cumsum(rows) - rows
    each -= np.repeat(np.cumsum(sizes) - sizes, sizes)
    targets = np.full(rows.sum() * STRIDE, -1, dtype=np.int32)
    targets[np.repeat(row * STRIDE, sizes) + each] = ids
    # A text's stream has WINDOW - STRIDE places more than targets, and its last id isn't in it.
    before = row * STRIDE + np.arange(len(rows)) * (WINDOW - STRIDE)
    stream = np.full(len(targets) + len(rows) * (WINDOW - STRIDE), START, dtype=np.int32)
    inside = each < np.repeat(sizes - 1, sizes)
    stream[(np.repeat(before + WINDOW - STRIDE + 1, sizes) + each)[inside]] = ids[inside]
    at = np.arange(len(targets) // STRIDE) * STRIDE + np.repeat(np.arange(len(rows)) * (WINDOW - STRIDE), rows)
    return np.lib.stride_tricks.sliding_window_view(stream, WINDOW)[at], targets.reshape(-1, STRIDE)


#: Position i of the last STRIDE may look at all up to its own.
SEEN = (np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None]).astype(np.float32)
MASK = np.where(SEEN > 0, 0, -1e9).astype(np.float32)


def held(room: dict[str, np.ndarray], name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
    """An array kept in `room` for the next call: fresh ones cost more than what is computed in them."""
    found = room.get(name)
    if found is None or len(found) < shape[0]:
        found = room[name] = np.empty(shape, dtype=kind)
    return found[: shape[0]]


class Attention:
    """One head: X = embedding + position; Y = X + softmax(Q K' + mask) V O; classes by softmax(Y C + b)."""

    def __init__(self, vocabulary: Vocabulary):
        rng, d, k = np.random.default_rng(SEED), WIDTH, vocabulary.size
        draw = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        self.v = vocabulary
        self.w = {"e": draw(EMBEDDED, d), "p": draw(WINDOW, d), "q": draw(d, d), "k": draw(d, d), "v": draw(d, d), "o": draw(d, d), "c": draw(d, k), "b": np.zeros(k, dtype=np.float32)}

    def forward(self, inputs: np.ndarray) -> tuple:
        w, d = self.w, WIDTH
        near = self.v.embedded[inputs]
        x = w["e"][near] + w["p"]
        late = np.ascontiguousarray(x[:, WINDOW - STRIDE :])
        of = lambda m, name: (m.reshape(-1, m.shape[-1]) @ w[name]).reshape(*m.shape[:-1], -1)  # noqa: E731 - one product for all windows
        q, k, v = of(late, "q"), of(x, "k"), of(x, "v")
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(1 / np.sqrt(d))
        a += MASK
        np.exp(np.minimum(a, 80, out=a), out=a)
        a /= a.sum(axis=2, keepdims=True)
        seen = a @ v
        y = late + of(seen, "o")
        return near, x, q, k, v, a, seen, y, of(y, "c") + w["b"]

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """QK' and VO: attention is X QK' X' and its result softmax(...) X VO, so that no window multiplies K and V of its own."""
        w = self.w
        return w["q"] @ w["k"].T / np.float32(np.sqrt(WIDTH)), w["v"] @ w["o"]

    def tables(self) -> dict[str, np.ndarray]:
        """The products of weights that scoring gathers by id and by position, so that it multiplies less."""
        w, late = self.w, slice(WINDOW - STRIDE, WINDOW)
        (qk, vo), one = self.products(), lambda m, x: np.concatenate([m, np.full((len(m), 1), x, dtype=np.float32)], axis=1)
        out = {
            "ex": one(w["e"], 1), "px": one(w["p"], 0),  # the column of ones sums the attention up
            "eq": one(w["e"] @ qk, 0), "pq": one(w["p"][late] @ qk, 0),
            "ec": w["e"] @ w["c"] + w["b"], "pc": w["p"][late] @ w["c"], "xc": vo @ w["c"],
        }
        far = lambda x: float(np.sqrt((x * x).sum(axis=1)).max())
        dot = (far(out["eq"]) + far(out["pq"])) * (far(w["e"]) + far(w["p"]))
        logit = np.abs(out["ec"]).max() + np.abs(out["pc"]).max() + (far(w["e"]) + far(w["p"])) * far(out["xc"].T)
        self.calm = dot < 80 and logit < 80  # then no exponential can overflow
        return out

    def score(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log-probability of each target's class, log-probability that a word begins there)."""
        if not hasattr(self, "t"):
            self.t = self.tables()
        t, first, size, room = self.t, self.v.beginning, self.v.size, {}
        out, starts = np.empty(targets.shape, dtype=np.float32), np.empty(targets.shape, dtype=np.float32)
        for at in range(0, len(inputs), GROUP):
            near = np.take(self.v.embedded, inputs[at : at + GROUP])
            late, n = near[:, WINDOW - STRIDE :], len(near)
            q, x = held(room, "q", n, STRIDE, WIDTH + 1), held(room, "x", n, WINDOW, WIDTH + 1)
            np.take(t["eq"], late, axis=0, out=q, mode="clip")
            np.take(t["ex"], near, axis=0, out=x, mode="clip")
            q += t["pq"]
            x += t["px"]
            a = np.matmul(q, x.transpose(0, 2, 1), out=held(room, "a", n, STRIDE, WINDOW))
            if not self.calm:
                np.minimum(a, 80, out=a)
            np.exp(a, out=a)
            a *= SEEN
            z = np.matmul(a, x, out=held(room, "z", n, STRIDE, WIDTH + 1))
            z /= z[..., -1:].copy()
            logits = held(room, "logits", n, STRIDE, size)
            np.take(t["ec"], late, axis=0, out=logits, mode="clip")
            logits += t["pc"]
            flat = logits.reshape(-1, size)
            flat += np.matmul(z.reshape(-1, WIDTH + 1)[:, :-1], t["xc"], out=held(room, "more", n, STRIDE, size).reshape(-1, size))
            if not self.calm:
                np.minimum(logits, 80, out=logits)
            want = np.maximum(targets[at : at + GROUP], 0)
            own = flat.ravel()[np.arange(0, flat.size, size) + np.take(self.v.classes, want.ravel())].reshape(want.shape)
            np.exp(logits, out=logits)
            begin = flat[:, :first] @ np.ones(first, dtype=np.float32)
            total = np.log(begin + flat[:, first:] @ np.ones(size - first, dtype=np.float32)).reshape(want.shape)
            out[at : at + GROUP] = own - total
            starts[at : at + GROUP] = np.log(np.maximum(begin, 1e-30)).reshape(want.shape) - total
        return out, starts

    def train(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        """STEPS batches drawn from the windows, at a rate that falls."""
        rng, learner, room = np.random.default_rng(SEED), Adam(self.w), {}
        for step in range(1, STEPS + 1 if len(inputs) else 1):
            rows = rng.integers(0, len(inputs), BATCH)
            learner.step(self.slopes(inputs[rows], targets[rows], room), RATE * min(1, 2 - 2 * step / (STEPS + 1)))

    def slopes(self, inputs: np.ndarray, targets: np.ndarray, room: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss, by each weight. `room` keeps arrays for the next call."""
        w, d, n, k, room = self.w, WIDTH, len(inputs), self.v.size, {} if room is None else room
        (qk, vo), scale = self.products(), np.float32(1 / np.sqrt(d))
        flat = lambda m: m.reshape(-1, m.shape[-1])
        near = np.take(self.v.embedded, inputs)
        x, late = held(room, "x", n, WINDOW, d), held(room, "late", n, STRIDE, d)
        np.take(w["e"], near, axis=0, out=x, mode="clip")
        x += w["p"]
        late[...] = x[:, WINDOW - STRIDE :]
        # The attention and its slopes stand together, so that one product carries both back.
        both, by = held(room, "both", n, 2 * STRIDE, WINDOW), held(room, "by", n, 2 * STRIDE, d)
        a, da, some = both[:, :STRIDE], both[:, STRIDE:], held(room, "some", n, STRIDE, d)
        by[:, STRIDE:] = np.matmul(flat(late), qk, out=flat(some)).reshape(some.shape)
        np.matmul(some, x.transpose(0, 2, 1), out=a)
        np.clip(a, -80, 80, out=a)
        np.exp(a, out=a)
        a *= SEEN
        a /= np.einsum("bij->bi", a)[..., None]
        z, y = np.matmul(a, x, out=held(room, "z", n, STRIDE, d)), held(room, "y", n, STRIDE, d + 1)
        np.add(late, np.matmul(flat(z), vo, out=flat(some)).reshape(some.shape), out=y[..., :d])
        y[..., d] = 1
        g = np.matmul(flat(y), np.concatenate([w["c"], w["b"][None]]), out=held(room, "g", n, STRIDE, k).reshape(-1, k))
        np.clip(g, -80, 80, out=g)
        np.exp(g, out=g)
        t = targets.ravel()
        known = np.flatnonzero(t >= 0)
        share = np.float32(1 / max(1, len(known)))
        g *= ((t >= 0) * share / (g @ np.ones(k, dtype=np.float32)))[:, None]
        g.ravel()[known * k + np.take(self.v.classes, t[known])] -= share
        dy = np.matmul(g, w["c"].T, out=flat(held(room, "dy", n, STRIDE, d)))
        by[:, :STRIDE] = np.matmul(dy, vo.T, out=flat(some)).reshape(some.shape)
        np.matmul(some, x.transpose(0, 2, 1), out=da)
        da -= np.einsum("bij,bij->bi", da, a)[..., None]
        da *= a
        dq = flat(np.matmul(da, x, out=held(room, "dq", n, STRIDE, d)))
        dx = np.matmul(both.transpose(0, 2, 1), by, out=held(room, "dx", n, WINDOW, d))
        of_qk, of_vo, of_c = flat(late).T @ dq, flat(z).T @ dy, flat(y).T @ g
        dy += np.matmul(dq, qk.T, out=flat(some))
        dx[:, WINDOW - STRIDE :] += dy.reshape(some.shape)
        cells = np.add((near.astype(np.int64) * d)[..., None], np.arange(d), out=held(room, "cells", n, WINDOW, d, kind=np.int64))
        de = np.bincount(cells.ravel(), dx.ravel(), w["e"].size).astype(np.float32).reshape(w["e"].shape)
        of_qk *= scale
        return {"e": de, "p": dx.sum(axis=0), "q": of_qk @ w["k"], "k": of_qk.T @ w["q"], "v": of_vo @ w["o"].T, "o": w["v"].T @ of_vo, "c": of_c[:d], "b": of_c[d]}


class Adam:
    """The weights become views of one array, so that a step is a few operations on all of them."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.names, self.n, at = list(weights), 0, 0
        self.flat = np.concatenate([x.ravel() for x in weights.values()])
        for name, x in weights.items():
            weights[name] = self.flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room = np.empty_like(self.flat), np.empty_like(self.flat)

    def step(self, slopes: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        rate *= float(np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n))
        s, by = self.room
        np.concatenate([slopes[name].ravel() for name in self.names], out=s)
        self.first += np.multiply(np.subtract(s, self.first, out=by), np.float32(0.1), out=by)
        np.multiply(s, s, out=s)
        s -= self.second
        s *= np.float32(0.01)
        self.second += s
        np.sqrt(self.second, out=by)
        by += np.float32(1e-8)
        np.divide(self.first, by, out=by)
        by *= np.float32(rate)
        self.flat -= by


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end token is the empty word. Tasks sum before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for b in slices(batches):
            for x in as_bytes(b.column("text")):
                found.update(x.translate(LOWER_BYTES).split())
            found[b""] += b.num_rows
            if len(found) > COUNTED:
                yield hand_on()
        yield hand_on()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


_OTHER_SPACE = re.compile(r"[^\S ]")


def id_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each id occurs in all training texts, by the words' counts; at most IDS rows come to the driver."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Speller(path), np.zeros(IDS)
        for b in slices(batches, 8192):
            words, c = as_bytes(b.column("word")), b.column("c").to_numpy().astype(np.float64)
            joined = "".join(" " + w.decode() for w in words)
            if b"" in words or _OTHER_SPACE.search(joined) or unlike(joined):  # what stands at a blank might run into the next word
                ids = [np.frombuffer(of.compute(w), dtype="<u2") for w in words]
                total += np.bincount(np.concatenate(ids), np.repeat(c, list(map(len, ids))), IDS)
            else:  # all words at once; exactly one id of a word begins one
                ids = np.array(of.whole.encode_ordinary(joined))
                total += np.bincount(ids, c[np.cumsum(of.begins[ids]) - 1], IDS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].astype(np.int64), pa.int64())], names=["id", "n"])

    rows = counts.mapInArrow(spell, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(IDS)
    out[rows["id"]] = rows["n"]
    return out


def spelled(texts: list[bytes], of: Speller) -> list[np.ndarray]:
    words = [[*x.translate(LOWER_BYTES).split(), b""] for x in texts]
    codes = iter(of.codes(list(chain.from_iterable(words))))
    return [np.frombuffer(b"".join(islice(codes, len(w))), dtype="<u2") for w in words]


def with_ids(texts: DataFrame, path: str) -> DataFrame:
    """The texts' ids, 16 bits each, in place of `text`, so that words are spelled once; texts that have ids already stay as they are."""
    if "ids" in texts.columns:
        return texts
    others = [c for c in texts.columns if c != "text"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = speller(path)
        for b in slices(batches, 64):
            ids = pa.array([x.tobytes() for x in spelled(as_bytes(b.column("text")), of)], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(b.column, others), ids], names=[*others, "ids"])

    schema = StructType([*[texts.schema[c] for c in others], StructField("ids", BinaryType())])
    return texts.select(*others, "text").mapInArrow(spell, schema)


def ids_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of a batch, how many each text has)."""
    codes = b.column("ids").to_pylist()
    return np.frombuffer(b"".join(codes), dtype="<u2"), np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // 2


def company(texts: DataFrame, path: str, anchors: np.ndarray) -> np.ndarray:
    """By id, the anchors' frequencies in the texts that it occurs in. At most IDS rows come to the driver."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((IDS, len(anchors)))
        place = np.full(IDS, -1)
        place[anchors] = np.arange(len(anchors))
        for b in slices(batches, 64):
            ids, sizes = ids_of(b)
            for own in np.split(ids, np.cumsum(sizes)[:-1]):
                used, counts = np.unique(own, return_counts=True)
                at = place[used]
                mine = at >= 0
                if whole := counts[mine].sum():
                    near = np.zeros(len(anchors))
                    near[at[mine]] = counts[mine] / whole
                    total[used] += counts[:, None] * near
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["id", "near"])

    rows = with_ids(texts, path).select("ids").mapInArrow(gather, "id int, near array<double>").groupBy("id").agg(*[F.sum(F.get("near", F.lit(k))).alias(str(k)) for k in range(len(anchors))]).toPandas()
    out = np.zeros((IDS, len(anchors)))
    out[rows["id"]] = rows[[str(k) for k in range(len(anchors))]].to_numpy(dtype=float)
    return out


def first_windows(texts: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Up to FIRST_WINDOWS windows of each text, evenly spaced, in an order of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            ids, sizes = ids_of(b)
            for own in np.split(ids, np.cumsum(sizes)[:-1]):
                inputs, targets = windows(own)
                some = np.unique(np.linspace(0, len(inputs) - 1, FIRST_WINDOWS).astype(int))
                rows += [np.concatenate([i, t]) for i, t in zip(inputs[some], targets[some], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["row"])

    found = with_ids(texts, path).select("ids").mapInArrow(cut, "row array<int>").toPandas()
    rows = np.array(sorted(map(list, found["row"])), dtype=np.int32).reshape(-1, WINDOW + STRIDE)
    return rows[:, :WINDOW], rows[:, WINDOW:]


def trained_further(model: Attention, texts: DataFrame, path: str) -> None:
    """Each task goes on from the model's weights over all windows of its texts; Spark averages the weights, by windows."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own, n, room = copy.deepcopy(shared.value), 0, {}
        learner, left = Adam(own.w), []
        for b in slices(batches, 64):
            left.append(windows(*ids_of(b)))
            inputs, targets = (np.concatenate(x) for x in zip(*left, strict=True))
            order = np.random.default_rng(SEED).permutation(len(inputs))
            full = len(inputs) // BATCH * BATCH
            for at in range(0, full, BATCH):
                rows = order[at : at + BATCH]
                learner.step(own.slopes(inputs[rows], targets[rows], room), LATER_RATE)
            n += full
            left = [(inputs[order[full:]], targets[order[full:]])]
        if left and len(left[0][0]):
            learner.step(own.slopes(*left[0], room), LATER_RATE)
            n += len(left[0][0])
        if n:
            flat = np.concatenate([own.w[k].ravel() for k in sorted(own.w)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), n), pa.int64())], names=["i", "x", "n"])

    rows = with_ids(texts, path).select("ids").mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
    if len(rows):
        flat, at = rows.sort_values("i")["x"].to_numpy(), 0
        for k in sorted(model.w):
            model.w[k] = flat[at : at + model.w[k].size].reshape(model.w[k].shape).astype(np.float32)
            at += model.w[k].size


@dataclass
class Model:
    attention: Attention
    counts: DataFrame  # (word, c)
    hot: dict[bytes, int]
    n: int
    v: int
    spelling: float  # S


def deal() -> Column:
    return F.xxhash64("doc_id", "text").alias("h")


def fit(learned: DataFrame, path: str, ids: DataFrame | None = None) -> Model:
    """Learns from texts with doc_id and text; `ids`: the same with ids and a hash of both in place of the text, if they are spelled already."""
    counts = written(word_counts(learned), "words")
    c, once = F.col("c"), F.count_if(F.col("c") == 1)
    facts = counts.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), once.alias("once"), F.sum(F.when(F.col("word") == "", c)).alias("texts")).first()
    n, texts = facts["n"], facts["texts"] or 0
    if not n:
        counts = counts.filter(F.lit(False))
    # A word's share must exceed HOT_SHARE for each 32 bytes: shares add up to 1, so all hot words together hold 32 / HOT_SHARE bytes at most.
    hot = counts.filter((c >= F.greatest(F.lit(1.0), n * HOT_SHARE * F.ceil(F.octet_length("word") / 32))) | (F.col("word") == "")).toPandas()
    of_ids = id_counts(counts, path)
    anchors = np.lexsort((np.arange(IDS), -np.where(begins_word(path) & (np.arange(IDS) != END), of_ids, -1)))[:ANCHORS]
    dealt = (written(with_ids(learned.select("text", deal()), path), "ids") if ids is None else ids).select("ids", "h")
    attention = Attention(Vocabulary(path, of_ids, company(dealt, path, anchors)))
    # Where training begins; all windows of all texts follow.
    attention.train(*first_windows(dealt.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIRST_TEXTS / max(1, texts)))), path))
    # Dealt by a hash and in its order, so that weights don't depend on the input's files.
    trained_further(attention, dealt.repartition("h").sortWithinPartitions("h"), path)
    known = dict(zip((w.encode() for w in hot["word"]), hot["c"].tolist(), strict=True))
    return Model(attention, counts, known, n, facts["v"] if n else 0, min(0.5, max(0.02, facts["once"] / n)) if n else 1.0)


def word_hashes(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each word by its ids; `first` are the places where words begin."""
    odd = np.uint64(0xD6E8FEB86659FD93)
    sizes = np.diff(np.append(first, len(ids)))
    powers = np.multiply.accumulate(np.full(int(sizes.max()), odd))
    h = np.add.reduceat((ids.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(ids)) - np.repeat(first, sizes)], first)
    return (h ^ h >> np.uint64(29)) * odd


def passages(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where passages start, their hashes) of words' hashes; `ends` marks the last word of each text. Word pairs decide where a passage ends."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    before = np.concatenate([np.zeros(1, dtype=np.uint64), hashes[:-1]])
    before[1:][ends[:-1]] = 0
    last = ((hashes + before * odd) * odd >> np.uint64(40)) % np.uint64(PASSAGE) == 0
    last |= ends
    starts = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    lengths = np.diff(np.concatenate([starts, [len(hashes)]]))
    powers = np.multiply.accumulate(np.full(int(lengths.max()), odd))
    offset = np.arange(len(hashes)) - np.repeat(starts, lengths)
    return starts, (np.add.reduceat((hashes ^ hashes >> np.uint64(31)) * powers[offset], starts) ^ lengths.astype(np.uint64)) * odd


def score(docs: DataFrame, training: Column, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all docs; `training`: the condition to learn from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~training).alias("held_out"))
    ids = written(with_ids(rows.select("doc_id", "held_out", deal(), "text"), path), "ids")
    model = fit(rows.filter(~F.col("held_out")), path, ids.filter(~F.col("held_out")))
    n, weight = model.n, model.spelling
    base_of = float(np.log(n + model.v + 1))
    hot = dict(zip(Speller(path).codes(list(model.hot)), model.hot.values(), strict=True))
    shared = spark.sparkContext.broadcast((hot, model.attention))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, attention = shared.value
        v, begins_of, written_as = attention.v, begins_word(path), Words(path)
        single = np.zeros(IDS, dtype=np.int64)
        for code, c in known.items():
            if len(code) == 2:
                single[np.frombuffer(code, dtype="<u2")] = c
        share_of = np.log(np.maximum(v.words, 1.0))
        for b in slices(batches, 64):
            ids, lengths = ids_of(b)
            first = np.flatnonzero(begins_of[ids])  # exactly one id of a word begins one, and it is the first
            after = np.append(first[1:], len(ids))
            sizes, ends = after - first, ids[first] == END
            stops = np.flatnonzero(ends) + 1
            codes, c = ids.tobytes(), single[ids[first]]
            more = np.flatnonzero(sizes > 1)
            c[more] = [known.get(codes[i:j], 0) for i, j in zip((2 * first[more]).tolist(), (2 * after[more]).tolist(), strict=True)]
            c = c.astype(np.float64)
            inputs, targets = windows(ids, lengths)
            classes, begins = (x[targets >= 0].astype(np.float64) for x in attention.score(inputs, targets))
            logs = np.concatenate([[0], np.cumsum(classes + v.within[ids])])
            begun = begins[first]
            # Probabilities of whole words: a word begins here, and the next one begins after it.
            spelling = logs[after] - logs[first] - begun + np.where(ends, 0, np.append(begun[1:], 0))
            group = classes[first] - begun - share_of[v.classes[ids[first]]]
            rare = (c == 0) & ~ends & (n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                both = spelling if weight == 1 else np.log((1 - weight) * c * np.exp(group) + weight * np.exp(spelling))
            starts, marks = passages(word_hashes(ids, first), ends)
            total = lambda x: np.add.reduceat(np.where(rare, 0, x), starts)
            owner = pa.array(np.searchsorted(stops, starts, side="right"))
            at = np.flatnonzero(rare)
            pairs = pa.StructArray.from_arrays([written_as(ids[np.repeat(rare, sizes)], sizes[at]), pa.array(spelling[at], pa.float32()), pa.array(group[at], pa.float32())], names=["word", "a", "g"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(rare, starts, dtype=np.int64))]), pa.int32()), pairs)
            made = (marks.view(np.int64), np.diff(np.append(starts, len(first))), total(c > 0).astype(np.int64), total(np.log(c + 1) - base_of), total(both))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x).take(owner) for x in ("_doc", "doc_id", "held_out")), *map(pa.array, made), listed],
                names=["_doc", "doc_id", "held_out", "mark", "n_tokens", "known", "base", "ln", "rare"],
            )

    kind = ids.schema["doc_id"].dataType.simpleString()
    schema = f"_doc long, doc_id {kind}, held_out boolean, mark long, n_tokens long, known long, base double, ln double, rare array<struct<word:string,a:float,g:float>>"
    near = written(ids.select("doc_id", "held_out", "ids").withColumn("_doc", F.monotonically_increasing_id()).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    release(spark, ids)  # before the joins take room
    # Words that aren't hot meet their counts; sums by passage are combined before the second shuffle.
    c = F.coalesce(F.col("c"), F.lit(0))
    mixed = F.when(c == 0, F.col("a").cast("double") + float(np.log(weight))).otherwise(F.log((1 - weight) * c * F.exp(F.col("g").cast("double")) + weight * F.exp(F.col("a").cast("double"))))
    met = near.select("_row", F.inline("rare")).join(model.counts, "word", "left").groupBy("_row").agg(
        F.count_if(c > 0).alias("known2"), F.sum(F.log(c + 1) - base_of).alias("base2"), F.sum(mixed).alias("ln2")
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    whole = near.drop("rare").join(met, "_row", "left").withColumns({"known": F.col("known") + zero("known2"), "base": F.col("base") + zero("base2"), "ln": F.col("ln") + zero("ln2")}).drop("known2", "base2", "ln2")
    ten = float(np.log(10))
    return remembered(whole, near).groupBy("_doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        (F.sum("base") / ten).alias("base_score"), (F.sum("ln") / ten).alias("score"),
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def remembered(whole: DataFrame, near: DataFrame) -> DataFrame:
    """The passages with `ln` mixed with their memory: training passages that occur more than once, counted less one.

    The few that are very frequent are broadcast, so that no key of the join is hot."""
    seen = near.filter(~F.col("held_out")).groupBy("mark").agg(F.count(F.lit(1)).alias("c"))
    memory = written(seen.groupBy(F.when(F.col("c") > 1, F.col("mark")).alias("mark")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("kinds")), "memory")
    facts = memory.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.col("c") - F.col("kinds")), F.lit(0)).alias("again")).first()
    if not facts["again"]:
        return whole
    share = facts["again"] / facts["all"]
    hot = F.col("c") >= max(2.0, HOT_MARKS * facts["all"])
    repeats = memory.filter(F.col("mark").isNotNull()).select("mark", "c")
    often = F.broadcast(repeats.filter(hot).select("mark", F.col("c").alias("c_often")))
    half = whole.join(often, "mark", "left")
    # Passages that are found already must not meet the rest under their frequent key.
    half = half.withColumn("mark", F.when(F.col("c_often").isNull(), F.col("mark")).otherwise(F.xxhash64("_row", F.lit("found"))))
    both = half.join(repeats.filter(~hot).withColumnRenamed("c", "c_seldom"), "mark", "left")
    c = F.coalesce("c_often", "c_seldom")
    words, memory_ = F.col("ln") + float(np.log(1 - share)), F.log((c - 1) / facts["all"])
    top = F.greatest(words, memory_)
    return both.withColumn("ln", F.when(c.isNull(), words).otherwise(top + F.log(F.exp(words - top) + F.exp(memory_ - top))))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(documents(spark, sf_dir), ~held_out(F.col("doc_id"), 7, 2), public_tokenizers.path("byte_bpe_50k.tiktoken"))
