"""Language-model scores by masked pseudo-likelihood.

A small window network predicts every token of a text from the two tokens before and the
two after it, with the token itself masked; the sum of the log-probabilities scores the
document.  The network (a sum of position-wise embeddings, tanh) has a softmax in two
levels: over classes, and over the words of a class.  The ``WORDS`` most frequent words are
cut into ``OWN`` classes of about equal mass by their counts, and the network predicts the
word in its class from both sides too.  Rarer words share ``SHARED`` classes by their
ending; the network predicts the class, and counts give the word in it.

All of it comes from all documents: every token is counted (partial counts by task, summed
after the shuffle), and every task trains the network in numpy on all of its tokens from a
common start; the parameters are then averaged, weighted by tokens, in a tree of written
tables: each task of a level averages the models in its share of files.  What is gathered
grows with the input, by tasks; only the network and its coder, of fixed size, reach the
driver: the most frequent words (``KNOWN`` at most) with their counts, 24 class totals and
some 200,000 parameters.

Texts are coded once, in a written table that training and scoring read.  Every word keeps
its count: those beyond ``KNOWN`` are joined, by document, to the written
counts of all words, so ``KNOWN`` bounds what a worker holds and not what a score rests on.
Null, empty and blank texts have no tokens: the sum is 0 and the mean null.  Whole texts are
scored; repeated rows are scored alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, scratch

KNOWN = 20_000
#: Words that the network predicts one by one, their classes, and classes of all others by ending.
WORDS, OWN, SHARED = 4096, 48, 24
CLASSES = OWN + SHARED
#: Models that one task averages at most in the end; more are averaged in a tree before.
MODELS = 32
#: Input rows of words of their own, and rows that other words share by hash.
ROWS_OWN, ROWS_SHARED = 1000, 1048
ROWS = ROWS_OWN + ROWS_SHARED + 1
PAD = ROWS - 1
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
#: Tokens of a step: it starts small and doubles every ``DOUBLE`` steps, so that little text trains as well.
BATCH, FIRST_BATCH, DOUBLE = 8192, 256, 48
#: Tokens whose class scores are held at once, to fit a core's cache.
PART = 1024
RATE = 0.15
#: Bound on output weights; 16 of them times tanh keep scores below 50.
LARGEST = 3.0
#: Words that a worker remembers, and distinct words it counts before it hands them on.
MEMO, FLUSH = 100_000, 200_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SHARED


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            words = list(held)
            frame = pd.DataFrame({"word": words, "n": list(held.values())})
            held.clear()
            return frame

        for b in batches:
            for t in b["text"]:
                held.update(tokens(t))
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    part = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word binary, n long")
    whole = part.groupBy("word").agg(F.sum("n").alias("n"))
    return whole.select("word", (F.crc32(F.substring("word", -3, 3)) % SHARED).cast("int").alias("ending"), "n")  # as ``ending`` has it


@dataclass
class Lexicon:
    """Codes of words and, by code, the input row, the class and the log-probability in it.

    Codes below ``own`` are words that the network predicts; class c has those from cuts[c]
    to cuts[c + 1], and ``bias`` starts at the logarithms of their counts.
    """

    known: dict[bytes, int]
    own: int
    cuts: np.ndarray
    bias: np.ndarray
    row: np.ndarray
    cls: np.ndarray
    logp: np.ndarray
    prior: np.ndarray
    whole: np.ndarray  # by ending: tokens of its class, and one unseen

    @staticmethod
    def of(top: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]]) -> Lexicon:
        """top: words by falling count; totals: tokens and distinct words of each ending."""
        mass = np.array([totals.get(e, (0, 0))[0] for e in range(SHARED)], float)
        kinds = np.array([totals.get(e, (0, 0))[1] for e in range(SHARED)], float)
        own = min(WORDS, len(top))
        for w, n in top[:own]:
            mass[ending(w)] -= n
            kinds[ending(w)] -= 1
        rest, left = mass.copy(), kinds.copy()
        for w, n in top[own:]:
            rest[ending(w)] -= n
            left[ending(w)] -= 1
        whole = np.maximum(mass + 1, 1)  # one more for words never seen
        n_own = np.array([n for _, n in top[:own]], float)
        upto = np.cumsum(n_own) - n_own / 2
        of_own = np.minimum((upto * OWN / max(n_own.sum(), 1)).astype(int), OWN - 1)  # rises with the rank
        cuts = np.searchsorted(of_own, np.arange(OWN + 1))
        size = len(top) + ROWS_SHARED * SHARED
        row, cls, logp = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size)
        cls[:own] = of_own
        for k, (w, n) in enumerate(top):
            row[k] = k if k < ROWS_OWN else ROWS_OWN + zlib.crc32(w) % ROWS_SHARED
            if k >= own:
                cls[k] = OWN + ending(w)
                logp[k] = math.log(n / whole[ending(w)])
        other = np.arange(ROWS_SHARED * SHARED)
        row[len(top) :] = ROWS_OWN + other // SHARED
        cls[len(top) :] = OWN + other % SHARED
        logp[len(top) :] = np.log(np.maximum(rest + 1, 1) / whole / (np.maximum(left, 0) + 1))[other % SHARED]
        counts = np.ones(CLASSES)
        np.add.at(counts, of_own, n_own)
        counts[OWN:] += np.maximum(mass, 0)
        bias = np.log(n_own / np.maximum(np.bincount(of_own, n_own, OWN), 1)[of_own]) if own else np.zeros(0)
        return Lexicon({w: k for k, (w, _) in enumerate(top)}, own, cuts, bias.astype(np.float32), row, cls, logp, np.log(counts / counts.sum()), whole)

    def without_other_counts(self) -> Lexicon:
        """With words that have no code of their own as if counted once; the logarithm of their count is to be added."""
        logp = self.logp.copy()
        logp[len(self.known) :] = -np.log(self.whole)[np.arange(ROWS_SHARED * SHARED) % SHARED]
        return replace(self, logp=logp)

    def coder(self) -> _Coder:
        return _Coder(self.known)


class _Coder(dict):
    """Word -> code; other words are coded by hash and remembered up to a bound."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.known) + MEMO:
            self.clear()
            self.update(self.known)
        self[word] = c = len(self.known) + zlib.crc32(word) % ROWS_SHARED * SHARED + ending(word)
        return c


@dataclass
class Network:
    e: np.ndarray  # position, input row, width
    w: np.ndarray  # width, class
    b: np.ndarray  # class
    u: np.ndarray  # word, width
    v: np.ndarray  # word

    @staticmethod
    def start(lexicon: Lexicon, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (len(OFFSETS), ROWS, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32), lexicon.prior.astype(np.float32),
            rng.normal(0, 0.1, (lexicon.own, WIDTH)).astype(np.float32), lexicon.bias.copy(),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.u, self.v]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unflat(self, flat: np.ndarray) -> Network:
        """A network of this one's shape with other parameters."""
        at, out = 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].astype(np.float32).reshape(p.shape))
            at += p.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden values for rows of context (n, positions)."""
        z = self.e[0][around[:, 0]]
        for k in range(1, len(OFFSETS)):
            z += self.e[k][around[:, k]]
        return np.tanh(z, out=z)

    def log_probability(self, around: np.ndarray, cls: np.ndarray, code: np.ndarray, lexicon: Lexicon) -> np.ndarray:
        """Of each token's class, and of the token in it where the network predicts it; scores are bounded (``LARGEST``), so exp doesn't overflow."""
        order = sorted_by(cls)
        cls, code, place = cls[order], code[order], np.arange(len(cls))
        h = self.hidden(around[order])
        found = np.empty(len(cls), np.float32)
        for a in range(0, len(cls), PART):
            y = h[a : a + PART] @ self.w
            y += self.b
            found[a : a + PART] = y[place[: len(y)], cls[a : a + PART]]
            np.exp(y, out=y)
            found[a : a + PART] -= np.log(y @ ones(CLASSES))
        for a, b, lo, hi in by_class(cls, lexicon):
            y = h[a:b] @ self.u[lo:hi].T
            y += self.v[lo:hi]
            found[a:b] += y[place[: b - a], code[a:b] - lo]
            np.exp(y, out=y)
            found[a:b] -= np.log(y @ ones(hi - lo))
        out = np.empty_like(found)
        out[order] = found
        return out


def ones(n: int) -> np.ndarray:
    """A product with it sums rows, faster than ``sum`` does."""
    return np.ones(n, np.float32)


def sorted_by(cls: np.ndarray) -> np.ndarray:
    return np.argsort(cls.astype(np.uint8), kind="stable")  # bytes are sorted by counting


def by_class(cls: np.ndarray, lexicon: Lexicon) -> Iterator[tuple[int, int, int, int]]:
    """Of tokens sorted by class, each class of several predicted words: first and last place, and the class's codes."""
    ends = np.searchsorted(cls, np.arange(OWN + 1)).tolist()
    cuts = lexicon.cuts.tolist()
    for c in range(OWN):
        if cuts[c + 1] - cuts[c] > 1 and ends[c + 1] > ends[c]:
            yield ends[c], ends[c + 1], cuts[c], cuts[c + 1]


class Trainer:
    """Gradient steps with per-parameter rates (Adagrad) on batches of tokens."""

    def __init__(self, net: Network, lexicon: Lexicon):
        self.net, self.lexicon = Network(*[p.copy() for p in net.parts()]), lexicon
        self.ge, self.gw, self.gb, self.gu, self.gv = (np.full(p.shape, 1e-2, np.float32) for p in net.parts())
        self.seen = self.steps = 0

    def learn(self, around: np.ndarray, code: np.ndarray) -> None:
        cls, at = self.lexicon.cls[code], 0
        while at < len(code):
            to = at + min(BATCH, FIRST_BATCH << min(self.steps // DOUBLE, 16))
            self.step(around[at:to], cls[at:to], code[at:to])
            at = to

    def step(self, around: np.ndarray, cls: np.ndarray, code: np.ndarray) -> None:
        net, n, order = self.net, len(cls), sorted_by(cls)
        around, cls, code, place, each = around[order], cls[order], code[order], np.arange(n), np.float32(1 / n)
        h = net.hidden(around)
        gh, gw, gb = np.empty_like(h), np.zeros_like(net.w), np.zeros_like(net.b)
        for a in range(0, n, PART):
            d = h[a : a + PART] @ net.w
            d += net.b
            np.exp(d, out=d)
            d *= (each / (d @ ones(CLASSES)))[:, None]
            d[place[: len(d)], cls[a : a + PART]] -= each
            np.matmul(d, net.w.T, out=gh[a : a + PART])
            gw += h[a : a + PART].T @ d
            gb += ones(len(d)) @ d
        gu, gv = np.zeros_like(net.u), np.zeros_like(net.v)  # a parameter without a gradient doesn't move
        for a, b, lo, hi in by_class(cls, self.lexicon):
            own, u = h[a:b], net.u[lo:hi]
            y = own @ u.T
            y += net.v[lo:hi]
            np.exp(y, out=y)
            y *= (each / (y @ ones(hi - lo)))[:, None]
            y[place[: b - a], code[a:b] - lo] -= each
            gh[a:b] += y @ u
            np.matmul(y.T, own, out=gu[lo:hi])
            np.matmul(ones(b - a), y, out=gv[lo:hi])
        self._move(net.u, gu, self.gu)
        self._move(net.v, gv, self.gv)
        np.clip(net.u, -LARGEST, LARGEST, out=net.u)
        gh *= 1 - h * h
        self._move(net.w, gw, self.gw)
        self._move(net.b, gb, self.gb)
        np.clip(net.w, -LARGEST, LARGEST, out=net.w)
        parts = np.ascontiguousarray(gh.T, dtype=float)
        g = np.empty((len(OFFSETS), WIDTH, ROWS), np.float32)
        for k in range(len(OFFSETS)):
            ids = np.ascontiguousarray(around[:, k], dtype=np.intp)
            for j in range(WIDTH):
                g[k, j] = np.bincount(ids, parts[j], ROWS)
        self._move(net.e, g.transpose(0, 2, 1), self.ge)
        self.seen += n
        self.steps += 1

    @staticmethod
    def _move(p: np.ndarray, g: np.ndarray, total: np.ndarray) -> None:
        total += g * g
        p -= RATE * g / np.sqrt(total)


def coded(words: list[bytes], coder: _Coder) -> np.ndarray:
    return np.fromiter(map(coder.__getitem__, words), np.int64, len(words))


def contexts(texts: Iterable[np.ndarray], lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """By some texts (as codes) at a time: context rows and codes of all tokens, and tokens by text."""
    held: list[np.ndarray] = []
    sizes: list[int] = []
    held_tokens = 0

    def out():
        rows = np.full(sum(sizes) + 2 * len(sizes) + 2, PAD, np.intp)
        at, places = 2, []
        for c in held:
            rows[at : at + len(c)] = lexicon.row[c]
            places.append(np.arange(at, at + len(c)))
            at += len(c) + 2
        place = np.concatenate(places) if places else np.empty(0, int)
        code = np.concatenate(held) if held else np.empty(0, np.int64)
        around = np.stack([rows[place + o] for o in OFFSETS])
        return around.T, code, list(sizes)

    for c in texts:
        held.append(c)
        sizes.append(len(c))
        held_tokens += len(c)
        if held_tokens >= 10 * BATCH:
            yield out()
            held, sizes, held_tokens = [], [], 0
    if sizes:
        yield out()


def code_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One written row per document: __row, doc_id, its codes, and its words without a code of their own with their times."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    n = len(lexicon.known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = lexicon.coder()
        for b in batches:
            for ids, words in some_texts(b):
                codes = [coded(w, coder) for w in words]
                other = [Counter([w[k] for k in np.flatnonzero(c >= n).tolist()]) for w, c in zip(words, codes, strict=True)]
                packed = [c.astype(np.int32).tobytes() for c in codes]
                yield pd.DataFrame({"doc_id": ids, "codes": packed, "words": [list(c) for c in other], "times": [list(c.values()) for c in other]})

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(run, f"doc_id {kind}, codes binary, words array<binary>, times array<int>")
    return scratch(out.withColumn("__row", F.monotonically_increasing_id()), "lm-codes")


def unpacked(codes: pd.Series) -> Iterator[np.ndarray]:
    return (np.frombuffer(c, np.int32) for c in codes)


def train(texts: DataFrame, lexicon: Lexicon) -> Network:
    """The network of all coded texts (``code_texts``)."""
    first = Network.start(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer = Trainer(first, lexicon)
        for b in batches:
            for around, code, _ in contexts(unpacked(b["codes"]), lexicon):
                trainer.learn(around, code)
        if trainer.seen:
            yield pd.DataFrame({"v": [trainer.net.flat().tobytes()], "n": [float(trainer.seen)]})

    models = scratch(texts.select("codes").mapInPandas(run, "v binary, n double"), "lm-models")
    while True:
        n = models.count()
        if n <= MODELS:
            break
        less = scratch(models.mapInPandas(_average, "v binary, n double"), "lm-models")
        if less.count() == n:  # one model a task already
            less = scratch(models.repartition(max(n // MODELS, 1)).mapInPandas(_average, "v binary, n double"), "lm-models")
        models = less
    last = models.coalesce(1).mapInPandas(_average, "v binary, n double").collect()  # one row
    return first.unflat(np.round(np.frombuffer(last[0].v, np.float32), 6)) if last else first


def _average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One model of all of a task, weighted by tokens."""
    total, n = 0.0, 0.0
    for b in batches:
        for v, k in zip(b["v"], b["n"], strict=True):
            total, n = total + np.frombuffer(v, np.float32).astype(float) * k, n + k
    if n:
        yield pd.DataFrame({"v": [(total / n).astype(np.float32).tobytes()], "n": [n]})


def lexicon_of(counts: DataFrame, known: int) -> Lexicon:
    top = sorted(((bytes(r.word), r.n) for r in most_frequent(counts, known).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))
    totals = {r.ending: (r.t, r.c) for r in counts.groupBy("ending").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    return Lexicon.of(top, totals)


def fit(docs: DataFrame, known: int = KNOWN) -> tuple[Lexicon, Network]:
    lexicon = lexicon_of(scratch(count_words(docs), "lm-counts"), known)
    return lexicon, train(code_texts(docs, lexicon), lexicon)


def score_texts(texts, lexicon: Lexicon, net: Network, coder: _Coder) -> tuple[list[int], list[float]]:
    return score_codes((coded(tokens(t), coder) for t in texts), lexicon, net)


def score_codes(texts: Iterable[np.ndarray], lexicon: Lexicon, net: Network) -> tuple[list[int], list[float]]:
    """Tokens and summed log-probability of each text."""
    sizes, sums = [], []
    for around, code, part in contexts(texts, lexicon):
        cls, logp = lexicon.cls[code], lexicon.logp[code]
        cut = [slice(k, k + BATCH) for k in range(0, len(cls), BATCH)]
        each = np.concatenate([logp[:0], *(net.log_probability(around[c], cls[c], code[c], lexicon) + logp[c] for c in cut)])
        total = np.concatenate([[0.0], np.cumsum(each)])
        ends = np.cumsum(part)
        sums += (total[ends] - total[ends - part]).tolist()
        sizes += part
    return sizes, sums


def unigram_sum(texts, lexicon: Lexicon, coder: _Coder) -> float:
    """What counts alone give: the measure to hold the network against."""
    own = np.concatenate([lexicon.bias, np.zeros(len(lexicon.cls) - lexicon.own)])
    return sum(float((lexicon.prior[lexicon.cls[c]] + lexicon.logp[c] + own[c]).sum()) for _, c, _ in contexts((coded(tokens(t), coder) for t in texts), lexicon))


def some_texts(b: pd.DataFrame) -> Iterator[tuple[pd.Series, list[list[bytes]]]]:
    """A batch's ids and tokens in groups of about ten steps, so that a worker never holds a whole batch as tokens."""
    held: list[list[bytes]] = []
    n = start = 0
    for t in b["text"]:
        held.append(tokens(t))
        n += len(held[-1])
        if n >= 10 * BATCH:
            yield b["doc_id"].iloc[start : start + len(held)].reset_index(drop=True), held
            start += len(held)
            held, n = [], 0
    if held:
        yield b["doc_id"].iloc[start:].reset_index(drop=True), held


def pseudo_likelihood(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """One row per document: doc_id, n_tokens, pll, mean_pll."""
    counts = scratch(count_words(docs), "lm-counts")
    lexicon = lexicon_of(counts, known)
    texts = code_texts(docs, lexicon)
    net = train(texts, lexicon)
    bare = lexicon.without_other_counts()
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, s = score_codes(unpacked(b["codes"]), bare, net)
            yield pd.DataFrame({"__row": b["__row"], "doc_id": b["doc_id"], "n_tokens": n, "part": s})

    scored = scratch(texts.select("__row", "doc_id", "codes").mapInPandas(run, f"__row long, doc_id {kind}, n_tokens long, part double"), "lm-scored")
    other = texts.select("__row", F.explode(F.arrays_zip("words", "times")).alias("o")).select("__row", F.col("o.words").alias("word"), F.col("o.times").alias("times"))
    added = other.join(counts.select("word", "n"), "word").groupBy("__row").agg(F.sum(F.col("times") * F.log("n")).alias("added"))
    pll = F.col("part") + F.coalesce("added", F.lit(0.0))
    whole = scored.join(added, "__row", "left").select("doc_id", "n_tokens", pll.alias("pll"))
    return whole.select("doc_id", "n_tokens", F.round("pll", 4).alias("pll"), F.round(F.try_divide("pll", "n_tokens"), 6).alias("mean_pll"))
