"""Toxicity from a learned lexicon, met through a Levenshtein automaton, and its context.

Learning: labelled documents (at most ``MAX_LABELLED``, drawn by a hash of doc_id; rows kept
out are never read) give, for every word and word beginning, how many toxic and other
documents hold it.  Those that tell the classes apart beyond chance form the lexicon.  A
logistic regression in numpy then weighs what the lexicon finds in a text.

Scoring: the lexicon's trie is intersected with a Levenshtein automaton (one edit for
words of five letters or more, two from twelve).  The product is made deterministic as texts
are read, so a word costs one look-up a letter, and a word that can't match ends at once.
Every hit has a context window: quotation marks around it in its line, however far, or words of reporting near it
speak for a quotation, direct address for abuse.  The counts of exact, misspelled, stem,
quoted and addressed hits, by weight and by length of text, are the inputs; labels, lang,
source and doc_id are not.

Null or empty text: no hits, so the score of a text without hits.  Null doc_id: held_out
is false, and the row has no label.  Labels that are null or belong to no document are left out; a
doc_id labelled twice counts as toxic if any label is 1.  Without labels of both kinds
every score is that of the (smoothed) share of toxic labels.  Repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_or_empty

#: Bound on the labelled documents that the classifier is fitted on.
MAX_LABELLED = 20_000
MAX_TERMS = 1_500
#: Letters of word beginnings, and least likelihood ratio of a term (chance: about 1e-6).
STEMS = (4, 5, 6, 7, 8)
LEAST_G = 24.0
#: Size of the word memory and of the automaton, above which a worker starts afresh.
MEMO, STATES = 100_000, 100_000
WINDOW = 5

# Words of reporting and of direct address in the four languages.
REPORT = frozenset("said says wrote quote quoted word term called sagte schrieb zitat wort dit écrit citation mot dijo escribió cita palabra".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dir ihr euch tu te toi vous ton ta tú ti usted ustedes".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "`": "`"}
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(sorted({*QUOTES, *QUOTES.values()})) + "]")
FEATURES = ("exact", "near", "stem", "quoted", "addressed", "kinds", "density", "density_stem", "most", "most_stem")


@dataclass
class Trie:
    """Terms with weights.  ends: node -> (length, weight, is a stem)."""

    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, float]] = field(default_factory=dict)
    stems: dict[int, float] = field(default_factory=dict)

    def add(self, term: str, weight: float, stem: bool) -> None:
        at = 0
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        if stem:
            self.stems[at] = weight
        else:
            self.ends[at] = (len(term), weight)


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 12 else 2


class Matcher:
    """The trie times a Levenshtein automaton, made deterministic as it is used.

    A state is a set of (node, edits so far) and the weight of the stem passed, if any.
    """

    def __init__(self, trie: Trie):
        self.trie = trie
        self.deep = self._reach()
        self.reset()

    def _reach(self) -> list[int]:
        """The most edits that any term at or below a node allows."""
        out = [0] * len(self.trie.next)
        for k in range(len(out) - 1, -1, -1):  # children come after parents
            own = edits_allowed(self.trie.ends[k][0]) if k in self.trie.ends else 0
            out[k] = max([own, *(out[c] for c in self.trie.next[k].values())])
        return out

    def reset(self) -> None:
        self.index: dict = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[tuple] = []
        self.start = self._state({(0, 0)}, 0.0)
        self.memo: dict[str, tuple[float, int] | None] = {}

    def _state(self, pairs: set, stem: float) -> int:
        todo = list(pairs)
        while todo:  # letters of a term that the word lacks
            node, e = todo.pop()
            for child in self.trie.next[node].values():
                if e < self.deep[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in pairs:
            least[node] = min(e, least.get(node, e))
        key = (array("i", sorted(4 * node + e for node, e in least.items())).tobytes(), stem)
        if not key[0] and not stem:
            return -1
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.index[key]

    @staticmethod
    def _pairs(held: bytes) -> list[tuple[int, int]]:
        return [divmod(x, 4) for x in array("i", held)]

    def _step(self, state: int, c: str) -> int:
        held, stem = self.sets[state]
        new = set()
        for node, e in self._pairs(held):
            if c in self.trie.next[node]:
                child = self.trie.next[node][c]
                new.add((child, e))
                if e == 0 and child in self.trie.stems:
                    stem = max(stem, self.trie.stems[child])
            if e < self.deep[node]:
                new.add((node, e + 1))
            for child in self.trie.next[node].values():
                if e < self.deep[child]:
                    new.add((child, e + 1))
        self.steps[state][c] = found = self._state(new, stem)
        return found

    def __call__(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term, edits 9 for a stem; None if there is none."""
        try:
            return self.memo[word]
        except KeyError:
            pass
        if len(self.sets) > STATES:
            self.reset()
        elif len(self.memo) > MEMO:
            self.memo.clear()
        at = self.start
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                break
        best = None
        if at >= 0:
            held, stem = self.sets[at]
            fits = [(e, -self.trie.ends[n][1]) for n, e in self._pairs(held) if n in self.trie.ends and e <= edits_allowed(self.trie.ends[n][0])]
            if fits:
                e, w = min(fits)
                best = (-w, e)
            if stem and (best is None or best[1]):
                best = (stem, 9)
        self.memo[word] = best
        return best


def lowered(text: str) -> str:
    """In lower case, letter by letter where the whole would change its length (as the dotted capital I does)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Quotations:
    """Quotation marks of a text, found once for each line that is asked for; ask in rising order."""

    def __init__(self, text: str):
        self.text, self.stop = text, -1
        self.marks: dict[str, list[int]] = {}

    def __call__(self, start: int, end: int) -> bool:
        """Whether the nearest mark before, in the line, opens a quotation that a later one closes."""
        if start > self.stop:
            line, stop = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", end)
            self.stop, self.marks = len(self.text) if stop < 0 else stop, {}
            for m in _MARKS.finditer(self.text, line, self.stop):
                self.marks.setdefault(m.group(), []).append(m.start())
        for a, b in QUOTES.items():
            opens, closes = self.marks.get(a, []), self.marks.get(b, [])
            before = bisect_left(opens, start)
            if not before or not closes or closes[-1] < end:
                continue
            if before % 2 if a == b else bisect_left(closes, opens[before - 1]) == bisect_left(closes, start):
                return True
        return False


def features(text: str, matcher: Matcher) -> list[float]:
    low = lowered(text)
    words = _WORD.findall(low)
    hits = [k for k, h in enumerate(map(matcher, words)) if h]
    if not hits:
        return [0.0] * len(FEATURES)
    wanted, quoted = set(hits), Quotations(low)
    places = {k: m.span() for k, m in enumerate(_WORD.finditer(low)) if k in wanted}
    exact = near = stem = quote = address = most = most_stem = 0.0
    for k in hits:
        weight, edits = matcher(words[k])
        around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
        if quoted(*places[k]) or not REPORT.isdisjoint(around):
            quote += weight
            continue
        exact += weight if edits == 0 else 0
        near += weight if edits in (1, 2) else 0
        stem += weight if edits == 9 else 0
        address += weight if not ADDRESS.isdisjoint(around) else 0
        most = max(most, weight if edits == 0 else 0)
        most_stem = max(most_stem, weight if edits == 9 else 0)
    per = 10 / len(words)
    return [
        *map(math.log1p, (exact, near, stem, quote, address, len({words[k] for k in hits}))),
        min(3.0, per * exact),
        min(3.0, per * stem),
        most,
        most_stem,
    ]


@dataclass
class Model:
    terms: list[tuple[str, float, bool]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def matcher(self) -> Matcher:
        trie = Trie()
        for t in self.terms:
            trie.add(*t)
        return Matcher(trie)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def _features_of(docs: DataFrame, model: Model, keep: list[str], types: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = model.matcher()
        for b in batches:
            x = np.array([features(t or "", matcher) for t in b["text"]], float).reshape(len(b), len(FEATURES))
            out = b[keep].copy()
            out["score"] = model.scores(x)
            out["x"] = list(x)
            yield out

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInPandas(run, f"{types}, score double, x array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method on standardised inputs with a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def remainder(ident):
    """crc32 of the id as text, mod 5; 0 marks what is held out."""
    return F.crc32(ident.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    own = (
        labels.where("doc_id is not null and toxic is not null")
        .where(remainder(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    )
    n = own.count()
    if n > max_labelled:
        own = own.where(F.pmod(F.xxhash64("__id"), F.lit(n)) < max_labelled)
    own = F.broadcast(own)  # about max_labelled rows
    learned = scratch(docs.join(own, F.col("doc_id") == F.col("__id")).select(text_or_empty().alias("text"), "y"), "toxicity-labelled")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)))
    entries = learned.select("y", tokens.alias("w")).select(
        "y",
        F.explode(
            F.concat(
                F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(False).alias("stem"))),
                *(
                    F.transform(
                        F.array_distinct(F.transform(F.filter("w", lambda t, k=k: F.length(t) > k), lambda t, k=k: F.substring(t, 1, k))),
                        lambda t: F.struct(t.alias("term"), F.lit(True).alias("stem")),
                    )
                    for k in STEMS
                ),
            )
        ).alias("e"),
    )
    sizes = learned.agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).first()
    toxic, total = int(sizes.a or 0), int(sizes.n)
    prior = (toxic + 0.5) / (total + 1)
    blank = Model([], np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), math.log(prior / (1 - prior)))
    if not 0 < toxic < total:
        return blank
    a, n1 = F.col("a"), F.col("n")
    g = "2 * (a * ln(a / (n * {q})) + if(n > a, (n - a) * ln((n - a) / (n * (1 - {q}))), 0))".replace("{q}", f"{toxic / total!r}d")
    found = (
        entries.groupBy("e")
        .agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
        .where((a > 0) & (a > n1 * max(0.5, 2 * toxic / total) if toxic / total < 0.4 else a > n1 * 0.9))
        .withColumn("g", F.expr(g))
        .where(F.col("g") >= LEAST_G)
        .orderBy(F.desc("g"), "e")
        .limit(MAX_TERMS)
        .select("e.term", "e.stem", "a", "n")
        .collect()
    )
    odds = math.log(toxic / (total - toxic))
    terms = pruned({(r.term, r.stem): (r.n, max(0.1, math.log((r.a + 0.5) / (r.n - r.a + 0.5)) - odds)) for r in found})
    model = Model(terms, blank.mean, blank.scale, blank.weights, blank.bias)
    rows = _features_of(learned, model, ["y"], "y int").select("y", "x").collect()  # at most max_labelled short rows
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights, model.bias = fit_logistic((x - model.mean) / model.scale, y)
    return model


def pruned(found: dict[tuple[str, bool], tuple[int, float]]) -> list[tuple[str, float, bool]]:
    """Terms without those that say nothing new.

    A beginning that is (nearly) one word's alone gives way to the word, which may then be
    misspelled; words and longer beginnings give way to a shorter beginning of a family that
    tells the classes apart as well.
    """
    most: dict[str, int] = {}
    for (word, stem), (n, _) in found.items():
        for k in STEMS if not stem else ():
            if len(word) > k:
                most[word[:k]] = max(n, most.get(word[:k], 0))
    family = {t: w for (t, stem), (n, w) in found.items() if stem and most.get(t, 0) < 0.8 * n}
    kept = []
    for (term, stem), (_, w) in found.items():
        if stem and term not in family:
            continue
        if not any(len(term) > k and family.get(term[:k], -math.inf) >= w - 0.5 for k in STEMS):
            kept.append((term, w, stem))
    return kept


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return _features_of(docs, model, ["doc_id"], f"doc_id {kind}").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
