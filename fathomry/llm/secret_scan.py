"""Secret scan: candidates from whole texts, false positives removed by a random forest.

Candidates are blocks of private keys, tokens of 16 characters or more with letters and
digits or the prefix of a known key format, and values of 8 characters or more that a cue
(password, token, ...) is assigned, letters alone or not.  An equals sign ends a name, so the
value behind it is a candidate of its own; at the end of a token it is padding.  Where
candidates overlap, key blocks and known prefixes come first, then assigned values.  Secrets
of under 8 characters, or under 16 without a cue, aren't candidates.

Each candidate gets features of its length, its characters and their transitions, how much
of it dictionary words cover, the path it stands in (``source``) and the words next to it.  A
random forest, grown in numpy on labelled findings, scores them; a candidate is a secret
from 0.5 up.

Labelled findings are a table (text, start, end, path, secret) that the caller may give, of
which at most ``MAX_FINDINGS`` rows (by a hash) are used.  Without one, findings are made
from a seed by :func:`made_findings`: keys in the public formats of tokens, and look-alikes
such as digests, identifiers, encoded words, paths and placeholders, in typical lines.  The
dictionary is the whole words of a public tokenizer's vocabulary, a file whose path is a
parameter; where it is absent, a small list serves.

Null or empty text: no candidates; null source: no path.  Whole texts are read, and a token
of any length is one candidate.  Repeated rows each give a row; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import random
import re
import string
import uuid
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FINDINGS = 20_000
TREES, DEPTH, LEAF = 40, 8, 4
AROUND = 40

#: A tokenizer's file in JSON, whose entries that end in </w> are whole words.
DICTIONARY_PATH = "/opt/tokenizers/word_bpe_49k.json"

_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9+/_](?:={1,2}(?![A-Za-z0-9+/_.\-=]))?")
_ASSIGNED = re.compile(
    r"""(?i)(?:token|secret|key|passwd|password|pwd|auth|credentials?)[A-Za-z0-9_\-]{0,20}["'`]?\s{0,3}(?:=>|:=|=|:)\s{0,3}["'`]?([^\s"'`,;<>(){}\[\]]{7,}[^\s"'`,;<>(){}\[\].])"""
)
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*PRIVATE KEY-----)?")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

# Cue words, words of paths, prefixes of public key formats, and a small dictionary.
CUES = frozenset("token secret key apikey password passwd pwd auth bearer credential credentials private access api client signing".split())
NOT_CUES = frozenset("sha md5 hash digest checksum commit revision uuid guid id etag integrity example sample dummy placeholder build version".split())
SAMPLE_PATHS = frozenset("test tests example examples sample samples doc docs fixture fixtures mock".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "SG.", "eyJ", "npm_", "pypi-", "-----BEGIN ")
DICTIONARY = frozenset(
    """the and for with that this from have not are was you all can has but one our out new use get set add put map list name type data file
path user test example value number string index table column query build index config server client class module import return function
version release source target input output model layer train batch block page link image style script static public private service
http https www com org net html json xml yaml text time date year month day hour week home main view item order price total count""".split()
)
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "entropy", "switches", "bigram", "vowels", "longest_digits", "longest_letters", "hexadecimal",
    "words", "doc_words", "prefix", "dots", "cue", "not_cue", "assigned", "quoted", "sample_path", "repeats",
)

_LOW = string.ascii_lowercase


@dataclass(frozen=True)
class Words:
    """A dictionary, and how usual each pair of letters is in it: a model of character transitions."""

    known: frozenset[str]
    pairs: dict[str, float]

    @staticmethod
    def of(words: frozenset[str]) -> Words:
        counts: dict[str, int] = {}
        for w in words:
            for a, b in zip(w, w[1:], strict=False):
                counts[a + b] = counts.get(a + b, 0) + 1
        total = sum(counts.values())
        return Words(words, {p: math.log1p(1000 * n / total) for p, n in counts.items()})

    @staticmethod
    def read(path: str | None) -> Words:
        found = set(DICTIONARY)
        if path and Path(path).exists():
            vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
            found |= {w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>")}
        return Words.of(frozenset(w for w in found if len(w) >= 3 and w.isascii() and w.isalpha()))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate in order; they don't overlap."""
    found = [(0, *m.span()) for m in _KEY_BLOCK.finditer(text)]
    found += [(1, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.startswith(PREFIXES):
            found.append((0, *m.span()))
        elif any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            found.append((2, *m.span()))
    taken: list[tuple[int, int]] = []
    for _, start, end in sorted(found):
        k = bisect(taken, (start, end))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
            taken.insert(k, (start, end))
    return taken


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(text: str, start: int, end: int, path: str | None, doc_words: frozenset[str], words: Words) -> list[float]:
    t = text[start:end]
    n = len(t)
    kinds = [_kind(c) for c in t]
    share = [kinds.count(k) / n for k in range(4)]
    counts = np.unique(list(t), return_counts=True)[1] / n
    low = t.lower()
    pairs = [low[k : k + 2] for k in range(n - 1) if low[k] in _LOW and low[k + 1] in _LOW]
    pieces = [p.lower() for p in _PIECE.findall(t) if len(p) >= 3]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - AROUND) : start])]
    after = [w.lower() for w in _WORD.findall(text[end : end + AROUND // 2])]
    near = set(before[-4:]) | set(after[:1])
    lead = text[max(0, start - 6) : start].rstrip(" \"'`>")
    longest = lambda pattern: max((len(x) for x in re.findall(pattern, t)), default=0)
    return [
        math.log(n), *share, float(-(counts * np.log2(counts)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum(words.pairs.get(p, 0.0) for p in pairs) / max(len(pairs), 1),
        sum(c in "aeiou" for c in low) / n, longest(r"[0-9]+"), longest(r"[A-Za-z]+"),
        float(all(c in string.hexdigits for c in t)),
        sum(len(p) for p in pieces if p in words.known) / n,
        sum(len(p) for p in pieces if p in doc_words) / n,
        float(t.startswith(PREFIXES)), t.count(".") / n,
        float(not CUES.isdisjoint(near)), float(not NOT_CUES.isdisjoint(near)),
        float(lead[-1:] in ("=", ":")), float(text[start - 1 : start] in ('"', "'", "`") if start else 0),
        float(not SAMPLE_PATHS.isdisjoint(re.split(r"[^a-z]+", (path or "").lower()))),
        1 - len(set(t)) / min(n, 64),
    ]


def made_findings(seed: int = 7, n: int = 3000) -> list[tuple[str, int, int, str, bool]]:
    """Labelled findings (text, start, end, path, secret): n of each class, from a seed."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    full, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    words = sorted(DICTIONARY)
    out = []
    for k in range(2 * n):
        secret = k % 2 == 0
        if secret:
            t = rng.choice(
                [
                    lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(full, 36), lambda: "sk_live_" + pick(full, 24),
                    lambda: "AIza" + pick(full + "-_", 35), lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: pick(hexa.upper(), 40), lambda: pick(b64, 40), lambda: pick(full, rng.randrange(20, 48)),
                    lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(full, 24), lambda: "eyJ" + pick(full, 30) + ".eyJ" + pick(full, 60) + "." + pick(full + "-_", 43),
                    lambda: pick(full + "!#$%&*+-?@^_", rng.randrange(9, 16)), lambda: pick(full, rng.randrange(9, 16)), lambda: pick(string.ascii_letters, rng.randrange(18, 33)),
                    lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(b64, 64) for _ in range(rng.randrange(3, 12))) + "\n-----END RSA PRIVATE KEY-----",
                ]
            )()
            cue = rng.choice(["token", "secret", "api_key", "password", "access key", "auth", "API_KEY", "TOKEN", "client secret", "private key"])
            lead = rng.choice([f'{cue} = "', f"{cue}: ", f"{cue}='", f"{cue}=", f'"{cue}": "', "Authorization: Bearer ", f"https://api.example.com/v1?{cue}=", f"export {cue.upper()}="])
            path = rng.choice(["src/main", "config", "", "app/settings"])
        else:
            t = rng.choice(
                [
                    lambda: pick(hexa, rng.choice([32, 40, 64])), lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: "-".join(rng.choices(words, k=4)) + pick(string.digits, 2),
                    lambda: "/".join(rng.choices(words, k=4)) + f"/v{rng.randrange(9)}", lambda: ".".join(rng.choices(words, k=3)) + f".{rng.randrange(99)}.js",
                    lambda: "".join(w.title() for w in rng.choices(words, k=4)) + str(rng.randrange(99)), lambda: "your-token-here-" + pick("0123456789", 4), lambda: "x" * 20 + "1",
                    lambda: base64.b64encode(" ".join(rng.choices(words, k=4)).encode()).decode(), lambda: "_".join(rng.choices(words, k=4)) + pick(string.digits, 3),
                    lambda: pick(_LOW, 14) + pick(string.digits, 2) + pick(_LOW, 4), lambda: f"mail{rng.randrange(99)}.{rng.choice(words)}.example.com",
                ]
            )()
            if k % 8 == 1:  # values that a cue is assigned, and no secrets
                t = rng.choice(
                    [
                        lambda: "".join(rng.choices(words, k=2)), lambda: "_".join(rng.choices(words, k=rng.randrange(2, 4))), lambda: ".".join(rng.choices(words, k=3)), lambda: "x" * rng.randrange(8, 20),
                        lambda: "/".join(rng.choices(words, k=3)), lambda: "your-" + "-".join(rng.choices(words, k=2)), lambda: "${" + rng.choice(words).upper() + "_" + rng.choice(words).upper() + "}",
                        lambda: "".join(w.title() for w in rng.choices(words, k=3)), lambda: "*" * rng.randrange(8, 14), lambda: "https://example.com/" + rng.choice(words), lambda: "os.environ." + rng.choice(words),
                    ]
                )()
                leads = [f"{c}{sign}" for c in ("password", "token", "key", "api_key", "secret", "primary key") for sign in (": ", "=", ' = "')]
            else:
                leads = None
            lead = rng.choice(leads or ["commit ", "sha1: ", "md5=", "checksum ", "id ", 'integrity="', "see ", "uuid: ", f"{rng.choice(words)} ", f"{rng.choice(words)} {rng.choice(words)} "])
            path = rng.choice(["src/main", "tests/fixtures", "docs/examples", ""])
        head = " ".join(rng.choices(words, k=4)) + " " + lead
        tail = ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + " " + " ".join(rng.choices(words, k=3))
        out.append((head + t + tail, len(head), len(head) + len(t), path, secret))
    return out


class Forest:
    """Trees as arrays; grown on bootstrap samples with a random part of the features at each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng.integers(0, len(y), len(y)), depth, rng) for _ in range(trees)] if len(y) else []

    def _grow(self, x, y, rows, depth, rng) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if depth and len(rows) >= 2 * LEAF and 0 < nodes[at][4] < 1:
                best = self._split(x, y, rows, rng)
                if best:
                    f, cut = best
                    below = x[rows, f] <= cut
                    nodes[at][:2] = [f, cut]
                    nodes[at][2] = grow(rows[below], depth - 1)
                    nodes[at][3] = grow(rows[~below], depth - 1)
            return at

        grow(rows, depth)
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    @staticmethod
    def _split(x, y, rows, rng) -> tuple[int, float] | None:
        """The cut with the least Gini impurity among some features."""
        best, found = math.inf, None
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]]
            n = np.arange(1, len(t))
            a = np.cumsum(t)[:-1]
            m, b = len(t) - n, t.sum() - a
            cost = 2 * a * (1 - a / n) + 2 * b * (1 - b / m)
            ok = (v[1:] > v[:-1]) & (n >= LEAF) & (m >= LEAF)
            if ok.any():
                k = int(np.flatnonzero(ok)[np.argmin(cost[ok])])
                if cost[k] < best:
                    best, found = cost[k], (int(f), float((v[k] + v[k + 1]) / 2))
        return found

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, low, high, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                inner = f[at] >= 0
                if not inner.any():
                    break
                own = at[inner]
                at[inner] = np.where(x[inner, f[own]] <= cut[own], low[own], high[own])
            total += value[at]
        return total / max(len(self.trees), 1)


def train(findings: list[tuple[str, int, int, str | None, bool]], words: Words) -> Forest:
    x = np.array([features(t, a, b, p, frozenset(w.lower() for w in _WORD.findall(t[:a] + " " + t[b:])), words) for t, a, b, p, _ in findings], float)
    return Forest(x.reshape(len(findings), len(FEATURES)), np.array([f[4] for f in findings], float))


def doc_words(text: str, found: list[tuple[int, int]]) -> frozenset[str]:
    """Words of a text outside its candidates."""
    at, out = 0, set()
    for start, end in [*found, (len(text), len(text))]:
        out.update(w.lower() for w in _WORD.findall(text[at:start]))
        at = end
    return frozenset(out)


def labelled(findings: DataFrame, limit: int = MAX_FINDINGS) -> list[tuple]:
    """At most ``limit`` rows of a table of findings, those with the least hash."""
    rows = findings.where("text is not null and secret is not null").orderBy(F.xxhash64("text", "start"), "text", "start").limit(limit)
    return [(r.text, r.start, r.end, r.path, bool(r.secret)) for r in rows.select("text", "start", "end", "path", "secret").collect()]


def scan(docs: DataFrame, findings: DataFrame | None = None, dictionary: str | None = DICTIONARY_PATH) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets, max_score, secrets (start:end:score, comma-joined)."""
    lexicon = Words.read(dictionary)  # on the driver; the words, some hundred kilobytes, go with the code
    forest = train(labelled(findings) if findings is not None else made_findings(), lexicon)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own: list[list[tuple[int, int]]] = []
            x = []
            for text, path in zip(b["text"], b["path"], strict=True):
                found = candidates(text or "")
                own.append(found)
                own_words = doc_words(text, found) if found else frozenset()
                x.extend(features(text, s, e, path, own_words, lexicon) for s, e in found)
            p = iter(forest.scores(np.array(x, float).reshape(len(x), len(FEATURES))).tolist())
            scored = [[(s, e, next(p)) for s, e in found] for found in own]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_candidates": [len(f) for f in scored],
                    "n_secrets": [sum(q >= 0.5 for *_, q in f) for f in scored],
                    "max_score": [round(max((q for *_, q in f), default=0.0), 6) for f in scored],
                    "secrets": [",".join(f"{s}:{e}:{q:.3f}" for s, e, q in f if q >= 0.5) for f in scored],
                }
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("path"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_candidates long, n_secrets long, max_score double, secrets string")
