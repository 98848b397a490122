"""URL filter: rules first, then host word segmentation and naive Bayes.

Host and path are cut from the URL, and the longest rule that fits decides.  Where none
fits, the host's labels are split into words by unigram Viterbi (``freecasinobets`` gives
free, casino, bets) with word counts over all pages, and a multinomial naive Bayes scores
the words of host and path; positive log-odds block.

The word counts cover the text of every page, are pre-aggregated and stay a written table:
the substrings of the distinct pieces of hosts and paths are joined to it, so that each piece
is split with the counts of all words it may hold.

The naive Bayes is fitted on labelled URLs: a table (url, blocked) that the caller may give,
or else the pages themselves, labelled by their content.  A page whose text has at least
``LEAST_CUES`` different cue words of the blocked kind, and more of them than of the other,
is a blocked example; the other way round an allowed one; any other page is none.  Their
hosts' and paths' words are counted by class over all pages in written, pre-aggregated
tables, joined to the words to score, so the vocabulary isn't cut and words that no list
names are learned.  A host counts once for each of its words, however many pages it has: a
host that holds a third of all pages would otherwise be the model.  The cue words themselves
stand as a few example URLs beside them, so that without labelled pages they still decide.
Words seen in no example don't speak for either class.

Null URLs and those without ``://`` have an empty host and path, fit no rule, and are
allowed by the method (no words).  Null page_ids stay null; repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small

LONGEST = 20
MEMO = 100_000

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Different cue words of a class from which a page's text is an example of it.
LEAST_CUES = 3
SMOOTH = 0.5

# Cue words of the two classes, in page texts and as example URLs; words of both
# lists speak for neither side much.
BLOCK_WORDS = """casino bets betting poker slots jackpot lottery roulette pills viagra pharmacy meds adult xxx porn escort cams nude loan payday
credit replica watches warez crack keygen torrent phish spam ads adserver tracker popup clickbait seo backlinks malware scam free cheap win track prize bonus""".split()
ALLOW_WORDS = """news world garden library books university research wiki article docs tutorial museum history school science recipes kitchen weather
forecast health guide city travel music concert sports football photo gallery journal forum support help store authors hospital contact free cheap win
track open free cheap win track story""".split()
#: Labels in front of a host that say nothing about it.
SERVICE_LABELS = frozenset(("www", "m", "blog", "mobile", "amp"))


def examples(words: list[str]) -> list[str]:
    """Example URLs in which each word stands twice in a host and once in a path."""
    n = len(words)
    return [f"http://{words[k]}-{words[(k + 1) % n]}.example/{words[(k + 2) % n]}" for k in range(n)]


BLOCKED, ALLOWED = examples(BLOCK_WORDS), examples(ALLOW_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the texts of all pages.

    URLs aren't counted: a concatenated name would make itself a word.
    """
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"<[^>]*>", " ")
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{2,})"), F.lit(1))).alias("word")
    return scratch(pages.select(word).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-words")


class Segmenter:
    """Most probable split of a string into words; unknown words cost more the longer they are."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: tokens of all words, where ``counts`` holds only some."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.logp = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = [0.0] + [math.log(1 / total) - 2.3 * k for k in range(1, LONGEST + 1)]
        self.memo: dict[str, list[str]] = {}

    def __call__(self, text: str) -> list[str]:
        if text in self.memo:
            return self.memo[text]
        best, cut = [0.0], [0]
        for end in range(1, len(text) + 1):
            top = (-math.inf, end - 1)
            for start in range(max(0, end - LONGEST), end):
                p = best[start] + self.logp.get(text[start:end], self.unknown[end - start])
                if p > top[0]:
                    top = (p, start)
            best.append(top[0])
            cut.append(top[1])
        words, at = [], len(text)
        while at:
            words.append(text[cut[at] : at])
            at = cut[at]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[text] = words = words[::-1]
        return words


def pieces(host: str, path: str) -> list[tuple[str, str]]:
    """Runs of letters of host (without its last label) and path, with where they stand."""
    name = re.sub(r":[0-9]*$", "", host.rpartition("@")[2])
    labels = name.split(".")[:-1] or [name]
    labels = labels[1:] if len(labels) > 1 and labels[0] in SERVICE_LABELS else labels
    return [("host", p) for label in labels for p in re.findall(r"[a-z]+", label)] + [("path", p) for p in re.findall(r"[a-z]+", path.lower())]


def _example(url: str) -> tuple[str, str]:
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def split_pieces(rows: DataFrame, counts: DataFrame, total: int, extra: dict[str, int]) -> DataFrame:
    """(piece, words) of the distinct pieces in the lists ``pieces``; a piece gets the counts of its own substrings."""
    piece = rows.select(F.explode("pieces").alias("p")).select(F.substring_index("p", ":", -1).alias("piece")).distinct()
    piece = scratch(piece.withColumn("id", F.monotonically_increasing_id()), "url-pieces")
    starts = piece.select("id", F.explode(F.expr(f"transform(sequence(1, length(piece)), i -> substring(piece, i, {LONGEST}))")).alias("s")).where(F.length("s") > 1)
    parts = starts.select("id", F.explode(F.expr("transform(sequence(2, length(s)), k -> substring(s, 1, k))")).alias("word")).distinct()
    own = parts.join(counts, "word").groupBy("id").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, known, ns in zip(b["piece"], b["known"], b["ns"], strict=True):
                near = {} if known is None else dict(zip(known, map(int, ns), strict=True))
                # All of the few extra words are laid over; only this piece's substrings are looked up.
                out.append(Segmenter({**near, **{w: near.get(w, 0) + n for w, n in extra.items() if w in text}}, total)(text))
            yield pd.DataFrame({"piece": b["piece"], "words": out})

    return scratch(piece.join(own, "id", "left").select("piece", "known", "ns").mapInPandas(run, "piece string, words array<string>"), "url-splits")


def content_labels(pages: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose text tells; repeats stay."""
    text = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"<[^>]*>", " ")
    both = set(BLOCK_WORDS) & set(ALLOW_WORDS)
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{2,})"), F.lit(1)))
    kinds = lambda own: F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in sorted(set(own) - both)])))
    seen = pages.where("url is not null").select("url", words.alias("w")).select("url", kinds(BLOCK_WORDS).alias("bad"), kinds(ALLOW_WORDS).alias("good"))
    told = (F.greatest("bad", "good") >= LEAST_CUES) & (F.col("bad") != F.col("good"))
    return seen.where(told).select("url", (F.col("bad") > F.col("good")).alias("blocked"))


def with_pieces(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of rows with host and path, and pieces (where:letters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(pieces=[[f"{where}:{p}" for where, p in pieces(h, q)] for h, q in zip(b["host"], b["path"], strict=True)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep).mapInPandas(run, f"{kinds}, pieces array<string>")


def odds(examples: DataFrame, split: DataFrame) -> DataFrame:
    """(token, odds): log-odds of block, smoothed, of each word seen in the examples' hosts or paths.

    examples: (host, path, blocked, pieces).  A word in a host speaks half for paths, and the
    reverse.
    """
    each = examples.select("host", "blocked", F.explode("pieces").alias("p")).distinct()
    cut = each.select("host", "blocked", F.substring_index("p", ":", 1).alias("where"), F.substring_index("p", ":", -1).alias("piece")).join(split, "piece")
    words = cut.select("host", "blocked", "where", F.explode("words").alias("w")).distinct()
    own = words.select("blocked", F.concat_ws(":", "where", "w").alias("token"), F.lit(1.0).alias("c"))
    across = words.select("blocked", F.concat(F.when(F.col("where") == "host", "path:").otherwise("host:"), "w").alias("token"), F.lit(0.5).alias("c"))
    counts = own.unionByName(across).groupBy("token").agg(F.sum(F.when(F.col("blocked"), F.col("c")).otherwise(0.0)).alias("bad"), F.sum(F.when(F.col("blocked"), 0.0).otherwise(F.col("c"))).alias("good"))
    counts = scratch(counts, "url-tokens")
    whole = counts.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("b"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"), (F.count(F.lit(1)) + 1).alias("v"))
    ln = lambda c, t: F.log(F.col(c) + SMOOTH) - F.log(F.col(t) + SMOOTH * F.col("v"))
    return counts.join(F.broadcast(whole)).select("token", (ln("bad", "b") - ln("good", "g")).alias("odds"))  # one row


def prior(examples: DataFrame) -> float:
    """Log-odds of block by the hosts of the examples.  Most pages are fine: held at or below one in two."""
    n = {r.blocked: r.n for r in examples.groupBy("blocked").agg(F.count_distinct("host").alias("n")).collect()}
    return math.log(min(max(n.get(True, 0), 1) / max(n.get(False, 0), 1), 0.5))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, words, score (log-odds of block).

    labelled: (url, blocked); by default what the pages' contents tell.
    """
    spark = pages.sparkSession
    counts = word_counts(pages)
    extra: Counter[str] = Counter()
    for url in [*blocked, *allowed]:  # the examples' words are words, however rare they are
        for w in re.findall(r"[a-z]{2,}", " ".join(_example(url))):
            extra[w] += 5
    total = (counts.agg(F.sum("n")).first()[0] or 0) + sum(extra.values())
    host, path = host_and_path(F.col("url"))
    shown = spark.createDataFrame([(u, bad) for bad, urls in ((True, blocked), (False, allowed)) for u in urls], "url string, blocked boolean")
    given = (content_labels(pages) if labelled is None else labelled.select("url", "blocked")).unionByName(shown).where("url is not null and blocked is not null")
    examples = scratch(with_pieces(given.select(host.alias("host"), path.alias("path"), "blocked").distinct(), "host", "path", "blocked"), "url-examples")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    cut = scratch(with_pieces(rows, "page_id", "host", "path").withColumn("__row", F.monotonically_increasing_id()), "url-cut")
    split = split_pieces(cut.select("pieces").unionByName(examples.select("pieces")), counts, total, dict(extra))
    split = small(split, split.count())
    table = scratch(odds(examples, split), "url-odds")
    base = prior(examples)
    each = cut.select("__row", F.posexplode("pieces").alias("at", "p")).select("__row", "at", F.substring_index("p", ":", 1).alias("where"), F.substring_index("p", ":", -1).alias("piece"))
    words = each.join(split, "piece").select("__row", "at", F.posexplode(F.expr("transform(words, w -> concat(where, ':', w))")).alias("nth", "token"))
    known = words.join(small(table, table.count()), "token", "left")
    own = known.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "nth", "token", F.coalesce("odds", F.lit(0.0)).alias("odds")))).alias("l"))
    whole = cut.drop("pieces").join(own, "__row", "left").select(
        "page_id",
        "host",
        "path",
        F.coalesce(F.array_join(F.transform("l", lambda x: x["token"]), " "), F.lit("")).alias("words"),
        # Added up in the words' order, so that rounding doesn't depend on how rows are dealt.
        F.coalesce(F.aggregate("l", F.lit(base), lambda a, x: a + x["odds"]), F.lit(base)).alias("score"),
    )
    fit = whole.withColumn("r", rule_of(F.col("host"), F.col("path"), list(rules)))
    verdict = F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return fit.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "words", "score")
