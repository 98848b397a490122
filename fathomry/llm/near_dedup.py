"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

1. Each row gets its set of distinct 5-word shingles (64-bit hashes), a fingerprint of the
   set and a signature of ``CHUNKS * WIDTH`` min-hashes of ``BITS`` bits.  Equal sets become
   one representative, the least doc_id that has one, by a pre-aggregated minimum over
   fingerprints.  A doc_id with several texts may represent several sets.
2. Signatures are split into ``CHUNKS`` chunks.  Two signatures that differ in at most
   ``REACH = CHUNKS * (ERRORS + 1) - 1`` symbols have a chunk with at most ``ERRORS`` errors
   (the pigeonhole), so with every choice of that many symbols left out each such pair
   shares a key: all pairs within the signature threshold ``REACH`` are found.
3. Within a key, representatives at Hamming distance up to ``REACH`` are linked by a
   breadth-first search, which leaves out only pairs that are linked by others.  This gives
   coarse groups that hold all pairs within ``REACH``.
4. Within a coarse group, the search is repeated with the full sets: 100 * intersection >=
   75 * union confirms a link.  A pair is skipped only if both are already in one component.

At similarity 0.75 a pair differs in 30 of 120 symbols on average, with a deviation of 4.7;
``REACH`` is 47, 3.7 deviations above (a chance of about 1e-4, falling steeply above 0.75).

Keys and groups beyond a size are cut into blocks by a hash of the representative, and each
pair of blocks is a task of its own: exact for hot groups too, with bounded memory.

Documents with fewer than five words have one shingle, the whole sequence; without words
(null, empty, blank texts) they have none and are linked with nothing.  A doc_id with
several texts is one document linked by any of them; each row is returned.  Rows without
doc_id are linked with nothing and kept.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small
from .components import components

SHINGLE = 5
CHUNKS, WIDTH, ERRORS, BITS = 24, 5, 1, 16
K = CHUNKS * WIDTH
#: Symbols of a signature that may differ in a candidate: as many as the pigeonhole vouches for.
REACH = CHUNKS * (ERRORS + 1) - 1
#: Documents of a key, and shingles of a coarse group, above which it is cut into blocks.
KEY_BLOCK = 4096
SET_BLOCK = 2_000_000
#: Words whose hashes a Python worker remembers.
MEMO = 300_000

_MULT = np.random.default_rng(20240229).integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, memo: _Memo) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            s = (s ^ (s >> np.uint64(29))) * _P + h[k : len(h) - size + 1 + k]
        s = (s ^ (s >> np.uint64(32))) * _Q
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(own: np.ndarray) -> bytes:
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 4096):
            np.minimum(least, (_MULT[:, None] * own[None, k : k + 4096]).min(axis=1), out=least)
    return (least >> np.uint64(64 - 24 - BITS)).astype(np.uint16).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fp, sig) of every row; fp and sig are null for empty sets."""
    ids = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo()
        for b in batches:
            n, fp, sig = [], [], []
            for t in b["text"]:
                own = shingles(t, memo)
                n.append(len(own))
                fp.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig.append(signature(own) if len(own) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "fp": fp, "sig": sig})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        run, f"doc_id {ids}, n_shingles long, fp binary, sig binary"
    )


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All keys of each signature: a hash of the chunk, the symbols left out, and the others' values."""
    picks = list(combinations(range(WIDTH), WIDTH - ERRORS))
    for b in batches:
        if not len(b):
            continue
        s = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), CHUNKS, WIDTH).astype(np.uint64)
        chunk = np.arange(CHUNKS, dtype=np.uint64)[None, :]
        for k, pick in enumerate(picks):
            with np.errstate(over="ignore"):
                key = (chunk * np.uint64(len(picks)) + np.uint64(k + 1)) * _Q
                for p in pick:
                    key = (key ^ (key >> np.uint64(29)) ^ s[:, :, p]) * _P
            yield pd.DataFrame({"key": key.astype(np.int64).ravel(), "rep": np.repeat(b["rep"].to_numpy(np.int64), CHUNKS)})


def _coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rep, label = [], []
        for pack in b["pack"]:
            own = {int(r["rep"]): r["sig"] for r in pack}
            ids = np.array(sorted(own), np.int64)
            m = np.frombuffer(b"".join(own[int(i)] for i in ids), np.uint16).reshape(len(ids), K)
            left = np.arange(len(ids))
            while len(left):
                root, queue, left = left[0], [left[0]], left[1:]
                while queue and len(left):
                    near = (m[left] != m[queue.pop()]).sum(axis=1) <= REACH
                    queue.extend(left[near])
                    rep.extend(ids[left[near]])
                    label.extend([ids[root]] * int(near.sum()))
                    left = left[~near]
        yield pd.DataFrame({"rep": np.array(rep, np.int64), "label": np.array(label, np.int64)})


def linked(a: frozenset, b: frozenset) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rep, label, split = [], [], []
        for pack, cut in zip(b["pack"], b["cut"], strict=True):
            rows = sorted(((int(r["rep"]), r["sig"], r["own"]) for r in pack), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            m = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(ids), K)
            sets = [frozenset(np.frombuffer(r[2], np.uint64).tolist()) for r in rows]
            left = np.arange(len(ids))
            while len(left):
                root, queue, left = left[0], [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    near = (m[left] != m[at]).sum(axis=1) <= REACH
                    for k in np.flatnonzero(near):
                        near[k] = linked(sets[at], sets[left[k]])
                    got = left[near]
                    queue.extend(got)
                    rep.extend(ids[got])
                    label.extend([ids[root]] * len(got))
                    split.extend([bool(cut)] * len(got))
                    left = left[~near]
        yield pd.DataFrame({"rep": np.array(rep, np.int64), "label": np.array(label, np.int64), "split": np.array(split, bool)})


def _block_pairs(own, blocks):
    """Pairs of blocks that a row takes part in."""
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))


def coarse_links(reps: DataFrame) -> DataFrame:
    """(node, label), numbers of representatives, such that the components hold every pair within ``REACH``."""
    keys = reps.select("rep", "sig").mapInPandas(_keys, "key long, rep long")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / KEY_BLOCK).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0)
    lists = (
        shared.select("key", "rep", _block_pairs(own, F.col("blocks")).alias("b"))
        .groupBy("key", "b")
        .agg(F.sort_array(F.collect_set("rep")).alias("l"))
        .where(F.size("l") > 1)
        .select("l")
        .distinct()
        .select(F.xxhash64("l").alias("lid"), F.explode("l").alias("rep"))
    )
    packs = lists.join(reps.select("rep", "sig"), "rep").groupBy("lid").agg(F.collect_list(F.struct("rep", "sig")).alias("pack"))
    return packs.select("pack").mapInPandas(_coarse, "rep long, label long").where("label < rep").withColumnRenamed("rep", "node")


def exact_links(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, label, split): confirmed links within coarse groups, each to the least of its part."""
    whole = groups.select(F.col("node").alias("rep"), F.col("root").alias("grp")).unionByName(groups.select(F.col("root").alias("rep"), F.col("root").alias("grp")).distinct())
    held = reps.select("rep", "node", "fp", "n_shingles").join(whole, "rep")
    sizes = held.groupBy("grp").agg(F.sum("n_shingles").alias("total"))
    held = scratch(
        held.join(sizes, "grp").select("rep", "node", "fp", "grp", F.ceil(F.col("total") / SET_BLOCK).cast("int").alias("blocks")), "dedup-members"
    )
    n = held.count()

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo()
        for b in batches:
            own = [shingles(t, memo) for t in b["text"]]
            out = b[["rep", "grp", "blocks"]].copy()
            out["sig"] = [signature(x) if len(x) else b"\0" * (2 * K) for x in own]
            out["own"] = [x.tobytes() for x in own]
            fp = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
            yield out[[a == bytes(w) for a, w in zip(fp, b["fp"], strict=True)]]

    text = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    # A row repeated, or with an equal set in other words' order, gives its representative twice: one is enough.
    sets = text.join(small(held, n), "node").mapInPandas(full, "rep long, grp long, blocks int, sig binary, own binary")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).otherwise(0)
    return (
        sets.select("grp", (F.col("blocks") > 1).alias("cut"), F.struct("rep", "sig", "own").alias("r"), _block_pairs(own, F.col("blocks")).alias("b"))
        .groupBy("grp", "b", "cut")
        .agg(F.collect_list("r").alias("pack"))
        .select("pack", "cut")
        .mapInPandas(_exact, "rep long, label long, split boolean")
        .where("label < rep")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    base = scratch(sketches(docs), "dedup-sketches")
    live = base.where("fp is not null and doc_id is not null").withColumn("node", F.col("doc_id").cast("long"))
    sets = live.groupBy("fp").agg(
        F.min("node").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies")
    )
    # A representative is a set; its number is a doc_id, or a number below all of them where that doc_id stands for several sets.
    several = scratch(live.groupBy("node").agg(F.count_distinct("fp").alias("c")).where("c > 1").select("node"), "dedup-several")
    odd = not several.isEmpty()
    reps = sets.withColumn("rep", F.col("node"))
    if odd:
        mark = several.withColumn("several", F.lit(True))
        own = F.when(F.col("several"), -F.abs(F.xxhash64("fp")) - 1).otherwise(F.col("node"))
        reps = sets.join(mark, "node", "left").withColumn("rep", own).drop("several")
    reps = scratch(reps, "dedup-representatives")
    groups = components(coarse_links(reps), "dedup-coarse")
    found = scratch(exact_links(docs, reps, groups).distinct(), "dedup-links")
    if odd:
        roots = _joined(live, reps, found, several)
    elif found.where("split").isEmpty():
        roots = found.select(F.col("rep").alias("node"), F.col("label").alias("root")).distinct()
    else:
        roots = components(found.select(F.col("rep").alias("node"), "label"), "dedup-exact")
    rooted = (
        reps.select("fp", "node", "copies")
        .join(roots, "node", "left")
        .where("copies > 1 or root is not null")
        .select("fp", F.coalesce("root", "node").alias("root"))
    )
    kind = base.schema["doc_id"].dataType
    out = base.select("doc_id", "n_shingles", "fp").join(rooted, "fp", "left")
    component = F.coalesce(F.col("root").cast(kind), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(live: DataFrame, reps: DataFrame, found: DataFrame, several: DataFrame) -> DataFrame:
    """(node, root) where some doc_ids have several texts: these link all sets they have, under the least doc_id of all."""
    name = reps.select("rep", "node")
    ends = found.join(name, "rep").withColumnRenamed("node", "a").join(name.select(F.col("rep").alias("label"), F.col("node").alias("b")), "label")
    links = ends.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    same = live.join(several, "node").join(reps.select("fp", F.col("node").alias("label")), "fp").select("node", "label")
    return components(links.unionByName(same).where("label < node"), "dedup-exact")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that aren't the least of their component; columns as before.

    Rows that repeat a kept doc_id stay.  Ids of dropped documents are joined back; texts are
    shuffled only if those ids are too many to broadcast.
    """
    gone = scratch(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "dedup-dropped")
    return docs.join(small(gone, gone.count()), F.col("doc_id") == F.col("__gone"), "left_anti")
