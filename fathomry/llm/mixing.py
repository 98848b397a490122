"""Mixing sources to target weights (native DataFrame and SQL functions only).

Source i holds a share p_i of all tokens and gets the weight p_i ** a / sum(p ** a).  The
exponent a is found by bisection between 0 (even weights) and 1 (as they are): the largest
that meets the target entropy (a part of the greatest possible, ln of the number of
sources), raised where a source would otherwise be repeated more than ``max_repeats``
times.  The weights are realised in tokens: with a budget B, source i gives
round(w_i * B) tokens.  Without one, B is the least at which every document of every
source is used at least once, so nothing is dropped.

Each pass over a source is a permutation of its documents by a hash of seed, pass and
doc_id; the last pass stops at the budget.  The passes of a source are spread evenly over
blocks of about ``block_tokens`` tokens, so that every block has the target mix, and
within a block a second hash gives the order.

Running sums over a source don't go through one task: a permutation is cut by the first
hex digits of its hash into pieces of some hundred documents, the pieces' sums are
pre-aggregated and added up, and running sums are taken within pieces.

Documents without words (null, empty, blank) take no tokens but are placed all the same; a
source of such documents alone has weight 0 and one pass.  Null sources are a source of
their own.  Repeated rows are separate documents, placed in turn; an empty table gives an
empty plan; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, text_or_empty

ENTROPY = 0.95
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
STEPS = 60
SEED = "mix"
#: Documents in a piece of a permutation, to a factor of 16.
PIECE = 256

_H = "aggregate(ps, struct(0d as z, 0d as s), (t, p) -> struct(t.z + pow(p, {a}) as z, t.s + pow(p, {a}) * ln(p) as s), t -> ln(t.z) - {a} * t.s / nullif(t.z, 0d))"
#: Most repeats of a source, by exponent: max of w / p times the budget's ratio to all tokens.
_R = "aggregate(ps, struct(0d as z, 0d as m), (t, p) -> struct(t.z + pow(p, {a}) as z, greatest(t.m, pow(p, {a} - 1)) as m), t -> t.m / nullif(t.z, 0d)) * ({ratio})"
_FULL = "aggregate(ps, struct(0d as z, 0d as m), (t, p) -> struct(t.z + pow(p, {a}) as z, greatest(t.m, pow(p, 1 - {a})) as m), t -> t.m * t.z)"


def _bisect(goes_up: str) -> str:
    """The exponent in [0, 1] up to which ``goes_up`` holds; {a} in it stands for the middle."""
    mid = "((r.lo + r.hi) / 2)"
    test = goes_up.replace("{a}", mid)
    return f"aggregate(sequence(1, {STEPS}), struct(0d as lo, 1d as hi), (r, k) -> if({test}, struct({mid} as lo, r.hi as hi), struct(r.lo as lo, {mid} as hi)), r -> r.hi)"


def source_plan(tokens: DataFrame, entropy: float, max_repeats: float, budget: int | None) -> DataFrame:
    """(g, docs, tokens, weight, quota, passes, digits, budget): one row for each source.

    ``tokens``: rows of (g, n).  The shares lie in one array, so the number of sources should
    be some millions at most.
    """
    per = tokens.groupBy("g").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    per = scratch(per, "mixing-sources")
    shares = per.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("g", "tokens"))).alias("l"), F.sum("tokens").alias("total"))
    shares = shares.select("total", F.expr("transform(l, x -> cast(x.tokens as double) / total)").alias("ps"))
    ratio = _FULL if budget is None else f"{budget}d / total"
    target = f"{entropy!r}d * ln(size(ps)) - 1e-12"
    a_entropy = _bisect(f"{_H} >= {target}")
    a_repeats = _bisect(f"{_R.replace('{ratio}', ratio)} > {max_repeats!r}d + 1e-9")
    one = shares.select("ps", "total", F.expr(f"greatest({a_entropy}, {a_repeats})").alias("a"))
    one = one.select(
        "a",
        "total",
        F.expr("aggregate(ps, 0d, (t, p) -> t + pow(p, a))").alias("z"),
        F.expr(f"cast(round(total * ({ratio.replace('{a}', 'a')})) as bigint)").alias("budget"),
    )
    one = scratch(one, "mixing-exponent")
    w = "pow(cast(tokens as double) / total, a) / z"
    plan = per.join(F.broadcast(one)).select(  # one row
        "g",
        "docs",
        "tokens",
        F.expr(f"if(tokens > 0, {w}, 0d)").alias("weight"),
        F.expr(f"if(tokens > 0, cast(round(budget * {w}) as bigint), 0L)").alias("quota"),
        "budget",
    )
    return plan.select(
        "*",
        F.expr("if(tokens > 0, cast(ceil(quota / tokens) as int), 1)").alias("passes"),
        F.expr(f"cast(greatest(0, ceil(log(16, greatest(docs, 1) / {PIECE}d))) as int)").alias("digits"),
    )


def mix(
    docs: DataFrame,
    entropy: float = ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """The mix: doc_id, source, pass, n_tokens, weight, block, slot; read by block, then slot."""
    text = text_or_empty()
    rows = scratch(
        docs.select("doc_id", "source", F.coalesce(F.col("source").cast("string"), F.lit("\x01")).alias("g"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")),
        "mixing-tokens",
    )
    plan = scratch(source_plan(rows.select("g", "n"), entropy, max_repeats, budget), "mixing-plan")
    plan = small(plan, plan.count())
    name = f"concat('{seed}:', pass, ':', coalesce(cast(doc_id as string), 'null'))"
    dealt = (
        rows.join(plan, "g")
        .select("doc_id", "source", "g", "n", "weight", "quota", "tokens", "digits", "budget", F.explode(F.expr("sequence(0, greatest(passes, 1) - 1)")).alias("pass"))
        .withColumn("h", F.md5(F.expr(name)))
        .withColumn("piece", F.expr("substring(h, 1, digits)"))
    )
    piece = dealt.groupBy("g", "pass", "piece").agg(F.sum("n").alias("t"))
    offset = piece.select(F.col("g").alias("__g"), F.col("pass").alias("__pass"), F.col("piece").alias("__piece"), F.expr("sum(t) over (partition by g, pass order by piece) - t").alias("before"))
    within = dealt.withColumn("own", F.expr("sum(n) over (partition by g, pass, piece order by h, n rows unbounded preceding) - n"))
    placed = within.join(
        offset, (F.col("g") == F.col("__g")) & (F.col("pass") == F.col("__pass")) & (F.col("piece") == F.col("__piece"))
    ).withColumn("at", F.expr("pass * tokens + before + own"))
    used = placed.where("at < quota or (n = 0 and at <= quota)").withColumn(
        "block", F.expr(f"cast(if(quota = 0, 0, least(floor(at * ceil(budget / {float(block_tokens)}d) / quota), ceil(budget / {float(block_tokens)}d) - 1)) as bigint)")
    )
    return used.select(
        "doc_id",
        "source",
        "pass",
        F.col("n").alias("n_tokens"),
        F.round("weight", 6).alias("weight"),
        F.greatest("block", F.lit(0)).alias("block"),
        F.expr(f"cast(row_number() over (partition by greatest(block, 0L) order by md5(concat('slot:', h)), h, n) as bigint)").alias("slot"),
    )
