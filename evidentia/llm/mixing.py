"""Sources mixed to target shares of tokens, with a cap on how often a document is used.

Weights are shares to the power of an exponent: the target shares, or without any the sources' own shares of the tokens. The
exponent is 1, or less where a budget or an entropy is wanted: it is bisected towards 0 (equal weights) until the weights reach
the entropy, and until no source would be repeated more often than its cap allows. Without a budget, it is the largest that no
cap forbids, so every source gives exactly its share. If no exponent serves the budget, the most that any allows is drawn, with
a warning. A source's part is used up by whole passes over the
source and then by a keyed permutation: blocks of documents in permuted order, up to the block at the edge, whose documents
are taken in permuted order. Only block sums are gathered; documents meet in no group larger than a block.

Defined results: documents without text or source, or of a source without target, are not drawn; several targets for a source are
added up and its strictest cap holds; a target without documents gets nothing and is reported with share 0, and the rest
keep their proportions; empty tables give no draws; documents that share an id are used on their own.
"""

from __future__ import annotations

import base64
import functools
import math
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.session import cut, small, spread

#: Documents in a block, about.
BLOCK = 2_000


@functools.lru_cache(4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Adds n, the tokens of column t by the tokenizer file (tiktoken ranks) at that path, and drops t."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        encoding = _encoding(tokenizer)
        for b in batches:
            for k, s, t in zip(b["k"], b["s"], b["t"], strict=True):
                yield k, s, len(encoding.encode_ordinary(t.encode("utf-8", "replace").decode()))

    return map_rows(docs, run, f"k {kinds['k']}, s string, n long")


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised shares to the power of exponent."""
    raw = {s: x**exponent for s, x in shares.items() if x > 0}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()}


def bisect(good: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The largest value in [low, high] that is good, if low is and good ones lie below bad ones."""
    if good(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def serving_exponent(shares: dict[str, float], room: dict[str, float], budget: float, start: float) -> float | None:
    """The largest exponent up to `start` at which every source has room for its part of the budget; None if there is none.

    A source's part is log-concave in the exponent, so the exponents that ask too much of it are an interval: a source that lacks
    room at the exponent in hand moves it to the lower end of that interval, found by bisection.
    """
    lacking = lambda e: [s for s, w in tempered(shares, e).items() if w * budget > room[s] * (1 + 1e-9)]
    e = start
    while short := lacking(e):
        for s in short:
            asked = lambda x, s=s: tempered(shares, x)[s] * budget
            if asked(0.0) > room[s]:  # the interval holds all from 0 to e
                return None
            e = min(e, bisect(lambda x, s=s: asked(x, s) <= room[s], 0.0, e))
        if e <= 0:
            return None if lacking(0.0) else 0.0
    return e


def plan(tokens: dict[str, int], shares: dict[str, float] | None, repeats: dict[str, int], budget: float | None = None, least_entropy: float | None = None) -> tuple[dict[str, float], float]:
    """Weight of each source and the tokens to draw in all. Without shares, those of the tokens count."""
    shares = {s: float(n) for s, n in tokens.items() if s in repeats} if shares is None else shares
    there = tempered({s: x for s, x in shares.items() if x > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 1) > 0}, 1.0)
    if not there:
        return {}, 0.0
    room = {s: float(repeats.get(s, 1) * tokens[s]) for s in there}
    most = lambda w: min(room[s] / x for s, x in w.items())
    exponent = 1.0
    if least_entropy is not None:
        exponent = bisect(lambda e: entropy(tempered(there, e)) >= least_entropy, 0.0, 1.0)
    if budget is not None:
        served = serving_exponent(there, room, budget, exponent)
        if served is None:
            exponent = max((exponent * i / 200 for i in range(201)), key=lambda e: most(tempered(there, e)))
            warnings.warn(f"the caps allow no more than {most(tempered(there, exponent)):.0f} of {budget:.0f} tokens", stacklevel=2)
        else:
            exponent = served
    weights = tempered(there, exponent)
    return weights, most(weights) if budget is None else min(budget, most(weights))


def draws(docs: DataFrame, targets: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", source: str = "source", share: str | None = "target_share", repeat: str = "max_repeat", budget: float | str | None = None, least_entropy: float | None = None, seed: int = 17) -> DataFrame:
    """key, source, tokens, uses of every drawn document. Without a share column the sources' token shares count; the budget is in
    tokens, "all" for as many as the sources have; the entropy is in nats."""
    wanted = targets.groupBy(F.col(source).alias("s")).agg(F.sum(F.lit(1.0) if share is None else F.col(share)).alias("share"), F.min(repeat).alias("repeat")).where("s is not null and share > 0")
    picked = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t")).where("k is not null and t <> ''")
    rows = wanted.collect()  # the targets are a short list that a person wrote
    picked = spread(picked.where(F.col("s").isin([r.s for r in rows])) if rows else picked.limit(0))
    counted = cut(token_counts(picked, tokenizer).where("n > 0"))
    sums = {r.s: (r.tokens, r.docs) for r in counted.groupBy("s").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).collect()}
    tokens = {s: n for s, (n, _) in sums.items()}
    weights, total = plan(tokens, None if share is None else {r.s: r.share for r in rows}, {r.s: r.repeat or 1 for r in rows}, float(sum(tokens.values())) if budget == "all" else budget, least_entropy)
    table = [(s, min(int(total * w + 1e-6), sums[s][0] * next(r.repeat or 1 for r in rows if r.s == s)), sums[s][0], max(1, sums[s][1] // BLOCK)) for s, w in weights.items()]
    spark = docs.sparkSession
    budgets = spark.createDataFrame(table, "s string, budget long, total long, blocks long")
    hashed = F.xxhash64(F.lit(seed), F.col("k").cast("string"), "s")
    blocks = counted.join(small(budgets), "s").withColumn("h", hashed).withColumn("block", F.pmod("h", "blocks")).withColumn("order", F.xxhash64(F.lit(seed + 1), "block", "s"))
    # The block that a source's budget ends in: sums by block, in the permuted order.
    by_block = blocks.groupBy("s", "budget", "total", "block", "order").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    placed = by_block.withColumn("start", F.coalesce(before, F.lit(0))).select("s", "block", "start", (F.col("start") + F.col("n")).alias("end"))
    placed = cut(placed)
    rest = F.col("budget") % F.col("total")
    joined = blocks.join(placed, ["s", "block"]).withColumn("passes", F.floor(F.col("budget") / F.col("total"))).withColumn("rest", rest)
    edge = (F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest"))
    inside = Window.partitionBy("s", "block").orderBy("h", "k", "n").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = joined.where(edge).withColumn("reached", F.col("start") + F.sum("n").over(inside)).withColumn("extra", (F.col("reached") - F.col("n") / 2 <= F.col("rest")).cast("int"))
    away = joined.where(~edge).withColumn("reached", F.lit(0).cast("long")).withColumn("extra", (F.col("end") <= F.col("rest")).cast("int"))
    used = at_edge.unionByName(away).withColumn("uses", (F.col("passes") + F.col("extra")).cast("int")).where("uses > 0")
    return used.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("tokens"), "uses")


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share") -> DataFrame:
    """source, target, actual share and tokens, most uses: what draws() came to, also for sources that gave nothing."""
    wanted = targets.groupBy(F.col(source).alias("s")).agg(F.sum(share).alias("target_share"))
    given = drawn.groupBy(F.col(source).alias("s")).agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    total = given.agg(F.sum("tokens").alias("all_tokens"))
    joined = wanted.where("s is not null").join(given, "s", "left").crossJoin(F.broadcast(total))  # one row on the right
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(F.col("s").alias(source), "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"))
