"""Near-duplicate texts by the generalised pigeonhole principle over similarity signatures, every hit verified exactly.

1. A text's set of n-character substrings (white space removed, lower case) is reduced by one-permutation hashing to POSITIONS
   symbols; two texts of similarity s agree on each with probability s. Texts that are equal after folding form one class.
2. Bits of the symbols are correlated over the whole corpus (a Gram matrix summed over tasks), and positions that
   vary together go into one partition: agreement inside a partition is then all or nothing, which keeps chance matches down.
3. Each partition gets its own threshold t: a pair is a candidate if at most t of the partition's symbols differ, and -1 skips
   the partition. For every choice the number of candidate pairs is estimated over the whole corpus by second-moment
   sketches. Dynamic programming picks thresholds with the fewest candidates and probes whose joint chance of missing a pair
   right at the similarity threshold stays under `miss`. By the pigeonhole principle a pair that differs in no more than
   sum(t + 1) - 1 positions is always found, and the chance of a miss falls fast above the threshold.
4. Probes are all ways of leaving t symbols out; partitions go in rounds, so that only one round's probes are on disk. Pairs of
   classes that share a probe are compared by 128-bit sketches where they meet, before they are written; then by a byte
   of each symbol, and what is left, hardly more than the result, by the exact sets of substrings.
   Classes of probes that more than HOT share (boilerplate) are paired otherwise: two that agree on at least m of all symbols
   share one of their POSITIONS - m + 1 rarest, so only these are joined, and boilerplate symbols, being frequent, come last.

Defined results: NULL keys and texts, and texts shorter than `least` characters, take part in nothing; texts of any length
are read whole; rows that share a key are versions of one record, which matches where any version does, but never with itself; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.llm.grams import grams, mix, squeezed
from evidentia.session import cut, drop, release, small, spread

PARTITION, PARTITIONS = 7, 24
POSITIONS = PARTITION * PARTITIONS
#: Thresholds that a partition may get, besides -1.
THRESHOLDS = (0, 1, 2)
#: Bits of each symbol whose correlation is measured, counters of a sketch, and what a probe costs in candidate pairs.
BITS, COUNTERS, PROBE_COST = 4, 1024, 0.15
#: The 128-bit sketches may differ in this many bits: at similarity 0.7 they do in 19 on average, with deviation 4.
SKETCH_BITS = 35

#: Probes that one task counts, about; probes of a round, and pairs whose symbols are compared at once, where there are more.
PROBES_A_TASK = 500_000
ROUND, PAIRS = 40_000_000, 4_000_000
#: Classes that may share a probe before its pairs are sought by their rarest symbols instead.
HOT = 1_000

_EMPTY = np.uint32(0xFFFFFFFF)


def shingles(text: str, n: int) -> np.ndarray:
    """The set of n-character substrings of the squeezed text, as sorted hashes."""
    return np.unique(grams(squeezed(text), n))


def signature(h: np.ndarray) -> np.ndarray:
    """One-permutation hashing: the least hash in each of POSITIONS bins; an empty bin takes over from the next filled one."""
    out = np.full(POSITIONS, _EMPTY)
    bins = ((h >> np.uint64(32)) * np.uint64(POSITIONS)) >> np.uint64(32)
    np.minimum.at(out, bins.astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    empty = out == _EMPTY
    if empty.any() and not empty.all():
        filled = np.flatnonzero(~empty)
        at = np.flatnonzero(empty)
        k = np.searchsorted(filled, at) % len(filled)
        steps = (filled[k] - at) % POSITIONS
        out[at] = (mix(out[filled[k]].astype(np.uint64) + (steps.astype(np.uint64) << np.uint64(40))) >> np.uint64(32)).astype(np.uint32)
    return out


def _salted(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each symbol with its position."""
    with np.errstate(over="ignore"):
        return mix(sigs.astype(np.uint64) + (np.arange(1, POSITIONS + 1, dtype=np.uint64) << np.uint64(33)))


def _signed_docs(df: DataFrame, key: str, text: str, n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Members (k, c) of the classes of equal texts, and each class (c) with signature and sketch."""
    docs = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null").where(F.length("t") >= least))
    kind = dict(docs.dtypes)["k"]

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                bare = squeezed(t)
                c = int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                sig = signature(grams(bare, n))
                bits = np.packbits((mix(sig[:128].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()
                yield k, c, sig.tobytes(), int.from_bytes(bits[:8], "big", signed=True), int.from_bytes(bits[8:], "big", signed=True)

    signed = cut(map_rows(docs, run, f"k {kind}, c long, sig binary, s1 long, s2 long"))
    members = cut(signed.select("k", "c").distinct())
    # Rows of a class have equal texts, so any row's signature is the class's.
    classes = cut(signed.groupBy("c").agg(F.first("sig").alias("sig"), F.first("s1").alias("s1"), F.first("s2").alias("s2")))
    drop(signed)
    release(df.sparkSession)
    return members, classes


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, POSITIONS)


def correlated_partitions(classes: DataFrame) -> list[list[int]]:
    """Positions in partitions of PARTITION, the most correlated together. The sums have a fixed size."""
    width = POSITIONS * BITS

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        gram, total, n = np.zeros((width, width), np.float32), np.zeros(width), 0
        for b in batches:
            m = mix(_matrix(b["sig"]).astype(np.uint64))
            x = np.concatenate([(m >> np.uint64(i)) & np.uint64(1) for i in range(BITS)], axis=1).astype(np.float32)
            gram += x.T @ x
            total += x.sum(axis=0)
            n += len(x)
        if n:
            for i in range(width):
                yield i, np.append(gram[i], [total[i], n]).astype(np.float64).tobytes()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

    rows = map_rows(classes.select("sig"), run, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").collect()
    left = list(range(POSITIONS))
    if not rows:
        return [left[i : i + PARTITION] for i in range(0, POSITIONS, PARTITION)]
    table = np.zeros((width, width + 2))
    for i, v in rows:
        table[i] = np.frombuffer(v)
    n, mean = table[0, -1], table[:, -2] / table[0, -1]
    cov = table[:, :width] / n - np.outer(mean, mean)
    spread_ = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    c2 = (cov / np.outer(spread_, spread_)) ** 2
    by_position = c2.reshape(BITS, POSITIONS, BITS, POSITIONS).sum(axis=(0, 2))
    out = []
    while left:
        part = [max(left, key=lambda p: (by_position[p, left].sum() - by_position[p, p], -p))]
        left.remove(part[0])
        while left and len(part) < PARTITION:
            nearest = max(left, key=lambda p: (by_position[p, part].sum(), -p))
            part.append(nearest)
            left.remove(nearest)
        out.append(sorted(part))
    return out


def _probes(salted: np.ndarray, part: list[int], t: int) -> Iterator[np.ndarray]:
    """For each way of leaving t symbols of a partition out, a hash of the others for every text."""
    with np.errstate(over="ignore"):
        total = salted[:, part].sum(axis=1, dtype=np.uint64)
        for gone in combinations(part, t):
            rest = total.copy()
            for p in gone:
                rest -= salted[:, p]
            yield mix(rest)


def candidate_estimates(classes: DataFrame, parts: list[list[int]]) -> tuple[np.ndarray, int]:
    """Estimated pairs that agree on a probe, by partition and threshold; and the number of classes."""
    shape = len(parts), len(THRESHOLDS)

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        n = 0
        for b in batches:
            salted = _salted(_matrix(b["sig"]))
            n += len(salted)
            for i, part in enumerate(parts):
                for j, t in enumerate(THRESHOLDS):
                    for q, h in enumerate(_probes(salted, part, t)):
                        at = (h & np.uint64(COUNTERS - 1)).astype(np.int64)
                        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
                        sums[i, j, q] = sums.get((i, j, q), 0) + np.bincount(at, sign, COUNTERS)
        if n:
            yield -1, 0, 0, n, b""
            for (i, j, q), v in sums.items():
                yield i, j, q, 0, v.astype(np.float32).tobytes()

    def square(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"i": [-1], "j": [0], "v": [float(pdf["n"].sum())]})
        total = sum(np.frombuffer(v, np.float32).astype(np.float64) for v in pdf["v"])
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "v": [float((total**2).sum())]})

    rows = map_rows(classes.select("sig"), run, "i int, j int, q int, n long, v binary").groupBy("i", "j", "q").applyInPandas(square, "i int, j int, v double").collect()
    n = next((int(v) for i, _, v in rows if i < 0), 0)
    out = np.zeros(shape)
    for i, j, v in rows:
        if i >= 0:
            out[i, j] += max(0.0, (v - n) / 2)
    return out, n


def binomial_tail(n: int, p: float, t: int) -> float:
    """The chance of at most t in n."""
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(t + 1))


def allocate(estimates: np.ndarray, n: int, similarity: float, miss: float, grain: float = 0.02) -> list[int]:
    """The threshold of each partition (-1: none), by dynamic programming over the log-chance of a miss."""
    from math import log

    need = int(np.ceil(-log(miss) / grain))
    options = [(-1, 0, 0.0)]
    options += [(t, int(-log(1 - binomial_tail(PARTITION, 1 - similarity, t)) / grain), comb(PARTITION, t)) for t in THRESHOLDS]
    best, back = np.full(need + 1, np.inf), []
    best[0] = 0
    for row in estimates:
        new, choice = np.full(need + 1, np.inf), np.full((need + 1, 2), -1)
        for j, (t, gain, probes) in enumerate(options):
            cost = 0.0 if t < 0 else row[j - 1] + PROBE_COST * n * probes
            for have in np.flatnonzero(np.isfinite(best)):
                to = min(need, have + gain)
                if best[have] + cost < new[to]:
                    new[to], choice[to] = best[have] + cost, (t, have)
        best = new
        back.append(choice)
    if not np.isfinite(best[need]):
        warnings.warn(f"no thresholds keep the chance of a miss at similarity {similarity} under {miss}; the widest are used", stacklevel=2)
        return [max(THRESHOLDS)] * len(estimates)
    out, at = [], need
    for choice in reversed(back):
        t, at = choice[at]
        out.append(int(t))
    return out[::-1]


def least_agreement(similarity: float, miss: float) -> int:
    """Symbols that two texts at the similarity agree on at least, but for the chance of a miss."""
    return next(m for m in range(POSITIONS, -1, -1) if m == 0 or binomial_tail(POSITIONS, similarity, m - 1) <= miss)


def _hot_pairs(classes: DataFrame, hot: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Pairs of hot classes that share one of their rarest symbols, by the pigeonhole principle over whole signatures."""
    from pyspark.sql import Window
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                salted = _salted(_matrix(b.column(1).to_pylist()))
                for p in range(POSITIONS):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(salted[:, p].view(np.int64))], names=["c", "symbol"])

    symbols = cut(classes.join(small(hot), "c", "left_semi").select("c", "sig").mapInArrow(run, StructType.fromDDL("c long, symbol long")))
    counts = symbols.groupBy("symbol").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("c").orderBy("n", "symbol")  # a group is one signature
    prefix = symbols.join(counts, "symbol").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= POSITIONS - least_agreement(similarity, miss) + 1)
    shared = cut(prefix.where("n > 1").select("c", "symbol").join(classes.select("c", "s1", "s2"), "c"))
    return _met(shared, "symbol")


def _met(rows: DataFrame, by: str) -> DataFrame:
    """Pairs of rows (c, s1, s2) that have a column in common and whose sketches are close; no other pair leaves its task."""
    near = F.expr(f"x.{by} = y.{by} and x.c < y.c and bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {SKETCH_BITS}")
    return rows.alias("x").join(rows.alias("y"), near).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def _all_probes(salted: np.ndarray, parts: list[list[int]], thresholds: list[int]) -> Iterator[np.ndarray]:
    for part, t in zip(parts, thresholds, strict=True):
        if t >= 0:
            yield from _probes(salted, part, t)


def _shared_probes(classes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """probe, n of the probes that more than one class has. A batch sends one row a probe, so a crowd meets pre-counted;
    the tasks are as many as the probes need, whatever their number. n is NULL in the many rows of one class."""
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for h in _all_probes(_salted(_matrix(b.column(0).to_pylist())), parts, thresholds):
                g, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n, mask=n == 1)], names=["probe", "n"])

    tasks = max(1, -(-classes.count() * sum(comb(PARTITION, t) for t in thresholds if t >= 0) // PROBES_A_TASK))
    rows = classes.select("sig").mapInArrow(run, StructType.fromDDL("probe long, n long")).repartition(tasks, "probe")
    return rows.groupBy("probe").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n")).where("n > 1")


#: Words of 64 bits in the bit map that lets probes through which others share: 4 MB, whatever the corpus.
WORDS = 1 << 19


def _bit_map(probes: DataFrame) -> np.ndarray:
    """A bit map of probes. It may let others through, which the join after it drops; it has a fixed size."""
    word, bit = F.expr(f"cast(shiftrightunsigned(probe, 6) & {WORDS - 1} as int)"), F.expr("shiftleft(1L, cast(probe & 63 as int))")
    out = np.zeros(WORDS, np.uint64)
    for w, bits in probes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b")).collect():  # WORDS rows at most
        out[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _round(classes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of classes that share a probe of these partitions and whose sketches are close; classes of crowded probes, if any."""
    from pyspark.sql.types import StructType

    def probes(wanted: DataFrame) -> DataFrame:
        """probe, c and sketch of the wanted probes."""
        passing = classes.sparkSession.sparkContext.broadcast(_bit_map(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = passing.value
            for b in batches:
                if b.num_rows:
                    own = [b.column(i).to_numpy() for i in (0, 2, 3)]
                    for h in _all_probes(_salted(_matrix(b.column(1).to_pylist())), parts, thresholds):
                        on = (bits[(h >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0
                        if on.any():
                            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), *(pa.array(x[on]) for x in own)], names=["probe", "c", "s1", "s2"])

        return classes.select("c", "sig", "s1", "s2").mapInArrow(run, StructType.fromDDL("probe long, c long, s1 long, s2 long")).join(wanted, "probe", "left_semi")

    shared, hot = cut(_shared_probes(classes, parts, thresholds)), None
    if not shared.where(F.col("n") > HOT).isEmpty():
        hot = cut(probes(cut(shared.where(F.col("n") > HOT).select("probe"))).select("c").distinct())
    again = cut(probes(cut(shared.where(F.col("n") <= HOT).select("probe"))))
    close = cut(_met(again, "probe").distinct())
    drop(shared, again)
    release(classes.sparkSession)
    return close, hot


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _candidates(classes: DataFrame, parts: list[list[int]], thresholds: list[int], similarity: float, miss: float) -> DataFrame:
    """Pairs of classes that share a probe and whose sketches and symbols are close."""
    from pyspark.sql.types import StructType

    used = sorted(((t, part) for part, t in zip(parts, thresholds, strict=True) if t >= 0), reverse=True)
    total = classes.count() * sum(comb(PARTITION, t) for t, _ in used)
    rounds = max(1, min(len(used), -(-total // ROUND)))
    each = [_round(classes, [part for _, part in used[i::rounds]], [t for t, _ in used[i::rounds]]) for i in range(rounds)]
    near = [pairs for pairs, _ in each]
    if hot := [c for _, c in each if c is not None]:
        near.append(_hot_pairs(classes, cut(_union(hot).distinct()), similarity, miss))
    close = cut(_union(near).distinct())
    least = least_agreement(similarity, miss / 10)

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                byte = (_matrix(b.column(1).to_pylist()) & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in byte], pa.binary())], names=["c", "sig"])

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    # Equal symbols have equal bytes, so no pair is lost; one symbol in 256 agrees by chance.
    ids = cut(close.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    wanted = cut(classes.select("c", "sig").mapInArrow(low, StructType.fromDDL("c long, sig binary")).join(small(ids), "c", "left_semi"))
    release(classes.sparkSession)
    sig = lambda x: wanted.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}"))
    rounds, out = max(1, -(-close.count() // PAIRS)), []
    for i in range(rounds):
        own = close.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i)
        both = own.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
        out.append(cut(both.mapInArrow(agree, StructType.fromDDL("a long, b long"))))
        del own, both
        release(classes.sparkSession)
    return _union(out)


def _passing(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts (k, t) of the chosen keys (k); others are dropped by a bit map first, so that the join moves few of them."""
    passing = texts.sparkSession.sparkContext.broadcast(_bit_map(chosen.select(F.xxhash64("k").alias("probe"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passing.value
        for b in batches:
            if b.num_rows:
                h = b.column(2).to_numpy().view(np.uint64)
                on = (bits[(h >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0
                yield b.select(["k", "t"]).filter(pa.array(on))

    return texts.withColumn("h", F.xxhash64("k")).mapInArrow(run, texts.schema).join(chosen, "k", "left_semi")


def similar_classes(df: DataFrame, key: str = "article_id", text: str = "text", n: int = 8, similarity: float = 0.7, least: int = 400, miss: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Members (k, c) and the pairs of classes (a, b, similarity) at or above the threshold, verified on the whole texts."""
    members, classes = _signed_docs(df, key, text, n, least)
    parts = correlated_partitions(classes)
    estimates, count = candidate_estimates(classes, parts)
    pairs = _candidates(classes, parts, allocate(estimates, max(1, count), similarity, miss), similarity, miss)
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
    chosen = cut(members.join(wanted, "c", "left_semi").groupBy("c").agg(F.min("k").alias("k")).select("k").distinct())
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null").where(F.length("t") >= least)

    def fold(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for t in b["t"]:
                bare = squeezed(t)
                yield int.from_bytes(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), bare

    # A key may have several versions: the class is taken anew from the text.
    bodies = map_rows(_passing(texts, chosen).select("t"), fold, "c long, t string")
    bodies = cut(bodies.join(wanted, "c", "left_semi").dropDuplicates(["c"]))
    release(df.sparkSession)
    both = pairs.join(bodies.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a").join(bodies.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b")

    def verify(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            kept: dict[int, np.ndarray] = {}
            for x, y, tx, ty in zip(b["a"], b["b"], b["ta"], b["tb"], strict=True):
                for c, t in ((x, tx), (y, ty)):
                    if c not in kept:
                        kept[c] = np.unique(grams(t, n))
                u, v = kept[x], kept[y]
                common = len(np.intersect1d(u, v, assume_unique=True))
                if len(u) and common >= similarity * (len(u) + len(v) - common):
                    yield x, y, common / (len(u) + len(v) - common)

    return members, map_rows(both, verify, "a long, b long, similarity double")


def near_duplicate_pairs(df: DataFrame, key: str = "article_id", text: str = "text", **how) -> DataFrame:
    """key_a < key_b for every pair of different keys with near-duplicate texts, copies expanded."""
    members, pairs = similar_classes(df, key, text, **how)
    across = pairs.select("a", "b").join(members.select(F.col("c").alias("a"), F.col("k").alias("x")), "a").join(members.select(F.col("c").alias("b"), F.col("k").alias("y")), "b").select("x", "y")
    within = members.alias("m").join(members.alias("o"), F.expr("m.c = o.c and m.k < o.k")).select(F.col("m.k").alias("x"), F.col("o.k").alias("y"))
    both = across.where("x <> y").unionByName(within)
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "article_id", text: str = "text", **how) -> DataFrame:
    """key, group_id and links for every record with a near-duplicate: links are its class's links to other classes."""
    from evidentia.operators.components import components

    members, pairs = similar_classes(df, key, text, **how)
    pairs = cut(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    roots = components(pairs, "a", "b").select(F.col("node").alias("c"), F.col("component").alias("g"))
    grouped = members.join(roots, "c", "left").join(links, "c", "left").select("k", F.coalesce("g", "c").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    per = grouped.groupBy("k", "g").agg(F.sum("links").alias("links"))
    sizes = per.groupBy("g").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1")
    return per.join(sizes, "g").select(F.col("k").alias(key), F.col("first").alias("group_id"), F.col("n").alias("group_size"), "links")
