"""Held-out test items that leaked into a corpus, found by latent semantic retrieval.

1. Texts are folded to lower-case letters and digits and cut into 6-grams. The features are the grams of the held-out
   items: no other gram can add to a cosine with an item. One pass over the corpus keeps each document's feature hits.
2. Passages are windows of 60 folded characters. Their TF-IDF vectors are hashed to a fixed width, and a distributed
   randomised SVD (range finder, one power step, Rayleigh-Ritz) gives the latent space.
3. Each document passage is compared by cosine with all item passages, a stated set, block by block.
4. Candidates are checked: longest common run, longest common subsequence and how much of the item's last
   sentence, its answer, the document holds. A long run is a verbatim leak; a high subsequence share with the
   answer present is a paraphrase.

Defined results: NULL or empty texts and items leak nothing; documents that share an id count as one, with their
best figures; an empty corpus or item table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.llm.grams import GramTable, grams, mix
from evidentia.session import cut, spread

N, WINDOW, STRIDE, ITEM_STRIDE = 6, 60, 20, 10
#: Width of the hashed vectors, rank of the latent space, and extra columns of the range finder.
WIDTH, RANK, EXTRA = 4096, 96, 16
#: Items that one index holds; more are worked off block by block.
BLOCK = 5_000

_REST = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[^.。!！?？]+[.。!！?？]*")


def fold(text: str) -> str:
    return _REST.sub("", text).lower()


class ItemIndex:
    """The items of one block: their grams, passages and answers."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        hashes = [grams(fold(t), N) for _, t in items]
        self.table = GramTable(np.concatenate([np.empty(0, np.uint64), *hashes]), 21)
        self.seqs = [np.searchsorted(self.table.keys, h) for h in hashes]
        answers = [(_SENTENCE.findall(t) or [""])[-1] for _, t in items]
        self.answers = [np.unique(np.searchsorted(self.table.keys, grams(fold(a), N))) for a in answers]
        h = mix(self.table.keys + np.uint64(17))
        self.bucket = (h % np.uint64(WIDTH)).astype(np.int64)
        self.sign = np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)
        self.idf = np.ones(len(self.table.keys), np.float32)

    def vectors(self, at: np.ndarray, ids: np.ndarray, stride: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and dense hashed TF-IDF vector of each window that holds at least `least` hits."""
        if not len(at):
            return np.empty(0, np.int64), np.empty((0, WIDTH), np.float32)
        starts = np.unique(np.concatenate([at // stride - j for j in range(-(-(WINDOW - N + 1) // stride))]))
        starts = starts[starts >= 0] * stride
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + WINDOW - N + 1)
        keep = hi - lo >= least
        starts, lo, hi = starts[keep], lo[keep], hi[keep]
        out = np.zeros((len(starts), WIDTH), np.float32)
        value = self.sign[ids] * self.idf[ids]
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            np.add.at(out[i], self.bucket[ids[a:b]], value[a:b])
        return starts, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Item number and vector of every item passage."""
        owner, vectors = [], []
        for k, seq in enumerate(self.seqs):
            _, v = self.vectors(np.arange(len(seq)), seq, ITEM_STRIDE, 1)
            owner += [k] * len(v)
            vectors.append(v)
        return np.array(owner, np.int64), np.concatenate([np.empty((0, WIDTH), np.float32), *vectors])


def feature_hits(docs: DataFrame, index: ItemIndex, least: int) -> DataFrame:
    """Documents with at least `least` feature hits: their positions and gram numbers, and the passages that hold each."""
    table = index.table

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                at, ids = table.find(grams(fold(t), N))
                if len(at) >= least:
                    yield k, at.astype("<i4").tobytes(), ids.astype("<i4").tobytes()

    return map_rows(docs, run, f"k {dict(docs.dtypes)['k']}, at binary, ids binary")


def _arrays(at: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(ids, "<i4").astype(np.int64)


def passage_frequencies(hits: DataFrame, index: ItemIndex) -> np.ndarray:
    """In how many documents' hits each gram occurs; as long as the index."""
    size = len(index.table.keys)

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b["ids"]:
                total[np.unique(np.frombuffer(ids, "<i4"))] += 1
        for g in np.flatnonzero(total).tolist():
            yield g, int(total[g])

    df = np.zeros(size, np.int64)
    for g, n in map_rows(hits.select("ids"), run, "g int, n long").groupBy("g").agg(F.sum("n")).collect():
        df[g] = n
    return df


def _gram_product(hits: DataFrame, index: ItemIndex, basis: np.ndarray, least: int) -> np.ndarray:
    """A'A basis for the matrix A of all document and item passages. Tasks send blocks of rows, which are summed by block."""
    rows = 64
    shared = hits.sparkSession.sparkContext.broadcast(basis.astype(np.float32))

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        out = np.zeros(shared.value.shape, np.float32)
        for b in batches:
            for at, ids in zip(b["at"], b["ids"], strict=True):
                _, v = index.vectors(*_arrays(at, ids), WINDOW, least)
                if len(v):
                    out += v.T @ (v @ shared.value)
        if out.any():
            for i in range(0, WIDTH, rows):
                yield i, out[i : i + rows].tobytes()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32) for x in pdf["v"])
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "v": [total.astype(np.float32).tobytes()]})

    _, items = index.passages()
    product = items.T @ (items @ basis.astype(np.float32))
    for i, v in map_rows(hits.select("at", "ids"), run, "i int, v binary").groupBy("i").applyInPandas(add, "i int, v binary").collect():
        product[i : i + rows] += np.frombuffer(v, np.float32).reshape(-1, basis.shape[1])
    return product


def latent_space(hits: DataFrame, index: ItemIndex, least: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of the passage matrix, by a randomised range finder with one power step."""
    start = np.random.default_rng(seed).standard_normal((WIDTH, rank + EXTRA))
    q, _ = np.linalg.qr(_gram_product(hits, index, start, least))
    values, vectors = np.linalg.eigh(q.T @ _gram_product(hits, index, q, least))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def longest_run(at: np.ndarray, ids: np.ndarray, places: dict[int, list[int]]) -> int:
    """Characters of the longest run of grams that follow one another in both texts."""
    best, last, before = 0, -2, {}
    for p, g in zip(at.tolist(), ids.tolist(), strict=True):
        now = {}
        for q in places.get(g, ()):
            now[q] = (before.get(q - 1, 0) if p == last + 1 else 0) + 1
            best = max(best, now[q])
        before, last = now, p
    return best + N - 1 if best else 0


def subsequence(a: list[int], places: dict[int, list[int]]) -> int:
    """Length of the longest common subsequence of gram sequences: longest increasing chain of item positions."""
    from bisect import bisect_left

    tails: list[int] = []
    for g in a:
        for q in reversed(places.get(g, ())):
            k = bisect_left(tails, q)
            tails[k : k + 1] = [q]
    return len(tails)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = 50, cosine: float = 0.3, share: float = 0.5, least: int = 10) -> DataFrame:
    """Document, item, longest common run, shares of item and answer found, and whether it is verbatim or a paraphrase."""
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t <> ''")
    picked = spread(picked)
    kind = dict(picked.dtypes)["k"]
    held = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("i is not null and t <> ''").distinct().orderBy("i", "t")
    found, block = [], []
    for row in held.toLocalIterator():
        block.append((row.i, row.t))
        if len(block) == BLOCK:
            found.append(_block(picked, ItemIndex(block), run, cosine, share, least))
            block = []
    if block:
        found.append(_block(picked, ItemIndex(block), run, cosine, share, least))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, `{item_key}` long, run int, item_share double, answer_share double, leak string")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = out.groupBy("k", "i").agg(F.max(F.struct("run", "item_share", "answer_share", "leak")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("i").alias(item_key), "b.run", "b.item_share", "b.answer_share", "b.leak")


def _block(docs: DataFrame, index: ItemIndex, run: int, cosine: float, share: float, least: int) -> DataFrame:
    hits = cut(feature_hits(docs, index, least))
    df = passage_frequencies(hits, index)
    index.idf = (np.log((df.max(initial=0) + 2) / (df + 1)) + 0.1).astype(np.float32)
    space = latent_space(hits, index, least)
    owner, vectors = index.passages()
    latent = vectors @ space
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    places: list[dict[int, list[int]]] = []
    for seq in index.seqs:
        own: dict[int, list[int]] = defaultdict(list)
        for q, g in enumerate(seq.tolist()):
            own[g].append(q)
        places.append(dict(own))

    def search(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, at, ids in zip(b["k"], b["at"], b["ids"], strict=True):
                at, ids = _arrays(at, ids)
                _, v = index.vectors(at, ids, STRIDE, least)
                if not len(v):
                    continue
                v = v @ space
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = (v @ latent.T).max(axis=0)
                for e in np.unique(owner[best >= cosine]).tolist():
                    length = longest_run(at, ids, places[e])
                    item_share = subsequence(ids.tolist(), places[e]) / max(1, len(index.seqs[e]))
                    answer = index.answers[e]
                    answer_share = float(np.isin(answer, ids).mean()) if len(answer) else 0.0
                    if length >= run or item_share >= share and answer_share >= share:
                        yield k, index.ids[e], length, item_share, answer_share, "verbatim" if length >= run else "paraphrase"

    return map_rows(hits, search, f"k {dict(docs.dtypes)['k']}, i long, run int, item_share double, answer_share double, leak string")
