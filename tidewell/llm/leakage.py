"""Evaluation texts that leak into documents.

The test items are the indexed side: an inverted index with BM25 weights over
their words. Every run of N successive words of every document is a query
against it. Weights are divided by the item's own threshold, so that an item is
retrieved at a score of 1 or more. An item's threshold is the lowest score that
any of its own passages of N words has against it; a document that holds such a
passage therefore always retrieves the item.

The search skips as block-max WAND does, for many runs at once. The upper bound
of a word, over all items, lets most runs be skipped by one running sum. Of the
others, words in order of rising bound are passed over while their bounds together
don't reach the threshold; the blocks in the posting lists of the rest are the
candidates. The largest weights by posting list and block tell which of them can
reach it; only those are scored. What is retrieved is verified: the N words must be
those of a passage of the item, in order, and of no other item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.cut import written

WORDS = 10
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
BLOCK = 16
#: Characters of the items' texts in one index, about; bytes of the indexes that are sent to all executors for one pass over the documents.
MAX_ITEM_CHARS = 4_000_000
MAX_INDEX_BYTES = 256 << 20
#: Entries of posting lists that are looked at together.
MAX_ENTRIES = 4_000_000
#: Groups of items by their thresholds, each half of the one before.
TIERS = 4
_WORD = re.compile(r"[^\W_]+")
_BATCH_WORDS = 2_000_000
_ALMOST = 1 - 1e-9  # of sums in another order


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits, without regard to case."""
    return _WORD.findall(text.lower())


def _windows(c: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(c, n) if len(c) >= n else np.empty((0, n), c.dtype)


def _hash(rows: np.ndarray) -> np.ndarray:
    """Of each row, in order of its words. What has the same hash is compared."""
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            h = (h ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first..last - 1, one after the other, and which range each belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of], of


class _Lists:
    """Posting lists: word, then place of the item, in blocks of BLOCK places; entries: word, then block, with the block's largest weight."""

    def __init__(self, item: np.ndarray, word: np.ndarray, weight: np.ndarray, words: int, n: int) -> None:
        self.n = n
        self.places = np.unique(item)
        item = np.searchsorted(self.places, item)
        order = np.lexsort((item, word))
        item, word, self.weight = item[order], word[order], weight[order]
        self.blocks = -(-len(self.places) // BLOCK)
        entry = word * self.blocks + item // BLOCK
        start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        self.entry = np.r_[entry[start], np.iinfo(np.int64).max]  # one that is never met ends the search
        self.most = np.r_[np.maximum.reduceat(self.weight, start), 0.0]
        self.post = np.r_[start, len(entry), len(entry)]
        self.item = (item % BLOCK).astype(np.int8)
        self.list = np.searchsorted(self.entry, np.arange(words + 1) * self.blocks)
        self.upper = np.zeros(words)
        np.maximum.at(self.upper, word, self.weight)

    def _find(self, word: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of words in blocks; whether there is one."""
        key = word * self.blocks + block
        at = np.searchsorted(self.entry, key)
        return at, self.entry[at] == key

    def retrieve(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (run, place of an item) with a score of 1 or more. runs: codes of n words in each row."""
        words = np.sort(runs, axis=1)
        words[:, 1:][words[:, 1:] == words[:, :-1]] = 0  # a word counts once
        bound = self.upper[words]
        order = np.argsort(bound, axis=1)
        words, bound = np.take_along_axis(words, order, 1), np.take_along_axis(bound, order, 1)
        pivots = (np.cumsum(bound, axis=1) >= _ALMOST) & (bound > 0)
        r, j = np.nonzero(pivots)
        w = words[r, j]
        length = self.list[w + 1] - self.list[w]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.flatnonzero(np.diff(np.cumsum(length) // MAX_ENTRIES, prepend=0)) if len(length) else ()
        edges = [0, *sorted({int(np.searchsorted(r, r[c])) for c in cuts} - {0}), len(r)]
        for a, b in zip(edges, edges[1:]):
            at, of = _ranges(self.list[w[a:b]], self.list[w[a:b] + 1])
            pair = np.unique(r[a:b][of] * self.blocks + self.entry[at] % self.blocks)
            run, block = pair // self.blocks, pair % self.blocks
            most = np.zeros(len(pair))
            for j in range(self.n):
                at, there = self._find(words[run, j], block)
                most += np.where(there, self.most[at], 0.0)
            run, block = run[most >= _ALMOST], block[most >= _ALMOST]
            score = np.zeros(len(run) * BLOCK)
            for j in range(self.n):
                at, there = self._find(words[run, j], block)
                place = np.flatnonzero(there)
                posts, of = _ranges(self.post[at[place]], self.post[at[place] + 1])
                score[place[of] * BLOCK + self.item[posts]] += self.weight[posts]  # an item is once in a list
            hit = np.flatnonzero(score >= _ALMOST)
            out.append((run[hit // BLOCK], self.places[block[hit // BLOCK] * BLOCK + hit % BLOCK]))
        return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))

class ItemIndex:
    """BM25 index of items: weight[item, word] / threshold[item]. shared: passages (words with blanks between) that occur in other indexes' items as well."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS, shared: set[str] | frozenset[str] = frozenset()) -> None:
        self.n = n
        texts = [words_of(t) for _, t in items]
        self.word = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 1)}  # 0: not in any item
        size, k = np.array([len(t) for t in texts], np.int64), len(items)
        codes = np.fromiter((self.word[w] for t in texts for w in t), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        # Where a passage begins, and of which item it is.
        count = np.maximum(size - n + 1, 0)
        at, owner = _ranges(first, first + count)
        rows = codes[at[:, None] + np.arange(n)] if len(at) else np.empty((0, n), np.int64)
        keys = _hash(rows)
        order = np.lexsort((owner, keys))
        at, owner, keys, rows = at[order], owner[order], keys[order], rows[order]
        # Wording of several items counts for none; copies of an item share all.
        alone = np.ones(len(at), bool)
        group = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(at) else np.empty(0, np.int64)
        ends = np.r_[group[1:], len(at)]
        for a, b in zip(group[ends - group > 1], ends[ends - group > 1]):
            holders: dict[bytes, set[int]] = {}
            for x in range(a, b):
                holders.setdefault(rows[x].tobytes(), set()).add(int(owner[x]))
            for x in range(a, b):
                alone[x] = len(holders[rows[x].tobytes()]) == 1
        if shared:
            names = [""] + list(self.word)
            alone &= np.fromiter((" ".join(names[w] for w in r) not in shared for r in rows.tolist()), bool, len(rows))
        at, owner, keys, rows = at[alone], owner[alone], keys[alone], rows[alone]
        # Weights by (item, word), sorted.
        v = len(self.word) + 1
        pairs, tf = np.unique(np.repeat(np.arange(k), size) * v + codes, return_counts=True)
        df = np.bincount(pairs % v, minlength=v)
        idf = np.log1p((k - df + 0.5) / (df + 0.5))
        mean = max(1.0, float(size.mean())) if k else 1.0
        weight = idf[pairs % v] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[pairs // v] / mean))
        own = np.sort(rows, axis=1)
        new = np.c_[np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]]
        score = (weight[np.searchsorted(pairs, owner[:, None] * v + own)] * new).sum(axis=1) if len(own) else np.empty(0)
        lowest = np.full(k, np.inf)
        np.minimum.at(lowest, owner, score)
        kept = np.flatnonzero(np.isfinite(lowest) & (lowest > 0))
        kept = kept[np.argsort(size[kept], kind="stable")]
        place = np.full(k, -1)
        place[kept] = np.arange(len(kept))
        self.ids = np.array([items[i][0] for i in kept], np.int64)
        ok = place[owner] >= 0
        self.keys, self.rows, self.owner = keys[ok], rows[ok].astype(np.int32), place[owner[ok]].astype(np.int32)
        some = place[pairs // v] >= 0
        item, word, weight = place[pairs[some] // v], pairs[some] % v, weight[some] / lowest[pairs[some] // v]
        # Bounds are those of the items with the lowest thresholds, so items whose thresholds differ much have lists of their own.
        tier = np.clip(np.floor(np.log2(lowest[kept] / lowest[kept].max())), -TIERS + 1, 0) if len(kept) else np.empty(0)
        self.tiers = [_Lists(item[own], word[own], weight[own], v, n) for t in np.unique(tier) for own in [tier[item] == t]]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for part in (self, *self.tiers) for x in vars(part).values() if isinstance(x, np.ndarray)) + 100 * len(self.word)

    def passages(self, runs: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each run is a passage of that item, and of no other."""
        keys = _hash(runs)
        at, last = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        ok = np.zeros(len(runs), bool)
        while (left := np.flatnonzero((at < last) & ~ok)).size:
            ok[left] = (self.owner[at[left]] == place[left]) & (self.rows[at[left]] == runs[left]).all(axis=1)
            at[left] += 1
        return ok

    def search(self, words: list[str]) -> set[int]:
        """Ids of the items of which `words` holds a passage."""
        return set(self.search_many([words])[0])

    def search_many(self, texts: list[list[str] | None]) -> list[list[int]]:
        """For each text, given by its words, the ids of its items. Runs are looked for in many texts at once, as most have none."""
        get, n = self.word.get, self.n
        out: list[set[int]] = [set() for _ in texts]
        codes, ends, group = [], [], []

        def flush() -> None:
            # n words of no item between two texts: no run that goes over an end is a passage.
            c = np.array(codes, np.int64)
            for lists in self.tiers if len(c) >= n else ():
                hot = np.flatnonzero(_sums(lists.upper[c], n) >= _ALMOST)
                runs = c[hot[:, None] + np.arange(n)]
                run, place = lists.retrieve(runs)
                good = self.passages(runs[run], place)
                text = np.searchsorted(np.array(ends), hot[run[good]], side="right")
                for k, i in zip(text.tolist(), self.ids[place[good]].tolist()):
                    out[group[k]].add(i)
            codes.clear(), ends.clear(), group.clear()

        gap = [0] * n
        for i, words in enumerate(texts):
            if words:
                codes.extend([get(w, 0) for w in words])
                codes.extend(gap)
                ends.append(len(codes))
                group.append(i)
                if len(codes) >= _BATCH_WORDS:
                    flush()
        flush()
        return [sorted(x) for x in out]


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of n successive values, without the rounding of one long running sum."""
    k = len(x) - n + 1
    total = x[:k].copy()
    for j in range(1, n):
        total += x[j:j + k]
    return total


def _indexes(own: DataFrame, words: int) -> Iterator[ItemIndex]:
    """Indexes of about MAX_ITEM_CHARS characters of items each, so that the driver builds one at a time; the texts of one id are in one of them."""
    size = own.agg(F.sum(F.length("t")), F.count(F.lit(1))).first()
    parts = max(1, min(-(-(size[0] or 0) // MAX_ITEM_CHARS), size[1]))
    if parts == 1:
        yield ItemIndex([tuple(r) for r in own.orderBy("i", "t").collect()], words)
        return

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, p = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                own = {" ".join(w[j:j + words]) for j in range(len(w) - words + 1)}
                p.extend(own)
                part.extend([k] * len(own))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "p": pa.array(p, pa.string())})

    own = own.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    # Wording of items in different indexes; what items of one index share, it sees itself.
    many = (own.select("part", "t").mapInArrow(passages, "part int, p string").distinct().groupBy("p").agg(F.collect_set("part").alias("parts"))
            .where(F.size("parts") > 1).select(F.explode("parts").alias("part"), "p"))
    many = written(many, "shared-wording")
    for k in range(parts):
        items = [tuple(r) for r in own.where(F.col("part") == k).orderBy("i", "t").select("i", "t").collect()]
        if items:
            yield ItemIndex(items, words, {r[0] for r in many.where(F.col("part") == k).select("p").collect()})


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
               item_text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, item_id (longs): the document's text holds at least `words` successive words of the item's, other than wording
    that occurs in more than one item.

    One row for each row of documents and item. Null texts, and texts of fewer than `words` words, hold and are found nowhere. Rows
    of items with the same id and text are one item; several texts under one id are items of their own that share the id, and a
    row is given once.

    No row is moved: indexes of bounded size go to the documents, those of at most MAX_INDEX_BYTES bytes together in one pass
    over them; more items take more passes.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    own = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    passes: list[list] = [[]]
    room = MAX_INDEX_BYTES
    for index in _indexes(own, words):
        if index.nbytes > room and passes[-1]:
            passes.append([])
            room = MAX_INDEX_BYTES
        room -= index.nbytes
        passes[-1].append(spark.sparkContext.broadcast(index))

    def scan_with(indexes: list):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [words_of(t) if t else None for t in b.column(1).to_pylist()]
                found: list[set[int]] = [set() for _ in texts]
                for index in indexes:
                    for own, more in zip(found, index.value.search_many(texts)):
                        own.update(more)
                ids = b.column(0).to_pylist()
                docs = [ids[k] for k, f in enumerate(found) for _ in f]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "item_id": pa.array([i for f in found for i in sorted(f)], pa.int64())})
        return scan

    out = [documents.mapInArrow(scan_with(p), "doc_id long, item_id long") for p in passes]
    return reduce(DataFrame.unionByName, out)
