"""Filling fixed-capacity containers with texts, measured in tokens.

Best-fit decreasing: texts in order of falling size, each into the open
container with the least room that still holds it. A segment tree over the
possible remaining capacities finds that container in steps logarithmic in the
capacity, however many containers are open.

Every input split fills its own containers, so no text is moved. A split's
texts are counted in windows of bounded size and put by in a compressed file of
Spark's local folder; only their sizes are held. These are sorted for the whole
split and get their containers, with which the file is then read back.
"""

from __future__ import annotations

import base64
import os
import tempfile
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
WINDOW_DOCS, WINDOW_CHARS = 50_000, 32_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary wants text to be split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def token_counter(path: str, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts, for a vocabulary of tiktoken (.tiktoken), tokenizers (.json) or sentencepiece (.model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary: {path}")


class OpenContainers:
    """Containers by remaining capacity, with a segment tree that tells which capacities occur."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, there: int) -> None:
        i = self.width + room
        self.any[i] = there
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                return
            self.any[i] = now

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open container that is at least `size`."""
        i, tree = self.width + size, self.any
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:  # a left child: what is right of it is larger
                i += 1
                while i < self.width:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None

    def put(self, size: int) -> int:
        """The container that takes an item of this size."""
        room = self.tightest(size)
        if room is None:
            container, room = self.made, self.capacity
            self.made += 1
        else:
            container = self.at[room].pop()
            if not self.at[room]:
                self._set(room, 0)
        left = room - size
        self.at[left].append(container)
        if len(self.at[left]) == 1:
            self._set(left, 1)
        return container


def split_text(text: str, total: int, capacity: int, count: Callable[[list[str]], list[int]]) -> list[tuple[int, int, int]]:
    """(from, to, tokens) of the pieces of a text of `total` tokens that exceeds the capacity: each the longest that a search
    by tokens per character finds to fit, short of a hundredth of the capacity."""
    out, a = [], 0
    per = len(text) / total  # characters to a token
    while a < len(text):
        fits, size, over = 0, 0, len(text) - a + 1  # so many characters fit, so many don't
        guess = min(over - 1, max(1, int(capacity * per)))
        for _ in range(64):
            k = count([text[a:a + guess]])[0]
            if k <= capacity:
                fits, size = guess, k
            else:
                over = guess
            if over - fits <= 1 or (fits and size >= capacity * 0.99):
                break
            near = guess + int((capacity - k) * guess / max(k, 1) * 0.998) if k else over - 1
            guess = near if fits < near < over else (fits + over) // 2
        if not fits:
            raise ValueError(f"a container of {capacity} tokens can't hold one character")
        out.append((a, a + fits, size))
        a += fits
    return out


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size, best-fit decreasing; of equal sizes the first comes first. -1 for negative sizes."""
    bins, where = OpenContainers(capacity), np.full(len(sizes), -1, np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        if sizes[k] < 0:
            break
        where[k] = bins.put(int(sizes[k]))
    return where


_COUNTED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])

_OUT = "container long, doc_id long, piece int, n_pieces int, n_tokens int, text string"


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text, in one container: container, doc_id, piece (from 0), n_pieces, n_tokens, text (of the piece).

    A text is split only if it alone exceeds `capacity` tokens; its pieces, joined in order, are the text. The tokens of a
    container's pieces add up to at most `capacity`. An empty text is a piece of no tokens in some container. A null text has no
    container (null) and no tokens. Rows with the same doc_id, or a null one, are texts of their own. `tokenizer` is a vocabulary
    file that every executor can read.

    Containers are filled within input splits; the order of rows in a split decides between equal sizes.
    """
    if capacity < 16:
        raise ValueError("the capacity must be at least 16 tokens")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        held = array("i")  # tokens of the pieces in the file, -1 for a null text

        def counted(ids: list, texts: list) -> pa.RecordBatch:
            here = [t for t in texts if t is not None]
            sizes = iter(count(here))
            items = []
            for i, t in zip(ids, texts):
                n = None if t is None else next(sizes)
                if n is None or n <= capacity:
                    items.append((i, 0, 1, n or 0, t))
                else:
                    parts = split_text(t, n, capacity, count)
                    items += [(i, j, len(parts), k, t[a:b]) for j, (a, b, k) in enumerate(parts)]
            held.extend(-1 if x[4] is None else x[3] for x in items)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*items), _COUNTED)], schema=_COUNTED)

        def windows() -> Iterator[pa.RecordBatch]:
            ids, texts, chars = [], [], 0
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    chars += len(t or "")
                    if len(ids) >= WINDOW_DOCS or chars >= WINDOW_CHARS:
                        yield counted(ids, texts)
                        ids, texts, chars = [], [], 0
            if ids:
                yield counted(ids, texts)

        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.NamedTemporaryFile(dir=local, prefix="texts-") as file:
            with pa.ipc.new_stream(file, _COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for w in windows():
                    out.write_batch(w)
            where, at = assign(np.array(held, np.int32), capacity), 0
            file.seek(0)
            with pa.ipc.open_stream(file) as stored:
                for w in stored:
                    own = where[at:at + w.num_rows]
                    at += w.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(base + own, pa.int64(), mask=own < 0), *w.columns], names=["container", *_COUNTED.names])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(fill, _OUT)
