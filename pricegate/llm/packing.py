"""Bounded-space online packing of tokenised documents into fixed sequences."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Tokens of a sequence, windows that a partition keeps open, and the id that ends a document.
LENGTH, WINDOWS, END = 2048, 64, 1
#: Partitions whose leftover windows are merged in one task.
MERGED = 64
SPECIAL = "<|endoftext|>"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """A function from texts to id lists.

    ``vocabulary`` is a byte-level BPE file of the tokenizers library. If ``ranks`` names the
    same vocabulary as a rank file, tiktoken encodes (equal ids, several times faster) every
    text without the special token, which only the first library knows.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    if not ranks:
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda texts: [whole.encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t) for t in texts]


class Windows:
    """A fixed number of open windows; best fit, and the fullest goes when none fits."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.next = length, most, 0
        self.free: list[tuple[int, int]] = []  # (free tokens, window), in order
        self.closed: list[int] = []

    def place(self, size: int) -> tuple[int, int]:
        """The window and offset that an item of ``size`` tokens gets."""
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            free, window = self.free.pop(k)
        else:
            if len(self.free) == self.most:
                self.closed.append(self.free.pop(0)[1])
            free, window = self.length, self.next
            self.next += 1
        if free > size:
            insort(self.free, (free - size, window))
        else:
            self.closed.append(window)
        return window, self.length - free


def packer(vocabulary: str, ranks: str | None, length: int, windows: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, held = encoder(vocabulary, ranks), TaskContext.get().partitionId(), Windows(length, windows)
        waiting: dict[int, list[tuple]] = {}  # pieces of open windows
        kind = None

        def out(rows: list[tuple], still_open: bool) -> pa.RecordBatch:
            ids, *numbers = zip(*rows, strict=True)
            names = [c.split()[0] for c in PIECES.split(", ")]
            columns = [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in numbers), pa.array([still_open] * len(rows))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

        for b in batches:
            kind = b.column("doc_id").type
            ready: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode([text])[0], end], dtype="<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    window, offset = held.place(len(piece))
                    waiting.setdefault(window, []).append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (part << 33) + window, offset))
                    for w in held.closed:
                        ready += waiting.pop(w)
                    held.closed.clear()
            if ready:
                yield out(ready, False)
        if waiting:
            yield out([row for w in sorted(waiting) for row in waiting[w]], True)

    return run


def _merge(length: int):
    """Leftover windows of some partitions, largest first, each as one item that fits best."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "window"], ascending=[False, True])
        held = Windows(length, len(frame))
        placed = [held.place(int(n)) for n in frame["used"]]
        first: dict[int, int] = {}
        for (w, _), window in zip(placed, frame["window"], strict=True):
            first.setdefault(w, window)
        return pd.DataFrame({"window": frame["window"], "sequence_id": [first[w] for w, _ in placed], "base": [o for _, o in placed]})

    return run


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, text: str = "text", length: int = LENGTH, windows: int = WINDOWS, end: int = END) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: none) and the end id, cut only where a
    sequence is full. Each partition packs its documents as they come, without a shuffle;
    when none of its open windows fits, it gives out the fullest. Windows that are open at
    its end are merged with those of other partitions, a bounded number in one task. Rows
    that repeat, or have a null doc_id, are documents of their own. An empty table gives no
    pieces.
    """
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"
    pieces = stored(texts.mapInArrow(packer(vocabulary, ranks, length, windows, end), schema), "pieces")
    left = pieces.filter("open").groupBy("window").agg(F.sum("length").alias("used"))
    group = F.shiftrightunsigned("window", 33).alias("part")
    merged = left.withColumn("__group", F.floor(group / MERGED)).groupBy("__group").applyInPandas(_merge(length), "window long, sequence_id long, base long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    closed = pieces.filter("not open").select(*columns, F.col("window").alias("sequence_id"), "offset")
    opened = pieces.filter("open").join(stored(merged, "merged"), "window").select(*columns, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return closed.unionByName(opened)
