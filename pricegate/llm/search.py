"""Ranked lexical search over an index that is laid out in windows of documents."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Documents of a window, so that an item's sums (8 bytes each) stay in a core's cache; and term occurrences after which it ends early.
WINDOW, OCCURRENCES = 1 << 14, 4_000_000
#: Results of an item.
BEST = 50
#: Different (item, term) rows that are searched for at a time, and so the most that is sent to every task.
QUERY_ROWS = 500_000
#: Bytes that separate terms become spaces, A-Z become a-z; bytes of characters beyond ASCII belong to terms.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

INDEX = "window long, term binary, slots binary, times binary, lengths binary"


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in turn, repeats included; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Window:
    """Documents in turn; at its end, their postings by term."""

    def __init__(self, number: int):
        self.number, self.ids, self.lengths, self.parts, self.size = number, [], [], [], 0
        self.known: dict[bytes, int] = defaultdict(count().__next__)

    def add(self, doc_id, text: str | None) -> None:
        found = terms(text)
        codes, times = np.unique(np.fromiter(map(self.known.__getitem__, found), np.int64, len(found)), return_counts=True)
        self.parts.append((codes << 32 | len(self.ids), times))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.size += len(found)

    def full(self) -> bool:
        return len(self.ids) == WINDOW or self.size >= OCCURRENCES

    def out(self, kind: pa.DataType) -> pa.RecordBatch:
        """A row for the documents, and one for each term: the slots of documents that hold it, and how often they do."""
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.concatenate([p[1] for p in self.parts])[order]
        edges = np.searchsorted(keys >> 32, np.arange(len(self.known) + 1))
        slots, often = (keys & 0xFFFFFFFF).astype("<u2"), times.astype("<u4")
        n = 1 + len(self.known)
        binary = lambda x: pa.concat_arrays([pa.nulls(1, pa.binary()), pa.Array.from_buffers(pa.binary(), n - 1, [None, pa.py_buffer((edges * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())])])
        columns = [pa.array([self.number] * n, pa.int64()), pa.array([None, *self.known], pa.binary()), binary(slots), binary(often)]
        columns += [pa.array([np.array(self.lengths, "<u4").tobytes(), *[None] * (n - 1)], pa.binary()), pa.array([self.ids, *[None] * (n - 1)], pa.list_(kind))]
        return pa.RecordBatch.from_arrays(columns, ["window", "term", "slots", "times", "lengths", "doc_ids"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done, window, kind = TaskContext.get().partitionId(), 0, None, None
    for b in batches:
        kind = b.column("doc_id").type
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            window = window or Window(part << 32 | done)
            window.add(doc_id, text.as_py())
            if window.full():
                yield window.out(kind)
                window, done = None, done + 1
    if window:
        yield window.out(kind)


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored index of whole texts: for each window of up to WINDOW documents a row with their ids and lengths, and a row for each term.

    A document's number is its window and its slot there, so ids may be sparse, null or
    repeated; each task fills windows of its own, and no text is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_windows, f"{INDEX}, doc_ids array<{kind}>"), "index")


def query_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, term): the different terms of each item; rows that repeat an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(dict.fromkeys(terms(t))) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(b.num_rows), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(at)), pa.array([t for ts in found for t in ts], pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col(text).alias("text")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


class Heap:
    """The best (score, doc_id) of an item so far; of equal scores the lesser doc_id, null last."""

    def __init__(self, best: int):
        self.best, self.held = best, []

    def least(self) -> int:
        return self.held[0][0] if len(self.held) == self.best else 1

    def offer(self, score: int, doc_id) -> None:
        entry = (score, doc_id is not None, 0 if doc_id is None else -doc_id)
        if len(self.held) < self.best:
            heapq.heappush(self.held, entry)
        elif entry > self.held[0]:
            heapq.heapreplace(self.held, entry)


def _search(queries: list[tuple[int, list[int]]], weights: dict[bytes, tuple[int, int]], n_docs: int, n_terms: int, best: int):
    """Traverses the postings of one window after another. ``queries``: (item, numbers of its terms); ``weights``: a term's number and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {item: Heap(best) for item, _ in queries}
        held: dict[int, tuple] = {}
        now = docs = kind = None

        def score() -> None:
            lengths, ids = docs
            m = 50 + (50 * lengths * n_docs) // max(n_terms, 1)
            sums = np.zeros(len(ids), np.int64)
            words = -(-len(ids) // 8)
            bits = {}
            for k, (weight, slots, times) in held.items():
                there = np.zeros(len(ids), bool)
                there[slots] = True
                bits[k] = np.packbits(there)
                held[k] = (slots, weight * ((1_000_000_000 * times) // (1000 * times + 20 * m[slots])))
            for item, wanted in queries:
                occupied = np.zeros(words, np.uint8)
                for k in wanted:
                    if k in held:
                        slots, part = held[k]
                        sums[slots] += part  # a term has a slot once
                        occupied |= bits[k]
                at = np.flatnonzero(np.unpackbits(occupied, count=len(ids)))
                found = sums[at]
                sums[at] = 0
                heap = heaps[item]
                good = found >= heap.least()
                at, found = at[good], found[good]
                if len(found) > best:  # those of the least kept score may tie
                    good = found >= np.partition(found, len(found) - best)[len(found) - best]
                    at, found = at[good], found[good]
                for s, slot in zip(found.tolist(), at.tolist(), strict=True):
                    heap.offer(s, ids[slot])

        for b in batches:
            kind = b.column("doc_ids").type.value_type
            for window, term, slots, times, lengths, ids in zip(*(b.column(c).to_pylist() for c in ("window", "term", "slots", "times", "lengths", "doc_ids")), strict=True):
                if window != now:
                    if held:
                        score()
                    now, held = window, {}
                if term is None:
                    docs = np.frombuffer(lengths, "<u4").astype(np.int64), ids
                else:
                    number, weight = weights[term]
                    held[number] = (weight, np.frombuffer(slots, "<u2").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64))
        if held:
            score()
        rows = [(item, None if not known else -i, s) for item, heap in heaps.items() for s, known, i in heap.held]
        if rows:
            item, doc_id, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, kind), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(indexed: DataFrame, items: DataFrame, best: int = BEST, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0, by score and then ascending doc_id.

    Documents and terms are counted over the whole index first. Then the rows of the items'
    terms are dealt by window, and each task goes through its windows in turn: an item's
    terms are added into an array of a window's slots, a bitset says which are touched, and
    these are harvested into a heap. A task returns ``best`` rows an item at most, whatever
    it read. Items are searched for QUERY_ROWS terms at a time, which bounds what is sent to
    tasks; more take one pass over the index each.

    Null texts have no terms, so they are neither counted nor found; items without terms have
    no rows, and items with a null item_id are one item. Rows that repeat a doc_id are
    documents of their own; a null doc_id comes last of equal scores. Empty tables give no rows.
    """
    spark = indexed.sparkSession
    wanted = stored(query_terms(items, text), "terms")
    kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = indexed.schema["doc_ids"].dataType.elementType.simpleString()
    lengths = indexed.filter("term is null").select("lengths").mapInArrow(_lengths, "docs long, terms long")
    n_docs, n_terms = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    passes = max(1, -(-wanted.count() // QUERY_ROWS))
    found = []
    for k in range(passes):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        own = F.broadcast(rows.select(F.col("term").alias("own")).distinct())  # QUERY_ROWS or so
        postings = indexed.join(own, F.col("term") == F.col("own"), "left_semi")
        df = {r["term"]: r["df"] for r in postings.groupBy("term").agg(F.sum(F.octet_length("slots") / 2).cast("long").alias("df")).toLocalIterator()}
        weights = {t: (number, weight(n_docs, n)) for number, (t, n) in enumerate(df.items())}
        by_item: dict = {}
        for r in rows.toLocalIterator():
            if r["term"] in weights:
                by_item.setdefault(r["item_id"], []).append(weights[r["term"]][0])
        names = list(by_item)
        dealt = postings.unionByName(indexed.filter("term is null")).repartition("window").sortWithinPartitions("window", "term")
        part = dealt.mapInArrow(_search(list(enumerate(by_item.values())), {bytes(t): w for t, w in weights.items()}, n_docs, n_terms, best), f"item int, doc_id {doc_kind}, score long")
        listed = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        found.append(part.join(F.broadcast(listed), "item").select("item_id", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return ranked(out, best)


def ranked(scored: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` rows of each item (item_id, doc_id, score) with their rank from 1 on."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.frombuffer(x, "<u4") for x in b.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int((r > 0).sum()) for r in rows], pa.int64()), pa.array([int(r.sum(dtype=np.int64)) for r in rows], pa.int64())], ["docs", "terms"])


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """See ``search``, on an index of ``docs`` (doc_id, text) made for the purpose."""
    return search(index(docs), items, best)


ORACLE = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), lengths AS (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY 1, 2),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (SELECT term, rid, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY 1),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (rid), totals GROUP BY item_id, rid, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""
