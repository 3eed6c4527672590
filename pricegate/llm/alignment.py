"""Two tokenizers' tokens of the same text, aligned: minimal groups of overlapping tokens, and how often ids are linked."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Characters of a block of documents, and rows that are tokenised at a time.
BLOCK, ROWS = 6_000_000, 200
#: Chunks of text, and characters in them, that a worker remembers before it starts anew; results do not depend on it.
REMEMBERED, CHARACTERS = 400_000, 16_000_000
#: Binary digits of an id in a pair.
ID = 20
_SPACE = "▁"
#: Where neither tokenizer joins what stands on both sides: a space or line end after what is no white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Whitespace that keeps a text from being split by single spaces and line ends.
_ODD = re.compile(r"[ \n]{2}|[^\S \n]")


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of tokens whose byte ranges overlap; both sequences cover the same bytes, none is empty."""
    start_a, start_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    first = np.searchsorted(ends_b, start_a, "right")
    count = np.searchsorted(start_b, ends_a, "left") - first
    return np.repeat(np.arange(len(ends_a)), count), _ranges(first, count)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... of which there are count[k], one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges (a, b) of nodes 0 to n - 1: roots are hooked to lesser ones, and paths halved, all at once."""
    up = np.arange(n)
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
    return up


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(numbers[order], first)


class Links:
    """Tokens, groups and linked id pairs of chunks of text, each chunk worked out once while it is remembered."""

    def __init__(self, ranks: str, model: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size_a = np.zeros(max(table.values()) + 1, np.int64)
        self.size_a[list(table.values())] = list(map(len, table))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.shown_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array(list(map(len, self.shown_b)))
        self.space = self.b.piece_to_id(_SPACE)
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered. Of each chunk: counts (n_a, n_b, n_groups, n_links, or -1 if tokens and text differ), text of its groups, linked pairs."""
        self.known: dict[str | tuple[str], int] = {}
        self.characters = 0
        self.counts, self.shown = np.zeros((0, 4), np.int64), []
        self.pair, self.times, self.at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or self.characters > CHARACTERS

    def chunks(self, text: str) -> list[str | tuple[str]]:
        """Keys of the chunks of a space and a text, cut where no token of either kind goes across. A plain word is its key
        and stands for a space and the word, or for itself if it begins with a line end; other chunks are tuples."""
        if text[0] in " \n" or _ODD.search(text):
            return [(c,) for c in _CUT.split(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def tokens_b(self, chunks: list[str]) -> list[list[int]]:
        """The model puts a space before what it encodes: the chunk's own, or one that is taken off again."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [[self.space] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def numbers(self, keys: list) -> np.ndarray:
        """Numbers of chunks; new ones are worked out first."""
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            wanted = [keys[k] for k in missing.tolist()]
            fresh = list(dict.fromkeys(wanted))
            first = len(self.known)
            self.work_out([k[0] if isinstance(k, tuple) else k if k[:1] == "\n" else " " + k for k in fresh])
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            found[missing] = [self.known[k] for k in wanted]
        return found

    def work_out(self, chunks: list[str]) -> None:
        """Adds chunks: the union of overlapping tokens gives the groups, whose members' products are the links."""
        n = len(chunks)
        a, b = [self.a.encode_ordinary(c) for c in chunks], self.tokens_b(chunks)
        bad = np.zeros(n, bool)
        for k, (c, ids) in enumerate(zip(chunks, b, strict=True)):
            if b"".join(map(self.shown_b.__getitem__, ids)) != c.encode("utf-8", "surrogatepass"):
                bad[k], a[k], b[k] = True, [], []
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        a, b = np.array([i for ids in a for i in ids], np.int64), np.array([i for ids in b for i in ids], np.int64)
        i, j = overlaps(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        root = union_find(len(a) + len(b), i, len(a) + j)
        first, group_a = np.unique(root[: len(a)], return_inverse=True)  # a group's least node is its first token of A
        group_b = np.searchsorted(first, root[len(a) :])
        in_a, in_b = np.bincount(group_a, minlength=len(first)), np.bincount(group_b, minlength=len(first))
        chunk = np.repeat(np.arange(n), n_a)[first]
        groups = np.bincount(chunk, minlength=n)
        links = np.bincount(chunk, in_a * in_b, minlength=n).astype(np.int64)
        counts = np.stack([n_a, n_b, groups, links], 1)
        counts[bad] = -1
        self.counts = np.concatenate([self.counts, counts])
        self.shown += self._texts(a, b, in_a, in_b, groups)
        # different ids of a group with their numbers, so that a long group of few ids has few pairs
        ids_a, times_a = _summed(group_a << ID | a, np.ones(len(a), np.int64))
        ids_b, times_b = _summed(group_b << ID | b, np.ones(len(b), np.int64))
        per_b = np.bincount(ids_b >> ID, minlength=len(first))
        here = per_b[ids_a >> ID]
        other = _ranges((np.cumsum(per_b) - per_b)[ids_a >> ID], here)
        mask = (1 << ID) - 1
        pair = np.repeat(ids_a & mask, here) << ID | ids_b[other] & mask
        self.pair.append(pair)
        self.times.append(np.repeat(times_a, here) * times_b[other])
        size = np.bincount(chunk[np.repeat(ids_a >> ID, here)], minlength=n)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.characters += sum(map(len, chunks))

    @staticmethod
    def _texts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """The text of each chunk's groups."""
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        shown, i, j = [], 0, 0
        for m, n in zip(in_a.tolist(), in_b.tolist(), strict=True):
            shown.append(f"{a[i] if m == 1 else ','.join(a[i : i + m])}|{b[j] if n == 1 else ','.join(b[j : j + n])}")
            i, j = i + m, j + n
        ends = np.cumsum(groups).tolist()
        return [";".join(shown[x:y]).encode() for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def linked(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs of chunks one after another, how often each is linked, and how many pairs each chunk has."""
        if len(self.pair) > 1:
            self.pair, self.times = [np.concatenate(self.pair)], [np.concatenate(self.times)]
        count = self.at[numbers + 1] - self.at[numbers]
        where = _ranges(self.at[numbers], count)
        return self.pair[0][where], self.times[0][where], count


@lru_cache(maxsize=1)
def links(ranks: str, model: str) -> Links:
    return Links(ranks, model)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    return x.astype(next((t for t in ("<u1", "<u2", "<u4") if not len(x) or x.max() <= np.iinfo(t).max), "<u8")).tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, places binary, times binary"
PAIR = "place int, pair long, held long"


class Block:
    """Documents in turn, and at its end the rows of the documents and of the different pairs that they hold."""

    def __init__(self, number: int, made: Links):
        self.number, self.made, self.size = number, made, 0
        self.ids, self.rows, self.doc, self.chunk, self.times = [], [], [], [], []

    def add(self, ids: list, texts: list[str | None]) -> None:
        split = [self.made.chunks(t) if t else [] for t in texts]
        count = np.array(list(map(len, split)))
        numbers = self.made.numbers([k for keys in split for k in keys])
        edges = np.concatenate(([0], np.cumsum(count)))
        counts = self.made.counts[numbers]
        bad = np.concatenate(([0], np.cumsum(counts[:, 0] < 0)))
        bad = bad[edges[1:]] > bad[edges[:-1]]
        sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(counts, 0)))
        sums = np.where(bad[:, None], 0, sums[edges[1:]] - sums[edges[:-1]])
        listed = numbers.tolist()
        for k, (odd, row) in enumerate(zip(bad.tolist(), sums.tolist(), strict=True)):
            shown = b"" if odd else b";".join(map(self.made.shown.__getitem__, listed[edges[k] : edges[k + 1]]))
            self.rows.append((*row, sha256(shown).hexdigest() if shown else ""))
        owner = np.repeat(np.arange(len(texts)), count)
        keys = (owner << 32 | numbers)[~bad[owner]]
        keys, times = np.unique(keys, return_counts=True)
        self.doc.append((keys >> 32) + len(self.ids))
        self.chunk.append(keys & 0xFFFFFFFF)
        self.times.append(times)
        self.ids += ids
        self.size += sum(len(t) for t in texts if t)

    def out(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        pair, times, count = self.made.linked(np.concatenate(self.chunk))
        times = times * np.repeat(np.concatenate(self.times), count)
        doc = np.repeat(np.concatenate(self.doc), count)
        # documents of a block are far fewer than 2 ** 23
        keys, times = _summed(doc << 2 * ID | pair, times)
        doc, pair = keys >> 2 * ID, keys & ((1 << 2 * ID) - 1)
        own, place, held = np.unique(pair, return_inverse=True, return_counts=True)
        edges = np.searchsorted(doc, np.arange(n + 1))
        places, often = [], []
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            places.append(_small(np.diff(place[x:y], prepend=0)))
            often.append(_small(times[x:y]))
        names = ["block", "doc_id", *(c.split()[0] for c in f"{DOC}, {PAIR}".split(", "))]
        *numbers, digest = zip(*self.rows, strict=True)
        columns = [pa.array([self.number] * n, pa.int64()), pa.array(self.ids, kind), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digest), pa.array(np.diff(edges), pa.int32()), pa.array(places, pa.binary()), pa.array(often, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        m = len(own)
        empty = [pa.nulls(m, c.type) for c in columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * m, pa.int64()), *empty, pa.array(np.arange(m), pa.int32()), pa.array(own), pa.array(held)], names)


def _blocks(ranks: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, done, kind, block = links(ranks, model), TaskContext.get().partitionId(), 0, None, None
        for b in batches:
            kind = b.column("doc_id").type
            for k in range(0, b.num_rows, ROWS):
                if block is None:
                    if made.full():
                        made.forget()
                    block = Block(part << 32 | done, made)
                rows = b.slice(k, ROWS)
                block.add(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())
                if block.size >= BLOCK or made.full():
                    yield from block.out(kind)
                    block, done = None, done + 1
        if block is not None:
            yield from block.out(kind)

    return run


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the counts of its pairs summed over their links."""
    found = np.zeros((2, pairs.num_rows), np.int64)
    found[:, pairs["place"].to_numpy()] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    sums = [(found[:, np.cumsum(_large(places, n))] @ _large(times, n)).tolist() for n, places, times in zip(*(docs[c].to_pylist() for c in ("n_pairs", "places", "times")), strict=True)]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array([s[1] for s in sums], pa.int64())).append_column("count_sum", pa.array([s[0] for s in sums], pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def blocks(docs: DataFrame, ranks: str, model: str, text: str = "text") -> DataFrame:
    """The stored alignment, in blocks of documents: rows of documents, and of the different pairs of each block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(_blocks(ranks, model), f"block long, doc_id {kind}, {DOC}, {PAIR}"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents of the corpus that hold an id pair linked, and 1 if no other pair of its A id has more.

    The most of each A id is a row per id of the vocabulary, which bounds what is broadcast.
    """
    counts = stored(aligned.filter("pair is not null").groupBy("pair").agg(F.sum("held").alias("n")), "counts")
    first = F.shiftright("pair", ID)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def link_table(docs: DataFrame, ranks: str, model: str, text: str = "text") -> DataFrame:
    """(a, b, n, best) of every id pair that is linked anywhere, for translating ids of one tokenizer to the other."""
    pair = F.col("pair")
    found = pair_counts(blocks(docs, ranks, model, text))
    return found.select(F.shiftright(pair, ID).alias("a"), pair.bitwiseAND((1 << ID) - 1).alias("b"), "n", (F.col("best") == 1).alias("best"))


def align(docs: DataFrame, ranks: str, model: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A space and the text by byte-level ranks (A) and by a SentencePiece model (B), whole texts.
    Tokens whose bytes overlap are united; the components are the minimal groups, and all
    pairs of an A and a B token of a group are links. Pairs are counted over all documents:
    each block of documents sends its different pairs once, and gets their counts back, so a
    pair that is everywhere is one row of each block. Texts that are null or empty, or that
    B's pieces do not spell (a literal mark of its space), have zeros and an empty digest.
    Rows that repeat a doc_id, or have none, are documents of their own; an empty table gives
    no rows. Ids are below 2 ** 20.
    """
    aligned = blocks(docs, ranks, model, text)
    pairs = aligned.filter("pair is not null").select("block", "place", "pair")
    found = pairs.join(pair_counts(aligned), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    rows = aligned.filter("pair is null").select("block", "doc_id", *[c.split()[0] for c in DOC.split(", ")])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
