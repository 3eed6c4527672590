"""Pairs of texts by the similarity of their word shingles: SimHashes and bands of least hashes propose them, SimHashes screen them.

Texts of similarity 0.8 lie 4 to 14 bits of a SimHash apart. Within so many bits of a random
fingerprint's bit counts lie a good part of all others', so the grid of ``simhash``, made for 2
bits, would have to compare nearly all pairs. So what the grid links is joined by what shares a
band of least hashes; of both, pairs of a wider distance of SimHashes are left out, and the whole
texts' shingles decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, join_hot, stored
from .graph import components
from .shingles import majority, normal_words, shingle_hashes

#: Words in a shingle, and the share of two texts' different shingles that linked texts have in common.
WORDS, SIMILARITY = 5, 0.8
#: Bands, and least hashes in each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, DEPTH = 20, 5
#: A pair's texts are compared if the share of equal least hashes is at most this far below the similarity: three and
#: a half standard errors of a share of 100 at 0.8, which one pair in 3,000 of similarity 0.8 falls short of.
SLACK = 0.14
#: Bits by which the SimHashes of a pair may differ. Of texts of similarity 0.8 a bit differs with probability 0.15 (0.19
#: for 4 and 5 shingles), so that a pair in 100,000 (10,000) lies further apart.
RADIUS = 24
#: Texts of a block of a band's value, and texts and bytes of shingles of the blocks that are compared for open pairs (left, right).
BLOCK, LEFT, RIGHT, LEFT_BYTES, RIGHT_BYTES = 512, 512, 2048, 8 << 20, 32 << 20
#: Shingle hashes taken at a time.
CHUNK = 1 << 13
_RANDOM = np.random.default_rng(5)
_A, _B = (_RANDOM.integers(0, 1 << 64, (BANDS * DEPTH, 1), dtype=np.uint64) for _ in range(2))
_A |= np.uint64(1)


def text_key(found: list[bytes]) -> int:
    """A hash of a text's words, the same for texts that differ in case and white space only."""
    return xxhash.xxh64_intdigest(b" ".join(found), 7)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, bytes, int]:
    """A long for each band of least hashes, a byte of each least hash, and the SimHash of the different shingles, as similarity
    counts them; no shingles count as one of their own."""
    hashes = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
    least = np.full(len(_A), ~np.uint64(0))
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[None, at : at + CHUNK] * _A + _B).min(1))
    raw = least.reshape(BANDS, DEPTH)
    bands = np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)
    return bands, (least >> np.uint64(20)).astype(np.uint8).tobytes(), majority(hashes)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def sketched(docs: DataFrame, text: str, words: int) -> DataFrame:
    """doc_id, fp (a hash of the text's words), bands, sig, a byte of each least hash, and simhash. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text in b.column("text"):  # one at a time, as a text's words take much more room than the text
                found = normal_words(text.as_py())
                made.append((text_key(found), *sketch(shingle_hashes(found, words))))
            keys, marks = (pa.array(np.array([m[k] for m in made], dtype=np.uint64).view(np.int64)) for k in (0, 3))
            bands, sigs = pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), keys, bands, sigs, marks], ["doc_id", "fp", "bands", "sig", "simhash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, bands array<long>, sig binary, simhash long")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n])) if n else np.zeros(1, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows in order of the named columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        cut = int(_runs(*(table[c].to_numpy() for c in names))[-2])  # the last group may go on
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _shares(sigs: np.ndarray, marks: np.ndarray, sig: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Of each pair the share of equal least hashes, or -1 where its SimHashes lie too far apart."""
    return np.where(np.bitwise_count(marks ^ mark) <= RADIUS, (sigs == sig).mean(1), -1.0)


def spanning(sigs: np.ndarray, marks: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Prim's algorithm: a spanning forest of the pairs within the radius with a share of equal least hashes of at least ``least``, the likeliest pairs first."""
    n, out = len(sigs), []
    share, via = np.full(n, -1.0), np.zeros(n, np.int64)
    left, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        left[at] = False
        new = _shares(sigs, marks, sigs[at], marks[at])
        better = new > share
        share[better], via[better] = new[better], at
        at = int(np.where(left, share, -2.0).argmax())
        if share[at] >= least:
            out.append((at, int(via[at]), float(share[at])))
    return out


def _forest(least: float):
    """Of the texts of each block of a band's value: the pairs (a, b) of a spanning forest of the likely ones, with their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key", "block"):
            fps, sigs, marks = table["fp"].to_numpy(), _matrix(table["sig"]), table["simhash"].to_numpy().view(np.uint64)
            edges = _runs(table["key"].to_numpy(), table["block"].to_numpy())
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            share = _shares(sigs[two], marks[two], sigs[two + 1], marks[two + 1])
            good = share >= least - SLACK
            pairs, shares = [np.stack([two[good], two[good] + 1], 1)], [share[good]]
            for k in np.flatnonzero(size > 2).tolist():
                found = spanning(sigs[edges[k] : edges[k + 1]], marks[edges[k] : edges[k + 1]], least - SLACK)
                if found:
                    pairs.append(np.array([p[:2] for p in found]) + edges[k])
                    shares.append(np.array([p[2] for p in found]))
            ends = fps[np.concatenate(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1)), pa.array(np.concatenate(shares))], ["a", "b", "share"])

    return run


def _of_block(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Of one group of open texts: links between components, each likely pair of texts compared on all shingles until its components are one."""
    side = table["side"].to_numpy()
    fps, comps, sigs, bands = table["fp"].to_numpy(), table["component"].to_numpy(), _matrix(table["sig"]), _matrix(table["bands"]).view(np.int64)
    marks = table["simhash"].to_numpy().view(np.uint64)
    shingles = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
    sizes = np.array(list(map(len, shingles)))
    band, up, out = table["band"][0].as_py(), {}, []

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c] = up.get(up[c], up[c])
        return c

    right = np.flatnonzero(side == 1)
    for t in np.flatnonzero(side == 0).tolist():
        share = _shares(sigs[right], marks[right], sigs[t], marks[t])
        near = (share >= least - SLACK) & (comps[right] != comps[t])
        near = right[near][np.argsort(-share[near], kind="stable")]
        near = near[(bands[near] == bands[t]).argmax(1) == band]  # a pair counts in the first band only that its texts share
        step = 4
        while len(near):
            some, near, step = near[:step], near[step:], step * 2
            flat = np.concatenate([shingles[k] for k in some])
            found = np.searchsorted(shingles[t], flat)
            held = shingles[t][np.minimum(found, sizes[t] - 1)] == flat if sizes[t] else np.zeros(len(flat), bool)
            both = np.bincount(np.repeat(np.arange(len(some)), sizes[some]), held, minlength=len(some))
            for k in some[both >= least * (sizes[some] + sizes[t] - both)].tolist():
                a, b = root(comps[t]), root(comps[k])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((min(fps[t], fps[k]), max(fps[t], fps[k])))
            if len(near) and up:
                own = root(comps[t])
                near = near[[root(c) != own for c in comps[near].tolist()]]
    return out


def _open(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "key", "lo", "hi"):
            edges = _runs(*(table[c].to_numpy() for c in ("key", "lo", "hi")))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = _of_block(table.slice(x, y - x), least)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _in_order(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of equal names in one task, one after another."""
    return rows.repartition(*names).sortWithinPartitions(*names)


def _grouped(prints: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` with one more band: the component of their SimHashes under the links (a, b) that ``close`` finds between different ones (fp)."""
    found = _component_of(close(stored(prints.select(F.col("simhash").alias("fp")).distinct(), "simhashes")))
    own = F.xxhash64(F.coalesce("component", "simhash"), F.lit("simhash"))
    return join_hot(prints, found, "simhash", "node").select("fp", F.concat("bands", F.array(own)).alias("bands"), "sig", "simhash")


def similar_pairs(docs: DataFrame, sketches: DataFrame, close: Callable[[DataFrame], DataFrame], text: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of text hashes that connect all texts of a similarity of at least ``least`` that share a band or whose SimHashes ``close`` links.

    Texts of SimHashes that are linked, by others too, share a band of their own. Every edge
    has SimHashes within RADIUS and is checked on the whole texts' shingles. The texts of a
    band's value, in blocks of BLOCK with the least of them all in each, give a spanning forest
    of their likely pairs, so a group gives as many pairs as it has texts. Each text's likeliest
    pair is checked first, then those of the others whose texts are not connected yet. What is
    still in different components of a band's value is then compared by ``_remaining``. So no
    group makes all its pairs, and no link between components is lost.
    """
    prints = stored(sketches.filter("doc_id is not null").select("fp", "bands", "sig", "simhash").dropDuplicates(["fp"]), "sketched")
    prints = stored(_grouped(prints, close), "prints")
    members = prints.select("fp", F.posexplode("bands").alias("band", "key"))
    busy = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo")).filter("n > 1"), "busy")
    listed = broadcast_if_small(busy)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(listed, "key").select("key", F.when(F.col("fp") == F.col("lo"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.hash("fp"), blocks))).alias("blocks"), "fp")
    dealt = dealt.select("key", F.explode("blocks").alias("block"), "fp").join(prints.select("fp", "sig", "simhash"), "fp")
    likely = stored(_in_order(dealt, "key", "block").mapInArrow(_forest(least), "a long, b long, share double").groupBy("a", "b").agg(F.max("share").alias("share")), "likely")
    ends = likely.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("other")), F.struct(F.col("b").alias("of"), F.col("a").alias("other")))).alias("e"), "share")
    best = ends.groupBy("e.of").agg(F.max_by("e.other", F.struct("share", "e.other")).alias("other"))
    first = stored(best.select(F.least("of", "other").alias("a"), F.greatest("of", "other").alias("b")).distinct(), "first")
    edges = _checked(docs, text, sketches, first, words, least)
    rest = _apart(likely.select("a", "b"), _component_of(edges)).join(first, ["a", "b"], "left_anti")
    edges = stored(edges.unionByName(_checked(docs, text, sketches, rest, words, least)), "edges")
    return edges.unionByName(_remaining(docs, sketches, text, words, least, members, busy, prints, _component_of(edges)))


def _remaining(docs: DataFrame, sketches: DataFrame, text: str, words: int, least: float, members: DataFrame, busy: DataFrame, prints: DataFrame, at: DataFrame) -> DataFrame:
    """Edges between texts that share a band and are in different components ``at``.

    Of each band's value with more than two texts, those of its largest component need not be
    compared with one another. The others, in blocks, meet the blocks of all its texts: each
    task has two blocks of a bounded number of texts and bytes, with their shingles.
    """
    large = stored(members.join(broadcast_if_small(stored(busy.filter("n > 2").select("key"), "large")), "key", "left_semi"), "members")
    placed = stored(join_hot(large, at, "fp", "node").select("fp", "band", "key", F.coalesce("component", "fp").alias("component")), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = placed.join(broadcast_if_small(stored(main.select("key", "main"), "mixed")), "key")
    held = stored(_shingles(docs, text, sketches, mixed.select("fp").distinct(), words), "shingles")
    sized = stored(mixed.join(held.select("fp", F.octet_length("shingles").cast("long").alias("bytes")), "fp").withColumn("minor", F.col("component") != F.col("main")), "sized")
    minor = F.col("minor").cast("long")
    cuts = lambda n, most, size, bytes_: F.ceil(F.greatest(n / most, size / bytes_)).cast("int")
    deal = sized.groupBy("key").agg(cuts(F.sum(minor), LEFT, F.sum(minor * F.col("bytes")), LEFT_BYTES).alias("los"), cuts(F.count("*"), RIGHT, F.sum("bytes"), RIGHT_BYTES).alias("his"))
    dealt = sized.join(broadcast_if_small(stored(deal, "deal")), "key")
    of, every = lambda salt, n: F.pmod(F.hash("fp", F.lit(salt)), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["key", "band", "fp", "component"]
    left = dealt.filter("minor").select(*names, F.lit(0).alias("side"), of(1, "los").alias("lo"), every("his").alias("hi"))
    right = dealt.select(*names, F.lit(1).alias("side"), every("los").alias("lo"), of(2, "his").alias("hi"))
    full = left.unionByName(right).join(prints.select("fp", "sig", "simhash", _packed("bands").alias("bands")), "fp").join(held, "fp")
    return stored(_in_order(full, "key", "lo", "hi").mapInArrow(_open(least), "a long, b long").distinct(), "found")


def _packed(longs: str):
    """An array of longs as bytes, little-endian."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype="<i8").tobytes() for v in values])

    return packed(longs)


def _component_of(edges: DataFrame) -> DataFrame:
    """node, component of the texts with links."""
    return stored(components(edges), "components")


def _apart(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are not in one component."""
    one = join_hot(pairs, at, "a", "node").select("a", "b", F.coalesce("component", "a").alias("of_a"))
    both = join_hot(one, at, "b", "node").select("a", "b", "of_a", F.coalesce("component", "b").alias("of_b"))
    return both.filter("of_a <> of_b").select("a", "b")


def _texts(docs: DataFrame, text: str, sketches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text): a text for each wanted fp, a stored table of which is given; the least doc_id that has it leads there."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([text_key(normal_words(t.as_py())) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("text")], ["fp", "text"])

    listed = broadcast_if_small(wanted)
    holders = sketches.join(listed, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    holders = stored(holders.select("doc_id").distinct(), "holders")
    texts = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(broadcast_if_small(holders), "doc_id", "left_semi").select("text")
    return texts.mapInArrow(keyed, "fp long, text string").join(listed, "fp", "left_semi").dropDuplicates(["fp"])


def _shingles(docs: DataFrame, text: str, sketches: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, shingles): the different shingle hashes of the wanted texts in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(normal_words(t.as_py()), words)).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(found, pa.binary())], ["fp", "shingles"])

    return _texts(docs, text, sketches, stored(wanted, "wanted")).mapInArrow(run, "fp long, shingles binary")


def _checked(docs: DataFrame, text: str, sketches: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs whose texts' shingles have at least the given similarity, computed from the whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = lru_cache(maxsize=16)(lambda t: np.unique(shingle_hashes(normal_words(t), words)))
        for b in batches:
            near = [similarity(shingles(x.as_py()), shingles(y.as_py())) >= least for x, y in zip(b.column("text_a"), b.column("text_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "wanted")
    texts = stored(_texts(docs, text, sketches, wanted), "texts")
    sided = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    found = stored(sided.mapInArrow(check, "a long, b long"), "similar")
    discard(docs.sparkSession, pairs, wanted, texts)
    return found
