"""SimHash near-duplicates by a grid join on segment bit counts and an exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_ids, join_groups, join_hot, stored
from .graph import components
from .shingles import BITS, majority, normal_words, shingle_hashes
from .similar import similar_pairs, sketched

#: Words in a shingle.
WORDS = 3
#: Bits of the segments whose bit counts make up the embedding: first 4, and 2 and 1 where cells are full.
SEGMENTS = (4, 2, 1)
#: Bits by which linked fingerprints may differ; the grid joins points within one step of a cell, so it is made for 2.
NEAR = 2
#: Fingerprints of a cell that are compared with one another; fuller cells are cut finer.
FEW = 32


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of all shingles of a lower-cased text.

    Only A-Z are lower-cased and only ASCII white space parts words. Fewer words than a
    shingle takes give one shingle; none, or null, give 0.
    """
    return majority(shingle_hashes(normal_words(text), words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _grid(prints: DataFrame, segment: int) -> DataFrame:
    """Every fingerprint in the grid cell of its embedding and in the cells one step away.

    The embedding is the bit count of each segment of so many bits. Manhattan distance of two
    embeddings never exceeds the fingerprints' Hamming distance, and two points at Manhattan
    distance 2 or less are the same, neighbours, or share a neighbour: they meet in a common
    cell. A cell is a long whose digits to base segment + 1 are its coordinates; with segments
    of one bit it is the fingerprint itself, and the distances are the same.
    """
    n, base = BITS // segment, segment + 1
    if segment == 1:
        masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << k for k in range(BITS - 1)), -(1 << (BITS - 1))]])
        return prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("cell"))
    counts = [F.bit_count(F.shiftrightunsigned("fp", segment * k).bitwiseAND((1 << segment) - 1)).cast("long") for k in range(n)]
    at = sum(c * F.lit(base**k).cast("long") for k, c in enumerate(counts))
    moves = [(0, 0, 0), *((segment * k, sign, sign * base**k) for k in range(n) for sign in (1, -1))]
    steps = F.array(*[F.struct(F.lit(a).alias("shift"), F.lit(b).alias("sign"), F.lit(c).cast("long").alias("step")) for a, b, c in moves])
    stepped = prints.select("fp", at.alias("at"), F.explode(steps).alias("move")).select("fp", "at", "move.*")
    count = F.expr(f"bit_count(shiftrightunsigned(fp, shift) & {(1 << segment) - 1})")
    stays = F.when(F.col("sign") > 0, count < segment).when(F.col("sign") < 0, count > 0).otherwise(True)  # a count is between none and all
    return stepped.filter(stays).select("fp", (F.col("at") + F.col("step")).alias("cell"))


def _within(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= NEAR


def close_pairs(prints: DataFrame, few: int = FEW) -> DataFrame:
    """Edges (a, b) of different fingerprints that differ by 1 or 2 bits; all such end up connected.

    ``prints``: one row (fp) for each different fingerprint. The grid join: cells with more
    than one fingerprint are found by partial aggregates. The exact check: those of a cell
    with at most ``few`` are compared with one another. The fingerprints of fuller cells are
    embedded by shorter segments, which tell more apart, and joined again. With segments of
    one bit all that meet in a cell differ by at most 2 bits: they are 65 at most, and are
    linked to the least. So a cell of any size costs each of its fingerprints a bounded number
    of rows and comparisons, and no link is lost.
    """
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= NEAR
    found: list[DataFrame] = []
    # few bytes each, but many rows are made of each: dealt to as many tasks as a shuffle has
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    for segment in SEGMENTS[:-1]:
        cells = _grid(prints, segment)
        busy = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
        busy = stored(busy.filter((F.col("n") > 2) | _within("a", "b")), "cells")
        some = broadcast_if_small(stored(busy.filter(F.col("n").between(3, few)).select("cell"), "some"))
        sets = cells.join(some, "cell", "left_semi").groupBy("cell").agg(F.collect_list("fp").alias("fps"))
        both = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        found += [busy.filter("n = 2").select("a", "b"), sets.select(F.explode(both).alias("pair")).select("pair.a", "pair.b")]
        full = broadcast_if_small(stored(busy.filter(F.col("n") > few).select("cell"), "full"))
        prints = stored(cells.join(full, "cell", "left_semi").select("fp").distinct(), "prints")
    met = _grid(prints, SEGMENTS[-1]).groupBy("cell").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    found.append(met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))
    return reduce(DataFrame.unionByName, found).distinct()


def linked(rows: DataFrame, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fp, component_id from stored rows (doc_id, fp), where ``pairs`` gives the edges (a, b) of the different fps.

    Rows of one fp stand together; component_id is the least doc_id reachable. A row with a
    null doc_id takes part in no link and has a null component.
    """
    grouped = stored(join_groups(rows.filter("doc_id is not null"), "fp", [F.min("doc_id").alias("id")]).drop("group_size"), "grouped")
    prints = stored(grouped.filter("doc_id = id").select("id", "fp").distinct(), "prints")
    found = stored(components(pairs(prints.select("fp"))), "components")
    members = stored(found.join(prints, found["node"] == prints["fp"]).select("fp", "id", "component"), "members")
    least = broadcast_if_small(stored(members.groupBy("component").agg(F.min("id").alias("component_id")), "least"))
    changed = stored(members.join(least, "component").filter("id <> component_id").select(F.col("fp").alias("__fp"), "component_id"), "changed")
    out = join_hot(grouped, changed, "fp", "__fp").select("doc_id", "fp", F.coalesce("component_id", "id").alias("component_id"))
    return out.unionByName(rows.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, the least doc_id reachable by links.

    Links join fingerprints that differ by at most 2 bits. With ``similarity`` they join
    texts whose different shingles have at least this Jaccard similarity, and texts of the
    same words: the grid of SimHashes and bands propose, the distance of SimHashes screens,
    the shingles decide (see ``similar``); the fingerprint is then a hash of the words. Texts without
    words are alike and link like any other; null counts as empty. Copies share a fingerprint,
    which stands for them all; rows that repeat a doc_id count as one document with the links
    of all, and one with a null doc_id takes part in no link and has a null component. An
    empty table gives no rows.
    """
    if similarity is None:
        found = linked(stored(fingerprints(docs, text, words), "fingerprints"), close_pairs)
    else:
        sketches = stored(sketched(docs, text, words), "sketches")
        found = linked(sketches.select("doc_id", "fp"), lambda _: similar_pairs(docs, sketches, close_pairs, text, words, similarity))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per component stays: that of its least doc_id.

    Rows with a null doc_id stay. Rows that repeat a doc_id stay or go together.
    """
    return drop_ids(docs, near_duplicates(docs, text, words, similarity).filter("doc_id <> component_id"))
