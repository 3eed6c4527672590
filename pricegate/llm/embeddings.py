"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_groups, join_hot, stored
from .graph import components

#: Least cosine of a link, vectors of a tile's side, and pairs recomputed at a time.
COSINE, TILE, PAIRS = 0.93, 512, 1 << 16
#: Vectors of a group: this times the square root of the label's vectors, between these bounds.
ROOTS, LEAST_GROUP, MOST_GROUP = 16, 2048, 65_536


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows u of x, int8 codes q, scales s, and the lengths of the errors u - s * q."""
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.abs(u).max(1, keepdims=True) / 127
    q = np.rint(u / s).astype(np.int8)
    return u, q, s[:, 0], np.sqrt(((u - s * q) ** 2).sum(1))


class Codes:
    """Quantised vectors: int8 codes q, scales s, and error lengths e."""

    def __init__(self, q: np.ndarray, s: np.ndarray, e: np.ndarray):
        # sums of products of codes are whole numbers, exact in float32 up to 1,040 components and in float64 beyond
        self.q, self.s, self.e = q.astype(np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64), s, e


def bounded(a: Codes, b: Codes, cosine: float, same: bool, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By tiles: index pairs that may have a cosine of at least ``cosine``, and whether they surely have.

    With u = s q + e, the cosine of two unit vectors differs from the product of the codes by
    at most |e_a| (|s_b q_b|) + |e_b|, where |s_b q_b| <= 1 + |e_b|.
    """
    for x in range(0, len(a.q), tile):
        for y in range(x if same else 0, len(b.q), tile):
            product = (a.q[x : x + tile] @ b.q[y : y + tile].T) * a.s[x : x + tile, None] * b.s[None, y : y + tile]
            bound = a.e[x : x + tile, None] * (1 + b.e[None, y : y + tile]) + b.e[None, y : y + tile] + 1e-6
            possible = product + bound >= cosine
            i, j = np.nonzero(np.triu(possible, 1) if same and x == y else possible)
            if len(i):
                yield i + x, j + y, (product - bound >= cosine)[i, j]


def exact(ua: np.ndarray, ub: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of unit rows have a cosine of at least ``cosine`` in double precision."""
    parts = [np.einsum("ij,ij->i", ua[i[k : k + PAIRS]], ub[j[k : k + PAIRS]]) >= cosine for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class _Links:
    """Numbers of links and least rows reached, of rows in order of id."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids, self.n, self.links, self.root = ids, n, np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, self.n[j], len(self.ids)).astype(np.int64) + np.bincount(j, self.n[i], len(self.ids)).astype(np.int64)
        while True:  # of the pairs at hand, until their rows have the same root
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            for x in (a, b):
                np.minimum.at(self.root, x, low)
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further

    def frame(self, check: np.ndarray) -> pd.DataFrame:
        some = (self.links > 0) | check
        return pd.DataFrame({"id": self.ids[some], "links": self.links[some], "root": self.ids[self.root[some]], "check": check[some]})


def _sides(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, bool]:
    lo, hi = frame["lo"].iat[0], frame["hi"].iat[0]
    frame = frame.sort_values(["id"], kind="stable").reset_index(drop=True)
    left = np.flatnonzero(frame["block"] == lo)
    return frame, left, left if lo == hi else np.flatnonzero(frame["block"] == hi), lo == hi


def _codes_of(frame: pd.DataFrame, rows: np.ndarray) -> Codes:
    q = np.frombuffer(b"".join(frame["code"].to_numpy()[rows]), np.int8).reshape(len(rows), -1)
    return Codes(q, frame["scale"].to_numpy()[rows], frame["error"].to_numpy()[rows])


def _sure(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of one pair of groups, by codes alone: sure links, and for each vector whether it has a pair to be recomputed."""
        frame, left, right, same = _sides(frame)
        found, check = _Links(frame["id"].to_numpy(), frame["n"].to_numpy()), np.zeros(len(frame), bool)
        if len(left) and len(right):
            for i, j, sure in bounded(_codes_of(frame, left), _codes_of(frame, right), cosine, same):
                i, j = left[i], right[j]
                found.add(i[sure], j[sure])
                check[i[~sure]] = check[j[~sure]] = True
        return found.frame(check)

    return run


def _recomputed(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of one pair of groups, of the vectors with pairs that codes leave open: links of those pairs, in full precision."""
        frame, left, right, same = _sides(frame)
        found = _Links(frame["id"].to_numpy(), frame["n"].to_numpy())
        if len(left) and len(right):
            u = quantise(np.array(frame["embedding"].tolist(), dtype=np.float64))[0]
            for i, j, sure in bounded(_codes_of(frame, left), _codes_of(frame, right), cosine, same):
                i, j = left[i[~sure]], right[j[~sure]]
                near = exact(u, u, i, j, cosine)
                found.add(i[near], j[near])
        return found.frame(np.zeros(len(frame), bool))

    return run


def _quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [quantise(np.array([v], dtype=np.float64)) for v in b["embedding"]]
        yield pd.DataFrame({"id": b["id"], "n": b["n"], "label": b["label"], "code": [q.tobytes() for _, q, _, _ in out], "scale": [s[0] for _, _, s, _ in out], "error": [e[0] for _, _, _, e in out], "embedding": b["embedding"]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, group: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id is its component_id).

    Vectors are compared if their labels (not null) and lengths are equal. A null or zero
    vector, one with a null or non-finite component, and a row with a null vec_id link with
    nothing. Copies are compared once and counted as often as they are there; rows that share
    a vec_id count as one vector with the links of both. An empty table gives no rows.

    Vectors are quantised once. Each label is dealt into groups (of ``group`` vectors, or some
    multiple of the root of their number), and each pair of groups is a task that multiplies
    tiles of codes: so work grows with the square of a label's vectors, as it must, but a
    vector travels, as codes, only as often as there are groups. A pair of groups returns sums
    and least ids, not its pairs of vectors. Only vectors with a pair that the error bounds
    leave open travel once more, in full, to have those pairs recomputed.
    """
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = stored(vectors.select("vec_id", F.struct("label", "embedding").alias("key"), usable.alias("usable")), "vectors")
    grouped = stored(join_groups(rows.filter("usable").drop("usable"), "key", [F.min("vec_id").alias("id")]), "copies")
    classes = grouped.filter("vec_id = id").select("id", F.col("group_size").alias("n"), "key").dropDuplicates(["id", "key"])
    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema["key"].dataType}
    classes = classes.select("id", "n", F.col("key.label").cast("string").alias("label"), "key.embedding")
    classes = classes.mapInPandas(_quantised, f"id long, n long, label string, code binary, scale double, error double, embedding {kinds['embedding']}")
    classes = stored(classes.withColumn("width", F.size("embedding")), "codes")
    wanted = F.lit(group) if group else F.greatest(F.lit(LEAST_GROUP), F.least(F.lit(MOST_GROUP), F.ceil(ROOTS * F.sqrt("count"))))
    large = stored(classes.groupBy("label", "width").count().withColumn("groups", F.ceil(F.col("count") / wanted).cast("int")).filter("groups > 1").select("label", "width", "groups"), "labels")
    dealt = classes.join(broadcast_if_small(large), ["label", "width"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.hash("id", F.lit(7)), F.col("groups")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    where = ["label", "width", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id"]
    cells = ["label", "width", "lo", "hi"]
    sure = stored(paired.select(*where, "n", "code", "scale", "error").groupBy(*cells).applyInPandas(_with_cell(_sure(cosine)), "label string, width int, lo int, hi int, id long, links long, root long, check boolean"), "sure")
    open_ = sure.filter("check").select(*cells, "id").join(dealt.select("id", "n", "block", "code", "scale", "error", "embedding", F.col("label").alias("of"), F.col("width").alias("wide")), "id")
    open_ = open_.filter("of = label and wide = width").drop("of", "wide")
    more = stored(open_.groupBy(*cells).applyInPandas(_with_cell(_recomputed(cosine)), "label string, width int, lo int, hi int, id long, links long, root long, check boolean"), "recomputed")
    found = stored(sure.unionByName(more).filter("links > 0").select("id", "links", "root"), "links")
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked_ids = stored(sums.join(comps, sums["id"] == comps["node"], "left").select(F.col("id").alias("__id"), "links", "component"), "linked")
    out = join_hot(grouped, linked_ids, "id", "__id")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("group_size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rest = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _with_cell(work):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = work(frame)
        for k, name in enumerate(["label", "width", "lo", "hi"]):
            out.insert(k, name, frame[name].iat[0])
        return out

    return run


#: DuckDB's form: all pairs within a label, then the least id reachable.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id
"""
