"""Exact search for the k highest inner products, in whole numbers.

All vectors are ranged by descending length and packed into blocks; queries are
packed likewise.  The block of the longest vectors, of bounded size, gives each query a
first threshold: its k-th best score there.  A query block then meets only those bands
of blocks that are long enough: length times length bounds an inner product.  Within
a pair of blocks the vectors are turned by the singular vectors of the whole table, so
that the first coordinates hold most of each length; a partial sum over these plus the
product of what remains of both lengths (Cauchy-Schwarz) bounds a score from above.
Pairs whose bound is below the threshold are dropped, all others are scored exactly, and
the threshold rises.  Only bounds that are strictly below the threshold, by more than the
rounding of the turned coordinates, drop anything; so no result and no tie is lost.

Query blocks are dealt to stripes of at most ``STRIPE`` blocks, so that a pair of
stripe and band is a bounded piece of work, however many queries there are.

Defined cases: vectors that are null or hold null or non-finite components take no
part; of vectors of different lengths the missing components count as 0; every row stands
for itself, so repeated rows (and repeated ids) are found as often as they occur, and a
query leaves out its own row only; ties go to the smaller id, null ids last, then to the row
read first; fewer candidates than k give that many rows; a component beyond 2**27 / scale is
a ValueError; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statsift.llm import _common as c
from statsift.llm import _vectors as v

#: Rows of a block of candidates and of one of queries; candidates that are held against all queries of a block at once.
BLOCK, QUERIES, STEP = 4096, 1024, 1024
#: Turned coordinates after which bounds are taken.
HEADS = (16, 32)
#: Bands of candidate blocks, query blocks of a stripe.
BANDS, STRIPE = 1024, 64
#: Below this share of pairs left, pairs are carried on one by one instead of as a matrix.
FEW = 1 / 16
NO_ID, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
PACKED = "part int, nth int, longest double, uids binary, ids binary, v binary"
FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


@dataclass
class Block:
    """Vectors in falling order of length, and their turned coordinates."""

    uids: np.ndarray
    ids: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    lengths: np.ndarray

    def rest(self, head: int) -> np.ndarray:
        """What the coordinates from ``head`` on hold of each length."""
        return np.sqrt((self.turned[:, head:] ** 2).sum(1))


def block(uids: np.ndarray, ids: np.ndarray, whole: np.ndarray, basis: np.ndarray) -> Block:
    x = whole.astype(np.float64)
    return Block(uids, ids, whole, x @ basis, np.sqrt((x * x).sum(1)))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products; in doubles where these hold them exactly."""
    a, b = np.abs(q).max(initial=0), np.abs(x).max(initial=0)
    if int(a) * int(b) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def survivors(q: Block, x: Block, live: np.ndarray, part: slice, least: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``live`` queries and candidates of ``part`` whose bounds reach the queries' thresholds."""
    width = q.turned.shape[1]
    sums, low = np.zeros((len(live), part.stop - part.start)), 0
    qi, xi = None, None
    for high in (h for h in heads if h < width):
        if qi is not None and len(qi) < FEW * sums.size:
            head = sums[qi, xi] + np.einsum("ij,ij->i", q.turned[live[qi], low:high], x.turned[part][xi, low:high])
            bound = head + q.rest(high)[live[qi]] * x.rest(high)[part][xi]
            stay = bound >= least[live[qi]]
            return qi[stay], xi[stay]
        sums += q.turned[live, low:high] @ x.turned[part, low:high].T
        qi, xi = np.nonzero(sums + q.rest(high)[live, None] * x.rest(high)[part] >= least[live, None])
        low = high
    return (qi, xi) if qi is not None else tuple(np.indices(sums.shape).reshape(2, -1))


def best_of(q: Block, x: Block, k: int, floor: np.ndarray, step: int = STEP, heads: tuple[int, ...] = HEADS) -> tuple[tuple[np.ndarray, ...], np.ndarray, int]:
    """The k best candidates of each query that reach ``floor``: (query place, score, candidate place); the risen floors; pairs scored."""
    floor = floor.copy()
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    slack = 1e-9 * q.lengths * x.lengths.max(initial=0.0) + 1e-6  # more than doubles lose
    scored = 0
    for start in range(0, len(x.ids), step):
        part = slice(start, min(start + step, len(x.ids)))
        live = np.flatnonzero(q.lengths * x.lengths[start] + slack >= floor)
        if not len(live):
            break  # candidates become shorter, floors higher
        qi, xi = survivors(q, x, live, part, floor - slack, heads)
        if len(qi) > FEW * len(live) * (part.stop - start):
            scores = exact_scores(q.whole[live], x.whole[part])[qi, xi]
        else:
            scores = np.einsum("ij,ij->i", q.whole[live[qi]], x.whole[part][xi])
        scored += len(qi)
        qi, xi = live[qi], xi + start
        good = (scores >= floor[qi]) & (x.uids[xi] != q.uids[qi])
        both = [np.concatenate((a, b)) for a, b in zip(held, (qi[good], scores[good], xi[good]))]
        order = np.lexsort((x.uids[both[2]], x.ids[both[2]], -both[1], both[0]))
        both = [a[order] for a in both]
        first = np.searchsorted(both[0], both[0])  # where the query's candidates begin
        nth = np.arange(len(first)) - first
        last = nth == k - 1
        floor[both[0][last]] = np.maximum(floor[both[0][last]], both[1][last])
        held = tuple(a[nth < k] for a in both)
    return held, floor, scored


def basis_of(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, the largest singular value first."""

    def products(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = v.matrix(batch.column("v"), width).astype(np.float64)
        return {0: (x.T @ x).reshape(-1)}

    gram = v.summed(rows, products, "double")[0].reshape(width, width)
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def packed_blocks(rows: DataFrame, n: int, size: int, width: int) -> DataFrame:
    """``part, nth, longest`` and the rows of each block, ``part`` in falling order of length.

    ``longest``: the length of the block's first vector."""
    from pyspark import TaskContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                b = batch.slice(start, size)
                x = v.matrix(b.column("v"), width)
                longest = float(np.sqrt((x[:1].astype(np.float64) ** 2).sum()))
                uids, ids = (b.column(name).to_numpy().astype("<i8").tobytes() for name in ("uid", "vec_id"))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "longest": [longest],
                    "uids": pa.array([uids], pa.binary()), "ids": pa.array([ids], pa.binary()), "v": pa.array([x.astype("<i4").tobytes()], pa.binary()),
                })
                nth += 1

    order = [F.desc("length2"), F.asc("vec_id"), F.asc("uid")]
    parts = min(-(-n // size), BANDS)  # the driver samples rows for each part: beyond so many, a part is several blocks
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, PACKED)


def unpacked(row: dict, basis: np.ndarray, width: int, of: str = "") -> Block:
    ids = [np.frombuffer(row[of + name], "<i8") for name in ("uids", "ids")]
    return block(*ids, np.frombuffer(row[of + "v"], "<i4").reshape(len(ids[0]), width).astype(np.int64), basis)


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = BLOCK, query_rows: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score, query_uid``: the k best of all other rows for each row that ``is_query`` picks by ``vec_id``.

    ``query_uid`` tells queries of equal ids apart.  Blocks are written when this is called."""
    spark = vectors.sparkSession
    whole = v.whole_vectors(vectors, scale, None, id_col, vec_col)
    rows = c.cut(whole.withColumns({"uid": F.monotonically_increasing_id(), "asks": F.coalesce(is_query, F.lit(False))}), "whole-vectors")
    about = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("bytes"), F.count_if("asks").alias("queries")).first()
    n, width = about["n"], max((about["bytes"] or 0) // 4, 1)
    if not about["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, query_uid long")
    basis = basis_of(rows, width)
    known = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(int(NO_ID))))
    candidates = c.cut(packed_blocks(known, n, block_rows, width), "candidate-blocks")
    queries = packed_blocks(known.filter("asks"), about["queries"], query_rows, width)

    # fixed sizes reach the driver: the length of each band's longest vector, and one block of the longest vectors
    band = F.col("part")
    longest = {r["band"]: r["longest"] for r in candidates.groupBy(band.alias("band")).agg(F.max("longest").alias("longest")).collect()}
    top = known.orderBy(F.desc("length2"), "vec_id", "uid").limit(block_rows).select("uid", "vec_id", "v").toArrow()
    seed = tuple(top.column(name).to_numpy().astype(np.int64) for name in ("uid", "vec_id")) + (v.matrix(top.column("v").combine_chunks(), width).astype("<i4"),)
    sent = spark.sparkContext.broadcast((basis, seed, longest))
    stripes = -(-about["queries"] // (query_rows * STRIPE))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thresholds of a query block, the bands it must meet, its stripe."""
        basis, (uids, ids, x), longest = sent.value
        first = block(uids, ids, x.astype(np.int64), basis)
        for batch in batches:
            for row in batch.to_pylist():
                q = unpacked(row, basis, width)
                _, floor, _ = best_of(q, first, k, np.full(len(q.ids), LOWEST))
                bands = sorted(b for b, far in longest.items() if (q.lengths * far * (1 + 1e-9) + 1e-6 >= floor).any())
                one = {"q_" + name: [row[name]] for name in ("uids", "ids", "v")}
                yield pa.RecordBatch.from_pydict({**one, "q_floor": [floor.astype("<i8").tobytes()], "bands": pa.array([bands], pa.list_(pa.int32())), "stripe": pa.array([(row["part"] + row["nth"]) % stripes], pa.int32())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, _, _ = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q, x = unpacked(row, basis, width, "q_"), unpacked(row, basis, width)
                (qi, score, xi), _, _ = best_of(q, x, k, np.frombuffer(row["q_floor"], "<i8"))
                yield pa.RecordBatch.from_pydict({"query_uid": q.uids[qi], "query_id": q.ids[qi], "uid": x.uids[xi], "vec_id": x.ids[xi], "score": score})

    begun = c.cut(queries.mapInArrow(begin, "q_uids binary, q_ids binary, q_v binary, q_floor binary, bands array<int>, stripe int"), "query-blocks")
    asked = begun.select("q_uids", "q_ids", "q_v", "q_floor", "stripe", F.explode("bands").alias("band"))
    offered = candidates.select("uids", "ids", "v", band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    # never sent to the driver: a block of queries is as many rows as it has bands, of which the planner's sizes know nothing
    found = asked.join(offered.hint("merge"), ["band", "stripe"]).mapInArrow(meet, FOUND)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    own = lambda name: F.nullif(F.col(name), F.lit(int(NO_ID))).alias(name)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(own("query_id"), "rank", own("vec_id"), "score", "query_uid")
