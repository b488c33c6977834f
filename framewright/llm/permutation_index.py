"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample. A vector is represented by the order in which it sees the pivots and
posted in the inverted files of its nearest ones. The index is a table: for each block of rows one
inverted file a pivot, and the block's orders and vectors. A query reads the files of its own nearest
pivots; rows that it meets in enough of them are ranked by the footrule distance of the two orders,
and the best of these are reranked by exact inner product in double precision.

Rows and queries lie in blocks of bounded size; the index of a block answers a block of queries, and
the answers (at most k a query and block) are merged. No task holds more than two blocks and no row
is left out of the index. The same rules hold for every size: how many files must agree is a share of
those read, and sqrt(k n) of a block's n rows are reranked. For largest inner products vectors are
brought to one length by an extra component, which keeps the order of nearness; scores are always
those of the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import checkpointed

#: Pivots (a sample of at most so many rows; places fit a byte), files that a vector is posted in and a query
#: reads, and the share of these in which it must meet a row to rank it.
PIVOTS, POSTED, SHARED = 256, 48, 11 / 48
ROWS, QUERIES = 4096, 4096
LONG, BYTES = T.LongType(), T.BinaryType()
HITS = T.StructType([T.StructField("q_row", LONG), T.StructField("query_id", LONG), T.StructField("vec_id", LONG), T.StructField("score", T.DoubleType())])
#: pivot >= 0: its inverted file, as places in the block; pivot -1: ids, rows, places of the pivots and vectors.
INDEX = T.StructType([T.StructField("vb", T.IntegerType()), T.StructField("pivot", T.IntegerType()), T.StructField("ids", BYTES), T.StructField("rows", BYTES), T.StructField("places", BYTES), T.StructField("vectors", BYTES)])


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, vector) of rows that take part: not null, not zero, all components finite, and of the commonest length.

    Rows without an id can't be named in a result and take no part either. Repeated rows stay."""
    v = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    v = v.where("vector IS NOT NULL AND size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = checkpointed(v.where(F.exists("vector", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()))
    top = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vector") == (top.n if top else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivots of each vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")


def places_of(order: np.ndarray) -> np.ndarray:
    """The place of each pivot in each order."""
    place = np.empty(order.shape, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None], 1)
    return place


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of one length: scaled by the longest, and a component more that makes up for the rest."""
    unit = vectors / longest
    return np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))])


class Block:
    """A block of the index: inverted files, orders and vectors."""

    def __init__(self, files: list[np.ndarray], ids: np.ndarray, rows: np.ndarray, places: np.ndarray, vectors: np.ndarray):
        self.files, self.ids, self.rows, self.places, self.vectors = files, ids, rows, places, vectors

    @staticmethod
    def of(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, posted: int) -> Block:
        places = places_of(orders(lifted(vectors, longest), pivots))
        return Block([np.flatnonzero(places[:, j] < posted) for j in range(len(pivots))], ids, rows, places, vectors)

    def table(self, vb: int) -> pd.DataFrame:
        files = [(vb, j, None, f.astype(np.uint16).tobytes(), None, None) for j, f in enumerate(self.files)]
        return pd.DataFrame([*files, (vb, -1, self.ids.tobytes(), self.rows.tobytes(), self.places.tobytes(), self.vectors.tobytes())], columns=INDEX.names)

    @staticmethod
    def read(table: pd.DataFrame) -> Block:
        whole = table[table["pivot"] < 0].iloc[0]
        files = table[table["pivot"] >= 0].sort_values("pivot")
        ids = np.frombuffer(whole["ids"], np.int64)
        shaped = lambda name, kind: np.frombuffer(whole[name], kind).reshape(len(ids), -1)
        return Block([np.frombuffer(f, np.uint16) for f in files["rows"]], ids, np.frombuffer(whole["rows"], np.int64), shaped("places", np.uint8), shaped("vectors", np.float64))

    def search(self, queries: np.ndarray, q_rows: np.ndarray, pivots: np.ndarray, k: int, posted: int, shared: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Of each query the places of its k nearest found, nearest first, their scores, and how many rows were ranked."""
        n = len(self.ids)
        length = np.sqrt((queries * queries).sum(1))[:, None]
        order = orders(np.column_stack([queries / length, np.zeros(len(queries))]), pivots)
        q_places = places_of(order).astype(np.int16)
        need, most = math.ceil(shared * min(posted, len(pivots))), math.ceil(math.sqrt(k * n))
        out = []
        for q, q_row, seen, at in zip(queries, q_rows, order, q_places, strict=True):
            met = np.bincount(np.concatenate([self.files[j] for j in seen[:posted]]), minlength=n)
            met[self.rows == q_row] = -1
            found = np.flatnonzero(met >= need)
            if len(found) < k:  # too few meet so often: as many as are asked for, those that meet most
                found = np.flatnonzero(met >= max(0, np.partition(met, max(0, n - k))[max(0, n - k)]))
            ranked = len(found)
            if ranked > most:
                footrule = np.abs(self.places[found] - at).sum(1, dtype=np.int32)
                found = found[np.lexsort((self.ids[found], footrule))[:most]]
            score = (self.vectors[found] * q).sum(1)
            best = np.lexsort((self.ids[found], -score))[:k]
            out.append((found[best], score[best], ranked))
        return out


def index(df: DataFrame, pivots: np.ndarray, longest: float, n: int, posted: int = POSTED, rows: int = ROWS) -> DataFrame:
    """The index table of all rows of `df` (row, id, vector), in blocks of about `rows`. Built once; searches only read it."""
    shared = df.sparkSession.sparkContext.broadcast((pivots, longest))  # at most PIVOTS vectors
    blocks = max(1, -(-n // rows))

    def build(key: tuple, v: pd.DataFrame) -> pd.DataFrame:
        return Block.of(v["id"].to_numpy(), v["row"].to_numpy(), matrix(v["vector"]), *shared.value, posted).table(key[0])

    return checkpointed(df.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("vb")).applyInPandas(build, INDEX))


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, posted: int = POSTED, shared: float = SHARED, pivots: int = PIVOTS, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, without itself.

    `queries` holds the condition-filtered rows of `df` as usable() gives them (row, id, vector).
    Null, zero and non-finite vectors take no part; equal scores go to smaller ids; rows that repeat
    are separate candidates. `df` is as usable() gives it; an empty one gives no rows."""
    n, longest = df.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if pivots > 256:
        raise ValueError("the place of a pivot fits a byte: 256 pivots at most")
    sample = df.orderBy(F.xxhash64("id", "vector"), "row").limit(pivots).select("vector").collect()  # at most `pivots` rows
    p = lifted(np.array([r.vector for r in sample]), float(longest))
    table = index(df, p, float(longest), n, posted, rows)
    known = spark.sparkContext.broadcast(p)
    v_blocks, q_blocks = max(1, -(-n // rows)), max(1, -(-queries.count() // QUERIES))
    left = table.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = queries.select(F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"), "row", "id", "vector")

    def answer(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({f.name: [] for f in HITS}).astype({"q_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        block, qids, qrows = Block.read(v), q["id"].to_numpy(), q["row"].to_numpy()
        got = block.search(matrix(q["vector"]), qrows, known.value, k, posted, shared)
        sizes = [len(f) for f, *_ in got]
        return pd.DataFrame({"q_row": np.repeat(qrows, sizes), "query_id": np.repeat(qids, sizes), "vec_id": np.concatenate([block.ids[f] for f, *_ in got]), "score": np.concatenate([s for _, s, _ in got])})

    hits = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(answer, HITS)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q_row", "query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
