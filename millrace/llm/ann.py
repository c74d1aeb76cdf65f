"""Nearest neighbours by multi-index hashing over learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import MOST_KEYS, map_arrow, stored

#: Bits of a substring that are tried, shortest first; a code has whole substrings of each.
LENGTHS = (16, 32, 64, 128, 256)
#: Vectors of an index block and of a query block.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 8192
#: Vectors that rotations are fitted on, and queries that the radius is read off and substrings are chosen by.
FITTED, TRIED = 4096, 200
#: Signatures within a threshold are looked up one by one up to so many; more are found by comparing a table's values.
MOST_PROBES = 700
#: Cost of comparing a value in a table, of comparing whole codes and of a distance, relative to each other.
VALUE_COST, CODE_COST, FLOAT_COST = 1.0, 4.0, 40.0


def learn_rotations(x: np.ndarray, codes: int, steps: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and a matrix whose signs are the bits: `codes` rotations of the principal axes, each fitted so that its signs lie near the data."""
    mean = x.mean(axis=0)
    v = x - mean
    axes = np.linalg.svd(v.T @ v)[0]
    v, rng, out = v @ axes, np.random.default_rng(seed), []
    for _ in range(codes):
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.hstack(out)


def encode(x: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, filled up to a whole number of the longest substring."""
    bits = (x - mean) @ matrix > 0
    pad = -bits.shape[1] % LENGTHS[-1]
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def apart(words: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ code).sum(axis=1, dtype=np.int64)


def thresholds(radius: int, parts: int) -> np.ndarray:
    """Codes within the radius differ in at most so many bits in some part: thresholds plus one add up to radius + 1."""
    total = radius + 1
    return np.array([total // parts + (i < total % parts) for i in range(parts)]) - 1


@cache
def flips(length: int, least: int) -> np.ndarray | None:
    """What to xor with a substring for all within the threshold; none if they are more than MOST_PROBES."""
    out = [0]
    for t in range(1, least + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(length), t)] if len(out) <= MOST_PROBES else []
        if len(out) > MOST_PROBES:
            return None
    return np.array(out, dtype=f"u{length // 8}")


class Index:
    """A table for each substring: which vectors of a block have which value."""

    def __init__(self, words: np.ndarray, length: int):
        self.words, self.length = words, length
        self.tables = []
        if length <= 64:
            for value in np.ascontiguousarray(words).view(f"u{length // 8}").T:
                order = np.argsort(value, kind="stable")
                values, starts = np.unique(value[order], return_index=True)
                self.tables.append((values, np.append(starts, len(value)), order))
        else:  # as good as every vector has a value of its own
            w = length // 64
            self.tables = [np.ascontiguousarray(words[:, i : i + w]) for i in range(0, words.shape[1], w)]

    def probed(self, code: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Positions in buckets within the threshold of some substring."""
        met = np.zeros(len(self.words), dtype=bool)
        if self.length > 64:
            w = self.length // 64
            for k, values in enumerate(self.tables):
                if least[k] >= 0:
                    met |= apart(values, code[k * w : k * w + w]) <= least[k]
            return np.flatnonzero(met)
        for k, ((values, starts, order), own) in enumerate(zip(self.tables, code.view(f"u{self.length // 8}"), strict=True)):
            if least[k] < 0:
                continue
            near = flips(self.length, int(least[k]))
            if near is not None and len(near) < len(values):
                asked = near ^ own
                at = np.searchsorted(values, asked)
                at = at[at < len(values)][values[at[at < len(values)]] == asked[at < len(values)]]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ own) <= least[k])
            for i in at.tolist():
                met[order[starts[i] : starts[i + 1]]] = True
        return np.flatnonzero(met)

    def within(self, code: np.ndarray, radius: int, least: np.ndarray) -> np.ndarray:
        """Positions of every code within the radius: the pigeonhole principle says which buckets to look into."""
        found = self.probed(code, least)
        return found[apart(self.words[found], code) <= radius]


def nearest(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest by Euclidean distance, ties to the smaller id; rows with the query's id don't count."""
    keep = ids != own
    ids, d = ids[keep], np.sqrt(((x[keep].astype(np.float64) - q) ** 2).sum(axis=1))
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:k]
    return list(zip(ids[order].tolist(), d[order].tolist(), strict=True))


class Model:
    """Rotations, the radius and the length of substrings."""

    def __init__(self, x: np.ndarray, n: int, k: int, codes: int, reach: float):
        """From a sample `x` of n vectors.

        A sample has fewer near neighbours than the table: k of n vectors correspond to k * len(x) / n of the sample. The radius is the one within which `reach` of those
        lie. The length is the one of least estimated cost: values compared, codes of vectors that are probed, and distances of those within the radius.
        """
        self.mean, self.matrix = learn_rotations(x[:FITTED], codes)
        words, far = encode(x, self.mean, self.matrix), []
        few = max(1, round(k * len(x) / max(n, 1)))
        for i in range(min(TRIED, len(x))):
            near = [j for j, _ in nearest(np.arange(len(x)), x, i, x[i], few)]
            far += apart(words[near], words[i]).tolist()
        self.bits = words.shape[1] * 64
        self.radius = int(np.quantile(far, reach, method="higher")) if far else self.bits
        self.length, best = LENGTHS[-1], np.inf
        for length in LENGTHS:
            table, least = Index(words, length), thresholds(self.radius, self.bits // length)
            values = sum(len(t) if length > 64 else len(t[0]) for t in table.tables)
            met = np.mean([len(table.probed(words[i], least)) for i in range(min(20, len(x)))])
            cost = VALUE_COST * values * max(1, length // 64) + CODE_COST * met
            if cost < best:
                self.length, best = length, cost
        self.least = thresholds(self.radius, self.bits // self.length)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that take part: not null or zero, of the most frequent length, all components finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null").where(fine & F.exists("embedding", lambda x: x != 0))
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (top[0].d if top else 0))


def matrix_of(column: pa.Array, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def pack(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Vectors in blocks: an id and the bytes of vec_ids and of their vectors, in the precision that they have."""
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
                xs.append(matrix_of(part.column(1), kind))
                while sum(map(len, ids)) >= block:
                    i, x = np.concatenate(ids), np.concatenate(xs)
                    yield pa.RecordBatch.from_pydict({"ids": [i[:block].tobytes()], "xs": [x[:block].tobytes()]})
                    ids, xs = [i[block:]], [x[block:]]
        if sum(map(len, ids)):
            yield pa.RecordBatch.from_pydict({"ids": [np.concatenate(ids).tobytes()], "xs": [np.concatenate(xs).tobytes()]})

    return stored(map_arrow(rows, run, "ids binary, xs binary").withColumn("block", F.monotonically_increasing_id()), name)


def search(index: DataFrame, queries: DataFrame, model: Model, kind: str, k: int, every: bool = False) -> DataFrame:
    """Each query's k nearest in each index block: query_id, block, vec_id, score, probed (vectors in buckets that were looked into). With `every` all vectors are compared.

    A block of queries meets each index block in a task of its own choosing. Only numbers of blocks are dealt out; there is one in INDEX_BLOCK vectors.
    """
    spark, d = index.sparkSession, len(model.mean)
    shared = spark.sparkContext.broadcast(model)
    kinds = [("query_id", pa.int64()), ("block", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("probed", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, xs, qids, qs = (batch.column(j)[i].as_py() for j in range(5))
                ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                xs, qs = np.frombuffer(xs, kind).reshape(-1, d), np.frombuffer(qs, kind).reshape(-1, d).astype(np.float64)
                out: list[tuple] = []
                if every:
                    table = None
                else:
                    words = np.concatenate([encode(xs[a : a + 4096], m.mean, m.matrix) for a in range(0, len(xs), 4096)])
                    table, codes = Index(words, m.length), encode(qs, m.mean, m.matrix)
                for q in range(len(qids)):
                    at, n = np.arange(len(ids)), len(ids)
                    if table:
                        met = table.probed(codes[q], m.least)
                        at, n = met[apart(table.words[met], codes[q]) <= m.radius], len(met)
                    out += [(int(qids[q]), block, v, s, n) for v, s in nearest(ids[at], xs[at], qids[q], qs[q], k)]
                cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [c for c, _ in kinds])

    def numbers(blocks: DataFrame, name: str) -> DataFrame:
        out = blocks.select(F.col("block").alias(name))
        return F.broadcast(out) if blocks.count() <= MOST_KEYS else out

    # Each pair of blocks is a key of its own, so pairs spread over all tasks whatever the number of query blocks.
    here = index.crossJoin(numbers(queries, "q"))
    there = queries.select(F.col("block").alias("q"), F.col("ids").alias("qids"), F.col("xs").alias("qs")).crossJoin(numbers(index, "block"))
    pairs = here.join(there, ["block", "q"]).select("block", "ids", "xs", "qids", "qs")
    return map_arrow(pairs, run, "query_id long, block long, vec_id long, score double, probed long")


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best. Blocks have sent k each at most, so a query has k rows for INDEX_BLOCK vectors; the window drops others before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", "vec_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def nearest_vectors(vectors: DataFrame, every: int = 100, k: int = 10, codes: int = 8, sample: int = 16_384, reach: float = 0.99) -> DataFrame:
    """The k nearest vectors of each query (vec_id divisible by `every`) among all others: query_id, rank, vec_id, score.

    Score is the Euclidean distance in double precision. Codes are the signs of `codes` learned rotations, fitted on the
    vectors with the smallest hashes, `sample` at most, as are the radius and the length of substrings; every vector is indexed. Codes are split into
    substrings with a table each; probing retrieves every code within the radius, and its vectors are ranked as floats. Where data have little structure the radius
    is wide, short substrings let nearly all through, and long ones are chosen, whose values are compared instead of looked up. A query
    with fewer than k vectors within the radius is compared with all instead, so it gets k if there are k.

    Vectors that are null, zero, of another than the most frequent length or hold null or non-finite components take no part; nor does a null vec_id. Repeated
    rows are candidates each but one query; of different vectors with one vec_id the query is that with the smallest hash. Ties go to the smaller vec_id. Other columns aren't looked at, whatever
    their names; an empty table gives no rows. Query blocks meet index blocks pairwise: work is queries times vectors, as the query set is a share of the table.
    """
    rows = usable(vectors)
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    if not len(fit):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = Model(matrix_of(fit, "<f8"), rows.count(), k, codes, reach)
    index = pack(rows, INDEX_BLOCK, "index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = asked.groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    queries = pack(asked, QUERY_BLOCK, "queries")
    found = stored(top(search(index, queries, model, kind, k), k), "found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    few = pack(asked.join(full, asked.vec_id == full.query_id, "left_anti"), QUERY_BLOCK, "few")
    if not few.isEmpty():
        rest = top(search(index, few, model, kind, k, every=True), k)
        found = found.join(full, "query_id", "left_semi").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
