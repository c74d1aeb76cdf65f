"""SimHash components by the generalised pigeonhole principle, and near-duplicates by them and by prefixes of sets of shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LEAST_HOT, MOST_HOT, MOST_KEYS, components, discard, joined, kept_rows, map_arrow, stored, text_key

BITS, SEED = 64, 42
#: Buckets with more members than this are linked through midpoints, not by pairs (radius 2 and less). About where
#: comparing a member with all others costs as much as shuffling its one-bit neighbours.
MOST_PAIRED = 1024
#: A radius is divided over at most so many parts; conditions over more would outgrow what the JVM compiles.
MOST_PARTS = 8
#: A part's signature is probed in at most so many variants.
MOST_VARIANTS = 800
#: Cost of probing a signature (made, shuffled, sorted) in comparisons of two fingerprints.
PROBE_COST = 50
#: Shingles that heads put last, and shingles that are counted at a time to find them.
COMMON, COUNTED = 1 << 17, 1 << 20
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16
#: Parities of a set, and words of 64 that they take.
SKETCH, WORDS = 256, 4
#: Parities for each element of a set in its long sketch, at least, and most of them in all.
SPARSE, MOST_SKETCH = 2, 1 << 20
#: Bounds computed from a similarity in floating point are looser by this, so that pairs right at it stay.
SLACK = 1e-6
#: Orders of documents by which buckets choose the member that all their members are compared with before pairs are.
LEADERS = 4


# --- fingerprints


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of fewer words the whole sequence, of none nothing. A-Z are lowered."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = zip(*[words[i:] for i in range(k)], strict=False)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number; a bit is set if it is in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        raw = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def head(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None, rank: np.ndarray | None = None) -> list[int]:
    """Of a set of hashes in order the first few, of which sets of at least that Jaccard similarity share one.

    Hashes in `common` (in order) come after all others, by their `rank`. Any order that all sets share gives such heads.
    """
    n = len(hashes)
    if not n:
        return []
    if common is not None and len(common):
        at = np.searchsorted(common, hashes) % len(common)
        last = np.where(common[at] == hashes, rank[at] + 1, 0)
        if last.any():
            hashes = hashes[np.argsort(last, kind="stable")]
    return hashes[: n - math.ceil(similarity * n - SLACK) + 1].view(np.int64).tolist()


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes whether each of SKETCH ranges holds an odd number, as 64-bit words. Two sets differ in at least as many elements as in parities."""
    odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """parities() by a set's size, as bytes: SPARSE for each element, rounded up to a power of two, by the hashes' last bits."""
    bits = min(MOST_SKETCH, max(SKETCH, 1 << (SPARSE * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sketches in how many parities they differ, the longer one's added up to the shorter one's: two sets differ in at least as many elements."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def most_apart(similarity: float, sizes):
    """Of two sets of at least that similarity the difference holds at most this share of the sum of both sizes."""
    return (1 - similarity) / (1 + similarity) * sizes + SLACK


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of each whole text: doc_id, fp (signed 64-bit), n (different shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes = [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), shingle)
                fps.append(fingerprint(h))
                sizes.append(len(np.unique(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "fp", "n"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long, n long")


@dataclass(frozen=True)
class Common:
    """Shingles that come in most documents: hashes in order, ranks from rarer to commoner, and from which rank on they are hot."""

    hashes: np.ndarray
    ranks: np.ndarray
    hot: int

    def heads(self, hashes: np.ndarray, similarity: float) -> tuple[list[int], int]:
        """head() of a set, and how many in it aren't hot; those come first."""
        out = head(hashes, similarity, self.hashes, self.ranks)
        if not len(self.hashes) or not out:
            return out, len(out)
        keys = np.array(out, dtype=np.int64).view(np.uint64)
        at = np.searchsorted(self.hashes, keys) % len(self.hashes)
        return out, int(((self.hashes[at] != keys) | (self.ranks[at] < self.hot)).sum())


def common_shingles(docs: DataFrame, shingle: int, limit: int) -> Common:
    """At most COMMON shingles that come in most documents; those in over `limit` documents are hot.

    Of every run of about COUNTED shingles those of two documents and more are counted. They set only the order of heads and which buckets are broadcast, so what
    isn't among them costs time and no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            h, k = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": h[k > 1].view(np.int64), "k": k[k > 1].astype(np.int64)})

        sets, total = [], 0
        for batch in batches:
            for text in batch.column(0):
                sets.append(np.unique(shingle_hashes(text.as_py(), shingle)))
                total += len(sets[-1])
                if total >= COUNTED:
                    yield counted(sets)
                    sets, total = [], 0
        if sets:
            yield counted(sets)

    found = map_arrow(docs.select("text"), run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    found = found.orderBy(F.desc("k"), "h").limit(COMMON).toArrow()
    h, k = (found.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(h.view(np.uint64))
    return Common(h.view(np.uint64)[order], np.arange(len(h), 0, -1)[order], len(h) - int((k > limit).sum()) + 1)


def text_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """What stands for each whole text: doc_id, h1, h2 (text_key), fp (of the set of shingles), n (different shingles), parities, head, cool (entries of it that aren't hot)."""
    limit = max(LEAST_HOT, docs.count() // MOST_HOT)
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle, limit))
    names = ["doc_id", "h1", "h2", "fp", "n", "parities", "head", "cool"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps, sizes, marks, heads, cool = [], [], [], [], []
                for text in part.column(3):
                    h = np.unique(shingle_hashes(text.as_py(), shingle))
                    own, few = shared.value.heads(h, similarity)
                    fps.append(fingerprint(h))
                    sizes.append(len(h))
                    marks.append(parities(h).tolist())
                    heads.append(own)
                    cool.append(few)
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (marks, heads)]
                columns = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *lists, pa.array(cool, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names)

    rows = docs.select(F.col("doc_id").cast("long"), *text_key(), "text")
    return map_arrow(rows, run, "doc_id long, h1 long, h2 long, fp long, n long, parities array<long>, head array<long>, cool long")


# --- parts and thresholds


@dataclass(frozen=True)
class Part:
    """Bits of a fingerprint, and how many of them may differ. A threshold of -1 leaves the part out."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    @property
    def flips(self) -> list[int]:
        """What to xor with a signature for all signatures within the threshold."""
        return [signed(sum(1 << b for b in c)) for t in range(self.threshold + 1) for c in combinations(self.bits, t)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and in how many each pair of bits is set; summed on the executors, 64 x 64 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            raw = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype="<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        cells = np.append(total.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(cells), dtype=np.int32), "n": cells})

    sums = map_arrow(fps.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in sums:
        cells[r.cell] = r.n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(corr: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in `parts` groups of nearly equal size, each filled with the bits most correlated with what it holds."""
    free, out = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        own = [max(free, key=lambda b: (sum(corr[b, x] for x in free), -b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (sum(corr[b, x] for x in own), -b)))
            free.remove(own[-1])
        out.append(tuple(sorted(own)))
    return out


def within(bits: tuple[int, ...], share: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Estimated share of pairs that differ in at most t of the bits, by t; correlated bits count as fewer."""
    dist = np.array([1.0])
    for b in bits:
        d = 2 * share[b] * (1 - share[b])
        dist = np.append(dist * (1 - d), 0) + np.append(0, dist * d)
    sub = corr[np.ix_(bits, bits)]
    return np.cumsum(dist) ** (len(bits) / float((sub**2).sum()))


def plan_parts(n: int, both: np.ndarray, radius: int, selectivity: float = 1.0) -> list[Part]:
    """Parts and thresholds of the least estimated cost: signatures probed, at PROBE_COST each, plus pairs compared.

    If two fingerprints differ in at most `radius` bits, they differ in at most threshold bits of some part, as thresholds
    plus one add up to radius + 1. For each number of parts, dynamic programming over the parts divides that sum.
    """
    share = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(sd, sd)).clip(0, 1)
    np.fill_diagonal(corr, 1)
    best: tuple[float, list[Part]] = (math.inf, [])
    for m in range(1, min(radius + 1, MOST_PARTS) + 1):
        groups = group_bits(corr, m)
        # least[s]: cost and thresholds of the parts so far, whose thresholds plus one add up to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            near, step = within(bits, share, corr), {}
            for s, (cost, ts) in least.items():
                for t in range(-1, min(len(bits), radius - s) + 1):
                    v = sum(math.comb(len(bits), k) for k in range(t + 1))
                    if s + t + 1 > radius + 1 or v > MOST_VARIANTS:
                        break
                    # An index holds each signature once, so pairs that differ in t bits meet on one signature.
                    c = cost + (PROBE_COST * v * n + selectivity * n * n / 2 * near[t] if t >= 0 else 0)
                    if c < step.get(s + t + 1, (math.inf,))[0]:
                        step[s + t + 1] = (c, [*ts, t])
            least = step
        if radius + 1 in least and least[radius + 1][0] < best[0]:
            best = (least[radius + 1][0], [Part(b, t) for b, t in zip(groups, least[radius + 1][1], strict=True)])
    return [p for p in best[1] if p.threshold >= 0]


def signatures(nodes: DataFrame, parts: list[Part], probe: bool) -> DataFrame:
    """A row for each part: part, key; with `probe` one for each signature within the part's threshold."""
    each = [F.struct(F.lit(i).alias("part"), F.lit(p.mask).alias("mask"), F.array(*[F.lit(x) for x in (p.flips if probe else [0])]).alias("flips")) for i, p in enumerate(parts)]
    out = nodes.withColumn("__p", F.explode(F.array(*each)))
    out = out.withColumn("__f", F.explode("__p.flips"))
    key = F.col("fp").bitwiseAND(F.col("__p.mask")).bitwiseXOR(F.col("__f"))
    return out.select(*nodes.columns, F.col("__p.part").alias("part"), key.alias("key"))


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


# --- links between fingerprints


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between different fingerprints with the components of all pairs within `radius` bits.

    Up to a radius of 2 no bucket, whatever its part's threshold, makes more than MOST_PAIRED pairs a member: all that index or probe a larger one send themselves to
    themselves and their one-bit neighbours, and link to the least that arrives there. Two members within two bits meet
    there, and all that meet are within two bits, so the components are the same and work is linear in the bucket; at most BITS + 1 meet at a place. Beyond that radius all pairs of a bucket are compared.
    """
    n, both = bit_counts(fps)
    parts = plan_parts(n, both, radius)
    index = signatures(fps.select("fp"), parts, probe=False)
    plain = not any(p.threshold for p in parts)
    probes = index if plain else signatures(fps.select("fp"), parts, probe=True)
    near, key = distance("a", "b") <= radius, ["part", "key"]

    def pairs(probes: DataFrame, index: DataFrame) -> DataFrame:
        met = probes.withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), key)
        return met.where((F.col("a") < F.col("b")) & near).select("a", "b")

    if radius > 2:
        return pairs(probes, index)
    # A bucket counts if something is indexed there; what probes it may lie elsewhere itself.
    asked = index.select(*key, F.lit(1).alias("own"))
    asked = asked if plain else asked.unionAll(probes.select(*key, F.lit(0).alias("own")))
    sizes = asked.groupBy(*key).agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("all"))
    hot = stored(sizes.where((F.col("own") > 0) & (F.greatest(F.col("own"), F.col("all") - F.col("own")) > MOST_PAIRED)).select(*key), "hot")
    cool = pairs(probes.join(hot, key, "left_anti"), index)
    if hot.isEmpty():
        return cool
    met = probes.join(hot, key, "left_semi").select("fp")
    met = (met if plain else met.unionAll(index.join(hot, key, "left_semi").select("fp"))).distinct()
    flips = F.array(*[F.lit(signed(1 << x)) for x in range(BITS)], F.lit(0))
    at = met.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = at.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    star = at.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return cool.unionAll(star)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Each document's fingerprint and component: doc_id, fp (signed), component_id.

    Fingerprints link at `radius` or fewer differing bits, equal ones included, and a component is all that links reach;
    its id is its smallest doc_id (null if all are). Links are sought between different fingerprints only, so copies cost nothing, and rows of a hot fingerprint aren't shuffled by it. Null and
    empty texts have fingerprint zero, which links like any other; very long texts are hashed whole. Repeated rows stay. Other columns aren't looked at, whatever their names. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle).select("doc_id", "fp"), "fps")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    comps = components(fingerprint_links(fps, radius))
    named = fps.join(comps, fps.fp == comps.node, "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    names = joined(named, least, ["component"], "fps", fps.count()).select("fp", "n", "component_id")
    return joined(rows, stored(names, "names"), ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


# --- near-duplicate documents, verified


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, repeats: bool) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets of shingles have at least this Jaccard similarity, as a stored table. Only texts in pairs are hashed again.

    Sketches of the sets, a thirty-second to a sixteenth of their size, rule out most pairs a little below the similarity, so whole sets are moved for the others only. `repeats` says whether several rows may have a node's text, one of which is used.
    """
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(nodes.select("id", "h1", "h2").join(ids, "id", "left_semi"), "ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                own = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                blobs = [pa.array(x, pa.binary()) for x in ([h.astype("<u8").tobytes() for h in own], [sketch(h).tobytes() for h in own])]
                yield pa.RecordBatch.from_arrays([part.column(0), *blobs, pa.array([len(h) for h in own], pa.int64())], ["id", "set", "mark", "n"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(similarity, batch.column(2).to_numpy())
            marks = zip(batch.column(3), batch.column(4), most, strict=True)
            ok = [least_apart(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)) <= m for x, y, m in marks]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    few = F.broadcast(ids) if ids.count() <= MOST_KEYS else ids
    own = docs.select(*text_key(), "text").join(few, ["h1", "h2"]).select("id", "text")
    own = map_arrow(own, sets, "id long, set binary, mark binary, n long")
    own = stored(own.dropDuplicates(["id"]) if repeats else own, "sets")
    left, right = (own.select(F.col("id").alias(i), F.col("mark").alias(x), F.col("n").alias(f"n{x}")) for i, x in (("a", "x"), ("b", "y")))
    marked = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("nx") + F.col("ny")).alias("n"), "x", "y")
    near = stored(map_arrow(marked, sift, "a long, b long"), "sifted")
    few = near.count() <= MOST_KEYS
    left, right = (own.select(F.col("id").alias(i), F.col("set").alias(x)) for i, x in (("a", "x"), ("b", "y")))
    left = left.join(F.broadcast(near) if few else near, "a")
    last = near.select("b").distinct()
    right = right.join(F.broadcast(last) if few else last, "b", "left_semi")
    links = stored(map_arrow(left.join(right, "b").select("a", "b", "x", "y"), keep, "a long, b long"), "links")
    discard(own)
    return links


def fingerprint_pairs(nodes: DataFrame, radius: int, total: int) -> DataFrame:
    """Pairs of nodes (a, b) that join all whose fingerprints lie within `radius` bits: members of a fingerprint with its first, and firsts of fingerprints that link."""
    fps = stored(nodes.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")), "fps")
    same = joined(nodes.select("id", "fp"), fps.where("m > 1"), ["fp"], "m", total).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = fingerprint_links(fps, radius)
    for x in ("a", "b"):
        links = links.join(fps.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_")), x)
    return same.unionAll(links.select(F.greatest("a_", "b_").alias("a"), F.least("a_", "b_").alias("b")))


def linked_texts(rows: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int, repeats: bool) -> DataFrame:
    """Links (a, b) between rows of text_sets(), numbered by id and of different texts, with the components of all pairs of at least the similarity."""
    nodes = rows.where("n > 0")

    def may(x: str, y: str) -> Column:
        """Whether sets can be similar by their sizes, and if nothing before their places `at` is shared."""
        few, many = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        shared = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
        return (few >= F.lit(similarity) * many - SLACK) & (shared >= F.lit(similarity / (1 + similarity)) * (few + many) - SLACK)

    def pair(x: str, y: str) -> list[Column]:
        return [F.greatest(f"{x}.id", f"{y}.id").alias("a"), F.least(f"{x}.id", f"{y}.id").alias("b")]

    def near(pa: str, pb: str, sizes: Column) -> Column:
        """Whether sets can be similar by their parities."""
        return sum((distance(F.get(pa, i), F.get(pb, i)) for i in range(1, WORDS)), distance(F.get(pa, 0), F.get(pb, 0))) <= most_apart(similarity, sizes)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that sizes and parities don't rule out, verified."""
        pairs = pairs.distinct()
        for x in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("parities").alias(f"p{x}")), x)
        sizes = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - SLACK
        return verified(stored(pairs.where(sizes & near("pa", "pb", F.col("na") + F.col("nb"))).select("a", "b"), "candidates"), nodes, docs, shingle, similarity, repeats)

    entry = F.struct("id", "n", "at")
    entries = nodes.select("id", "n", "cool", F.posexplode("head").alias("at", "key"))
    # A bucket's leader is the first by one of LEADERS orders of documents.
    order = F.xxhash64("id", F.pmod("key", F.lit(LEADERS)))
    bucket = Window.partitionBy("key").orderBy(order, "id")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = entries.where("at < cool").withColumn("lead", F.first(entry).over(bucket)).withColumn("last", F.last("id").over(whole))
    met = met.where(F.col("lead.id") != F.col("last")).select("key", "id", "n", "at", "lead")
    # Hot buckets, COMMON at most, are aggregated on the map side, and their leaders are broadcast. A large group has many of them in common, so one order is enough.
    hot = entries.where("at >= cool")
    leads = hot.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("o"), "id", "n", "at")).alias("l"), F.max("id").alias("high"), F.min("id").alias("low"))
    leads = leads.where("low < high").select("key", F.struct("l.id", "l.n", "l.at").alias("lead"))
    met = stored(met.withColumn("hot", F.lit(False)).unionAll(hot.join(F.broadcast(leads), "key").select("key", "id", "n", "at", "lead", F.lit(True).alias("hot"))), "met")
    star = met.select(F.struct("id", "n", "at").alias("p"), F.col("lead").alias("q")).where(F.col("p.id") != F.col("q.id"))
    star = star.where(may("p", "q")).select(*pair("p", "q"))
    first = linked(stored(fingerprint_pairs(nodes, radius, rows.count()), "near").unionAll(star))
    comps = stored(components(first), "joined")
    # Leaders have met all others of their buckets, so of a bucket of two nothing is left.
    met = met.where(F.col("id") != F.col("lead.id")).join(comps, met.id == comps.node, "left").select("key", "hot", "id", "n", "at", F.coalesce("component", "id").alias("g"))
    # Groups that meet in a bucket, and then their members: those of a bucket with one group aren't touched again.
    several = met.groupBy("key", "hot").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key", "hot")
    entry = [F.struct("id", "n", "at").alias(x) for x in ("p", "q")]
    cold = stored(met.where("not hot").join(several.where("not hot").select("key"), "key", "left_semi").select("key", "id", "n", "at", "g"), "several")
    p, q = (cold.select("key", F.col("g").alias(g), e) for g, e in zip(("g1", "g2"), entry, strict=True))
    more = p.join(q, "key").where((F.col("g1") < F.col("g2")) & may("p", "q")).select(*pair("p", "q"))
    # In a hot bucket groups are paired first, as one may hold most of its members.
    hot = met.where("hot").join(F.broadcast(several.where("hot").select("key")), "key", "left_semi").join(nodes.select("id", "parities"), "id")
    hot = stored(hot.select("key", "id", "n", "at", "parities", "g"), "several")
    groups = hot.groupBy("key", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("reach"), F.count(F.lit(1)).alias("m"))
    x, y = (groups.toDF("key", *[f"{c}{i}" for c in ("g", "lo", "hi", "reach", "m")]) for i in (1, 2))
    # What may() says of members, by bounds of groups.
    sizes = (F.col("hi1") >= F.lit(similarity) * F.col("lo2") - SLACK) & (F.col("hi2") >= F.lit(similarity) * F.col("lo1") - SLACK)
    shared = F.least("reach1", "reach2") >= F.lit(similarity / (1 + similarity)) * (F.col("lo1") + F.col("lo2")) - SLACK
    # The smaller group's members come first, and parities are compared in the join: neither makes rows by the product of groups.
    two = x.join(y, "key").where((F.struct("m1", "g1") < F.struct(F.col("m2").alias("m1"), F.col("g2").alias("g1"))) & sizes & shared).select("key", "g1", "g2")
    p, q = (hot.select("key", F.col("g").alias(g), F.struct("id", "n", "at", "parities").alias(x)) for g, x in (("g1", "p"), ("g2", "q")))
    alike = may("p", "q") & near("p.parities", "q.parities", F.col("p.n") + F.col("q.n"))
    more = more.unionAll(two.join(p, ["key", "g1"]).join(q, ["key", "g2"]).where(alike).select(*pair("p", "q")))
    more = linked(more)
    return first.unionAll(more)


def grouped_texts(docs: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """Rows (id, doc_id, h1, h2, first): ids number the rows, and first is what stays of a row's group, as (no, doc_id, h1, h2, id); null where a row is alone."""
    rows = stored(text_sets(docs, shingle, similarity).withColumn("id", F.monotonically_increasing_id()), "sets")
    total, key = rows.count(), ["h1", "h2"]
    same = rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    twice = stored(same.where("m > 1"), "twice")
    members = rows.select("id", "doc_id", *key)
    repeats = not twice.isEmpty()
    if not repeats:
        texts, members = rows, members.withColumn("rep", F.col("id"))
    else:  # equal texts are one node, however many rows they have
        members = joined(members, twice, key, "m", total, "left").select("id", "doc_id", *key, F.coalesce("rep", "id").alias("rep"))
        members = stored(members, "members")
        texts = stored(rows.join(members.where("id <> rep").select("id"), "id", "left_anti"), "texts")
    comps = components(linked_texts(texts, docs, shingle, similarity, radius, repeats))
    members = stored(members.join(comps, members.rep == comps.node, "left").select("id", "doc_id", *key, F.coalesce("component", "rep").alias("g")), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", *key, "id"))
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), first.alias("first")).where("m > 1")
    return joined(members, stored(groups, "firsts"), ["g"], "m", total, "left").select("id", "doc_id", *key, "first")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """Groups of near-duplicates: doc_id, keep_id (the smallest doc_id of the group), kept (of each group exactly one row).

    Documents link if their sets of word shingles have this Jaccard similarity, checked on whole texts, and all such pairs are
    joined, of any size. Fingerprints of the sets within `radius` bits are found by the generalised pigeonhole principle. Most pairs right at the similarity lie further
    apart than any radius that could be probed, so sets also meet on shared shingles: similar ones share one of their first in an order that puts common ones last (head), and
    neither their sizes, the place of the first shared shingle nor their parities, which bound what sets can share, rule the pair out. First each document is compared
    with one other of each bucket; then pairs of a bucket that nothing has joined yet are, so a large group of near copies costs little more than its size.

    Rows are told apart by a number of their own: rows of one doc_id link by their texts as others do. Of a group the smallest doc_id stays (null ones last; of equal ones
    that with the smallest hash of the text, of repeated rows one). Equal texts are one node, repeats cost nothing. Texts without words, null ones included, are like only their equals.
    Other columns aren't looked at, whatever their names. An empty table gives no rows.
    """
    out = grouped_texts(docs, shingle, similarity, radius)
    keep = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce(F.col("id") == F.col("first.id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of `docs` that near_duplicates() keeps, with all columns, whatever their names.

    Rows are told apart by doc_id and 128 bits of the text; of repeated rows of one that stays one does, whichever its other columns are. Nulls, long texts and empty tables
    are treated as there.
    """
    rows = grouped_texts(docs, shingle, similarity, radius)
    own = F.coalesce(F.col("id") == F.col("first.id"), F.lit(True))
    fates = rows.groupBy("doc_id", "h1", "h2").agg(F.max(own).alias("kept"), F.count(F.lit(1)).alias("n"))
    return kept_rows(docs, fates, "gone")
