"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import give_back, map_arrow, stored

LABELLERS = ("symbols", "runs", "capitals", "bars", "separators", "repeats", "variety", "sentences", "lengths")
BAD, NONE, GOOD = 0, 1, 2
#: Hashed features of the scorer; the last is the constant.
FEATURES = 1 << 14
#: Documents with posteriors of each class that the scorer is fitted on.
SAMPLE = 1500
#: Documents that score less are rejected: clean ones that are lost weigh more than junk that stays.
THRESHOLD = 0.25
#: Fewest words for labellers that need statistics of words.
LEAST_WORDS = 8
#: Bytes by class: lower-case and longer characters, upper case, digits, blanks; symbols stand for themselves.
SHAPES = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


class Looked:
    """What labellers and scorer see of a whole text."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = raw.split()
        self.n = len(self.words)
        self.counts = Counter(self.words)
        shape = np.frombuffer(raw.translate(SHAPES), dtype=np.uint8)
        kind = np.bincount(shape, minlength=128)
        self.blanks, self.upper = int(kind[32]), int(kind[65])
        self.letters = int(kind[97]) + self.upper
        self.solid = len(raw) - self.blanks
        self.symbols = self.solid - self.letters - int(kind[48])
        same = shape[1:] == shape[:-1]
        mark = (shape[1:] != 97) & (shape[1:] != 65) & (shape[1:] != 48) & (shape[1:] != 32)
        self.runs = int((same & mark).sum())
        self.repeats = sum(map(eq, self.words, self.words[1:]))
        stop = np.isin(shape, np.frombuffer(b".!?", dtype=np.uint8))
        self.ends = int((stop[:-1] & (shape[1:] == 32)).sum()) + int(bool(len(stop)) and bool(stop[-1]))
        bare = shape != 32  # words without a letter or digit
        text = (shape == 97) | (shape == 65) | (shape == 48)
        first = np.flatnonzero(bare & np.append(True, ~bare[:-1])[: len(bare)])
        self.separators = int((np.add.reduceat(text, first) == 0).sum()) if len(first) else 0
        self.shape, self.same = shape, same

    def votes(self) -> list[int]:
        n = max(self.n, 1)

        def cut(value: float, good: float, bad: float) -> int:
            """Good up to a value, bad from another on, else no vote."""
            return GOOD if value <= good else BAD if value >= bad else NONE

        long = self.n >= LEAST_WORDS
        return [
            cut(self.symbols / max(self.solid, 1), 0.05, 0.1) if long else NONE,
            cut(self.runs / n, 0.02, 0.2) if long else NONE,
            cut(self.upper / max(self.letters, 1), 0.25, 0.5) if long else NONE,
            cut(self.counts[b"|"] / n, 0.0, 0.12) if long else NONE,
            cut(self.separators / n, 0.02, 0.12) if long else NONE,
            cut(self.repeats / n, 0.03, 0.25) if long else NONE,
            cut(-len(self.counts), -(n**0.7), -(n**0.5)) if self.n >= 4 * LEAST_WORDS else NONE,
            (BAD if self.ends == 0 else GOOD if self.ends <= 0.5 * n else NONE) if self.n >= 4 * LEAST_WORDS else NONE,
            (GOOD if 3 <= self.solid / n <= 9 else BAD if not 2 <= self.solid / n <= 20 else NONE) if long else NONE,
        ]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words, shapes of words (runs of a class as one) and rates, each group of length 1 at most."""
        n = max(self.n, 1)
        out: dict[int, float] = {FEATURES - 1: 1.0}
        shapes = Counter((self.shape[np.append(~self.same, True)].tobytes() if len(self.shape) else b"").split())
        for lead, counts in ((b"w", self.counts), (b"s", shapes)):
            if counts:
                v = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
                v /= np.sqrt((v * v).sum())
                for w, x in zip(counts, v.tolist(), strict=True):
                    k = zlib.crc32(w, lead[0]) % (FEATURES - 1)
                    out[k] = out.get(k, 0.0) + x
        for k, x in enumerate((self.repeats / n, self.counts[b"|"] / n, self.upper / max(self.letters, 1), self.symbols / max(self.solid, 1))):
            out[zlib.crc32(bytes([k]), 7) % (FEATURES - 1)] = min(1.0, 2 * x)
        return np.fromiter(out.keys(), dtype=np.int64, count=len(out)), np.fromiter(out.values(), dtype=np.float64, count=len(out))


def pattern_of(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


#: The pattern of texts that no labeller votes on; their posterior is the prior, which says nothing about them.
SILENT = pattern_of([NONE] * len(LABELLERS))


def accuracies(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of "good" by vote pattern, and each labeller's share of each vote given bad and good, by expectation-maximisation.

    `counts` are those of all documents by pattern, at most 3 ** len(LABELLERS) numbers. No vote is no evidence. Labellers are
    made to vote bad seldom, so it begins with documents that one of them calls bad as probably bad, and with two more so.
    """
    pats = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in pats], dtype=np.float64)
    m = len(LABELLERS)
    votes = np.array([[p // 3**i % 3 for i in range(m)] for p in pats], dtype=np.int64).reshape(-1, m)
    one = np.eye(3)[votes]
    one[:, :, NONE] = 0
    good = np.array([0.95, 0.1, 0.01])[np.minimum((votes == BAD).sum(axis=1), 2)]
    share = np.full((2, m, 3), 1 / 3)
    for _ in range(rounds if len(pats) else 0):
        both = np.stack([1 - good, good]) * n
        share = np.einsum("cp,pmv->cmv", both, one) + 0.1
        share /= share.sum(axis=2, keepdims=True)
        prior = (both.sum(axis=1) + 1) / (both.sum() + 2)
        ll = np.log(prior)[:, None] + np.einsum("pmv,cmv->cp", one, np.log(share))
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(pats.tolist(), good.tolist(), strict=True)), share


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 300, rate: float = 0.3, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression on posterior labels, classes weighing the same: accelerated full-batch gradient descent."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    weigh = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    m, v = np.zeros(FEATURES), np.zeros(FEATURES)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)), -50, 50)))
        g = np.bincount(at, x * ((p - y) * weigh)[row], FEATURES) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


class Classifier:
    """Posteriors by vote pattern and the scorer's weights."""

    def __init__(self, posterior: dict[int, float], share: np.ndarray, weights: np.ndarray):
        self.posterior, self.share, self.weights = posterior, share, weights

    def score(self, x: Looked) -> float:
        k, v = x.features()
        return float(1 / (1 + np.exp(-np.clip((self.weights[k] * v).sum(), -50, 50))))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Votes on all documents, accuracies from the counts of all vote patterns, and a scorer fitted to the posteriors.

    The scorer sees the `sample` documents of each class (posterior below and above a half) with the smallest hashes of doc_id, then of the text, of
    those that a labeller votes on: texts that are too short for any teach it nothing. Repeated rows are seen once. An empty class leaves it to the constant.
    """
    spark = docs.sparkSession

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pats = [pattern_of(Looked(t.as_py()).votes()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pats, pa.int64())], ["lot", "own", "pattern"])

    texts = docs.select(F.xxhash64("doc_id", F.lit("quality")).alias("lot"), F.xxhash64("text").alias("own"), "text")
    votes = stored(map_arrow(texts, vote, "lot long, own long, pattern long"), "votes")
    counts = {r.pattern: r.n for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior, share = accuracies(counts)
    ends = {}
    for good in (False, True):
        pats = [p for p, q in posterior.items() if (q > 0.5) == good and p != SILENT]
        own = votes.where(F.col("pattern").isin(pats)).select("lot", "own").distinct().orderBy("lot", "own").limit(sample) if pats else None
        end = own.agg(F.max(F.struct("lot", "own"))).first()[0] if own else None
        ends[good] = tuple(end) if end else None
    top = max((e[0] for e in ends.values() if e), default=None)
    rows = []
    if top is not None:
        shared = spark.sparkContext.broadcast((posterior, ends))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            posterior, ends = shared.value
            for batch in batches:
                out = []
                for lot, own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    x = Looked(t.as_py())
                    p = pattern_of(x.votes())
                    q = posterior[p]
                    end = ends[q > 0.5]
                    if p != SILENT and end is not None and (lot, own) <= end:
                        k, v = x.features()
                        out.append({"lot": lot, "own": own, "at": k.tolist(), "x": v.tolist(), "y": q})
                if out:
                    kinds = [("lot", pa.int64()), ("own", pa.int64()), ("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.float64())]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

        found = map_arrow(texts.where(F.col("lot") <= top), features, "lot long, own long, at array<long>, x array<double>, y double")
        # At most `sample` of each class, as repeats are left out. Rows of Python numbers would take over ten times an Arrow table's memory.
        found = found.dropDuplicates(["lot", "own"]).toArrow().sort_by([("lot", "ascending"), ("own", "ascending")])
        rows = [(k.values.to_numpy(), v.values.to_numpy(), q) for k, v, q in zip(found["at"], found["x"], found["y"].to_pylist(), strict=True)]
        del found
    weights = fit(rows)
    del rows
    give_back()
    return Classifier(posterior, share, weights)


def score_quality(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Quality of each whole text: doc_id, votes (by labeller: bad, none, good), posterior, score, keep (score of at least `threshold`).

    Labellers vote bad, good or not at all on symbols, runs of marks, capitals, bars, repeated words, variety, sentence ends and
    lengths of words. Expectation-maximisation over the counts of all vote patterns finds how far each is right, without labels; the
    posteriors teach a linear scorer of hashed words and word shapes, which decides. Texts of fewer than LEAST_WORDS words, null and
    empty ones included, get no votes: their posterior is the prior, the scorer isn't taught on them, and they are scored like others. Long texts are seen whole. Null doc_ids, rows and repeats stay
    as they are, equal texts score the same, other columns aren't looked at, whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, post, score = [], [], []
            for t in batch.column(1):
                x = Looked(t.as_py())
                v = x.votes()
                names.append("".join("-.+"[k] for k in v))
                post.append(model.posterior[pattern_of(v)])
                score.append(model.score(x))
            keep = pa.array([s >= threshold for s in score], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(post, pa.float64()), pa.array(score, pa.float64()), keep],
                ["doc_id", "votes", "posterior", "score", "keep"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(rows, run, "doc_id long, votes string, posterior double, score double, keep boolean")


def keep_quality(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score_quality() keeps, with all columns, whatever their names; nothing is shuffled. Nulls, long texts, repeats and empty tables are treated as there."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(Looked(t.as_py())) >= threshold for t in batch.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
