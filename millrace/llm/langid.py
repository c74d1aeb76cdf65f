"""Language identification with error-correcting output codes over hashed letter trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow

#: Trigrams are hashed to so many features.
FEATURES = 1 << 13
#: Added to each count of a trigram, per feature.
SMOOTH = 0.5
#: A text's evidence counts as that of at most so many independent trigrams.
MOST_EVIDENCE = 64
#: A second codeword whose probability comes this near to the best one's makes a prediction ambiguous.
NEAR = 0.2
#: Bytes of a text that are counted at a time.
STEP = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

#: Letters and bytes of longer characters stay; all else is a blank.
KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased UTF-8 bytes, non-letters as blanks, by feature; blanks alone don't count."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    out = np.zeros(FEATURES, dtype=np.int64)
    for at in range(0, len(raw) - 2, STEP):
        b = KEPT[raw[at : at + STEP + 2]].astype(np.uint32)
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        code = code[code != 0x202020]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=FEATURES)
    return out


def codewords(n: int, seed: int = 42) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 7 classes in two, else random splits whose rows lie far apart."""
    if n <= 7:
        rows = np.array([x for x in product((1, -1), repeat=n) if x[0] == 1 and -1 in x], dtype=np.int8).reshape(-1, n)
        return rows.T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    tries = [rng.choice(np.array([1, -1], dtype=np.int8), (n, bits)) for _ in range(50)]
    tries = [t for t in tries if (abs(t.sum(axis=0)) < n).all()] or tries

    def least(t: np.ndarray) -> float:
        same = t.astype(int) @ t.T
        return float((bits - same[~np.eye(n, dtype=bool)]).min())

    return max(tries, key=least)


class Model:
    """Languages, their codewords, a linear classifier for each bit, and how far each is trusted."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        # Each language weighs the same, however many documents it has.
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        self.weights = np.array(
            [np.log(share[c > 0].mean(axis=0)) - np.log(share[c < 0].mean(axis=0)) for c in self.code.T], dtype=np.float64
        ).reshape(-1, FEATURES).T
        self.trust = np.ones(self.code.shape[1])

    def margins(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=1, keepdims=True)
        return (counts @ self.weights) / np.maximum(n, 1) * np.minimum(n, MOST_EVIDENCE)

    def decode(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of the languages: each bit's loss against a codeword, weighted by its trust, through a softmax."""
        z = self.margins(counts)[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -z) * self.trust).sum(axis=2) / max(self.trust.sum(), 1e-9) * max(1, self.code.shape[1] / 2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, most_langs: int = 512) -> Model | None:
    """From all rows of (text, lang) with a lang; two passes. Sums by language return to the driver, none by document.

    More than `most_langs` languages raise ValueError; no rows give None.
    """
    docs = docs.where("lang is not null and text is not null").select("text", "lang")
    names = [r.lang for r in docs.select("lang").distinct().limit(most_langs + 1).collect()]
    if len(names) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(names)
    if not langs:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(FEATURES, dtype=np.int64)
                sums[lang] += trigram_counts(text.as_py())
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            names = pa.array([lang] * len(at), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "feature", "n"])

    table = map_arrow(docs, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = table.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("cells"))
    counts = np.zeros((len(langs), FEATURES))
    place = {x: i for i, x in enumerate(langs)}
    # A row for each language, as Arrow arrays.
    found = table.select("lang", "cells.feature", "cells.n").toArrow()
    for lang, at, n in zip(found.column(0).to_pylist(), found.column(1), found.column(2), strict=True):
        counts[place[lang], at.values.to_numpy()] = n.values.to_numpy()
    model = Model(langs, counts)
    shared = docs.sparkSession.sparkContext.broadcast((model, place))

    def try_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = shared.value
        right, n = np.zeros((len(place), model.code.shape[1]), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = np.array([place[x] for x in part.column(1).to_pylist()])
                z = model.margins(np.array([trigram_counts(t.as_py()) for t in part.column(0)]))
                np.add.at(right, own, z * model.code[own] > 0)
                np.add.at(n, own, 1)
        if n.any():
            langs, bits = np.indices(right.shape)
            yield pa.RecordBatch.from_pydict({"lang": langs.ravel(), "bit": bits.ravel(), "hits": right.ravel(), "n": np.repeat(n, right.shape[1])})

    sums = map_arrow(docs, try_out, "lang long, bit long, hits long, n long").groupBy("lang", "bit")
    hits = np.zeros((*model.code.shape, 2))
    for r in sums.agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect():
        hits[r.lang, r.bit] = r.hits, r.n
    if hits.size:
        right = ((hits[..., 0] + 1) / (hits[..., 1] + 2)).mean(axis=0)
        model.trust = np.clip(np.log(right / (1 - right)), 0.05, 6)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """lang_pred, score and ambiguous beside the other columns of `docs`; `und` and 0 for null texts and those without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t if t and model and LETTER.search(t) else None for t in part.column(len(keep)).to_pylist()]
                pred, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
                if some := [i for i, t in enumerate(texts) if t is not None]:
                    p = model.decode(np.array([trigram_counts(texts[i]) for i in some]))
                    best = p.argmax(axis=1)
                    score[some] = p[np.arange(len(some)), best]
                    second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(some))
                    near[some] = score[some] - second < NEAR
                    for i, b in zip(some, best, strict=True):
                        pred[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())],
                    [*keep, "lang_pred", "score", "ambiguous"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*keep, "text"), run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def identify_languages(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Predicted language of each whole text, however long: doc_id, held_out, lang_pred, score (0 to 1), ambiguous.

    Documents whose crc32(doc_id as text) mod `folds` is `fold` are held out; the rest with a lang teach. Null doc_ids neither teach nor are
    held out. Binary trigram classifiers predict the bits of language codewords; decoding weighs each bit's loss by its accuracy,
    takes the nearest codeword and flags texts where a second is near. Only the text is seen in a prediction.

    Null and empty texts and those without a letter are `und` with score 0 and teach nothing. Rows and repeats stay as they are, and repeats teach as often as they occur. Of
    equally near codewords the language that comes first by code points is taken. With nothing to learn from all are `und`; an empty table gives no rows. Other columns aren't looked at, whatever
    their names.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = learn(docs.where(part != fold))
    return predict(docs.select("doc_id", F.coalesce(part == fold, F.lit(False)).alias("held_out"), "text"), model)
