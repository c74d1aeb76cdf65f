"""Quality, language, nearest neighbours, archives, pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, langid, quality, queries, warc

# --- quality


def test_em_finds_accuracies_of_planted_labellers():
    rng = np.random.default_rng(1)
    m = len(quality.LABELLERS)
    right = np.linspace(0.99, 0.8, m)
    good = rng.random(20_000) < 0.8
    votes = np.where((rng.random((20_000, m)) < right) == good[:, None], quality.GOOD, quality.BAD)
    votes[rng.random(votes.shape) < 0.2] = quality.NONE
    pats = [quality.pattern_of(v) for v in votes.tolist()]
    posterior, share = quality.accuracies(Counter(pats))
    assert ((np.array([posterior[p] for p in pats]) > 0.5) == good).mean() > 0.97
    assert np.allclose(share[1, :, quality.GOOD], right, atol=0.05)


def test_labels_held_out_from_learning_are_met(spark, sf, docs):
    """Learning never sees the labels table."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in quality.score_quality(docs).collect()}
    assert sorted(got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean, junk = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(got[i] for i in clean) >= 0.97 * len(clean)
    assert sum(not got[i] for i in junk) >= 0.8 * len(junk)


def test_texts_without_votes_teach_the_scorer_nothing(spark, docs, monkeypatch):
    """Short junk isn't taught as good."""
    short = spark.createDataFrame([(10**6 + i, f"Reon*** haeand$$$ and&&& w{i}###") for i in range(60)], "doc_id long, text string")
    rows, taught, fit = docs.select("doc_id", "text"), [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda r: taught.append(len(r)) or fit(r))
    voted = sum(any(v != quality.NONE for v in quality.Looked(r.text).votes()) for r in rows.collect())
    quality.learn(rows.unionAll(short))
    assert taught == [voted]


def test_quality_of_odd_rows(odd_docs, no_docs):
    got = quality.score_quality(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert len({(r.votes, r.score) for r in got if r.doc_id == 10}) == 1
    assert quality.score_quality(no_docs).count() == 0
    kept = quality.keep_quality(odd_docs)
    assert kept.schema == odd_docs.schema
    assert kept.count() == sum(r.keep for r in got)


# --- language


def test_held_out_accuracy_and_folds(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify_languages(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_use_the_text_alone(docs):
    blind = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, "zz").otherwise(F.col("lang")))
    want = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert {r.doc_id: r.lang_pred for r in langid.identify_languages(blind.withColumn("source", F.lit("x"))).collect()} == want


def test_language_of_odd_rows(odd_docs, no_docs):
    got = langid.identify_languages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 9, 13)} == {"und"}
    assert all(r.lang_pred == "und" for r in langid.identify_languages(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify_languages(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 7, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n
    assert len({tuple(r) for r in code.tolist()}) == n
    if n > 7:
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= code.shape[1] // 5


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = "some words of a text, ünd so weiter. " * 50
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "STEP", 97)
    assert (langid.trigram_counts(text) == whole).all()


# --- nearest neighbours


def brute(vectors, every, k):
    ids, x = np.array(sorted(vectors)), np.array([vectors[i] for i in sorted(vectors)], dtype=np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        o = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[int(q)] = list(zip(ids[o].tolist(), d[o].tolist(), strict=True))
    return out


def test_recall_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute({r.vec_id: r.embedding for r in df.collect()}, 100, 10)
    got = {}
    for r in ann.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert all(len(v) == 10 and v == sorted(v, key=lambda p: (p[1], p[0])) for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(np.isclose(s, scores[q, i], rtol=1e-12) for q, v in got.items() for i, s in v if (q, i) in scores)


@pytest.mark.parametrize("length", ann.LENGTHS)
def test_every_code_within_the_radius_is_found(length):
    """With substrings of every length, looked up by signature or compared."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**64, (500, 8), dtype=np.uint64)
    for i in range(100, 200):
        words[i] = words[0]
        for bit in rng.choice(512, rng.integers(0, 60), replace=False):
            words[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    words[200:230] = words[0]
    table, parts = ann.Index(words, length), 512 // length
    for radius in (0, 3, 40, 200, 512):
        least = ann.thresholds(radius, parts)
        assert (least + 1).sum() == radius + 1
        for q in (0, 150, 499):
            want = np.flatnonzero(ann.apart(words, words[q]) <= radius)
            assert table.within(words[q], radius, least).tolist() == want.tolist()


def test_clustered_vectors_are_looked_up_by_short_substrings():
    """Where neighbours are near, few buckets are opened; where nothing is near, long substrings are chosen."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 32))
    x = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.01, size=(6000, 32))
    near, far = ann.Model(x, len(x), 10, 8, 0.99), ann.Model(rng.normal(size=(6000, 32)), 6000, 10, 8, 0.99)
    assert near.length < far.length
    words = ann.encode(x, near.mean, near.matrix)
    table = ann.Index(words, near.length)
    assert np.mean([len(table.probed(words[i], near.least)) for i in range(0, 6000, 100)]) < 0.05 * len(x)


def test_queries_of_one_id_and_different_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [float(i), 1.0]) for i in range(1, 40))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    runs = [sorted(map(tuple, ann.nearest_vectors(d).collect())) for d in (df, df.repartition(3), df.orderBy("embedding"))]
    assert runs[0] == runs[1] == runs[2]
    assert len(runs[0]) == 10


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]), (100, None), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("block", F.lit(1))
    got = [tuple(r) for r in ann.nearest_vectors(df).orderBy("rank").collect()]
    far = float(np.sqrt(5))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, far), (0, 4, 3, far)]
    assert ann.nearest_vectors(df.limit(0)).count() == 0


def test_queries_with_too_few_codes_near_are_compared_with_all(spark):
    """Two far clusters, one smaller than k."""
    rng = np.random.default_rng(4)
    x = {i: (rng.normal(0, 0.01, 8) + (10 if i < 5 else -10)).tolist() for i in range(400)}
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    got = ann.nearest_vectors(df, reach=0.5)
    assert {r.query_id: r["n"] for r in got.groupBy("query_id").agg(F.count("rank").alias("n")).collect()} == dict.fromkeys((0, 100, 200, 300), 10)
    want = brute(x, 100, 10)
    assert [r.vec_id for r in got.where("query_id = 0").orderBy("rank").collect()][:4] == [i for i, _ in want[0]][:4]


# --- archives


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "".join(random.Random(1).choices("abc <>\n", k=300_000))
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\nX: y", big), (9, None, big), (3, "u", "s" * 999), (4, "u", "s" * 999), (5, "u", "t" * 1000), (6, "u", "t" * 1000)]
    rows += [(7, "u", None), (8, "u", ""), (10, "u", "é" * 65_536), (11, "u", "WARC/1.1\r\n\r\n\r\n" * 99), (None, "u", "t" * 1000), (None, "u", "own " * 300), (6, "u", "t" * 1000)]
    return spark.createDataFrame([(*r, "d", 0, 0) for r in rows], "page_id long, url string, html string, digest string, chunk int, key int")


def test_archives_round_trip(odd_pages, tmp_path):
    manifest = warc.write_archives(warc.record_table(odd_pages), str(tmp_path / "w"))
    rows = warc.read_archives(manifest, with_payload=True).collect()
    pages = odd_pages.collect()
    last = [r for r in rows if r["last"]]
    assert len(last) == len(pages) == sum(r.records for r in manifest.collect())
    to = {r.page_id: (r.record_type, r.refers_to) for r in last if r.page_id is not None}
    assert to[1] == to[2] == ("revisit", 9)
    assert to[9] == to[3] == to[4] == ("response", None)
    assert (to[5], to[6]) == (("revisit", 6), ("response", None))
    assert Counter((r.record_type, r.refers_to) for r in last if r.page_id is None) == {("revisit", 6): 1, ("response", None): 1}
    for p in pages:
        body = (p.html or "").encode()
        own = [r for r in last if r.page_id == p.page_id and r.payload_digest == hashlib.sha1(body).hexdigest()]
        assert own
        assert own[0].payload_bytes == len(body)
        if p.page_id is not None and to[p.page_id][0] == "response" and p.page_id != 6:
            parts = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.page_id == p.page_id)
            assert b"".join(c for _, c in parts) == body
            assert all(len(c) <= warc.CHUNK for _, c in parts)
    with gzip.open(next((tmp_path / "w").iterdir())) as f:
        assert f.readline() == b"WARC/1.1\r\n"


def test_archives_are_begun_anew_and_damage_is_seen(odd_pages, tmp_path):
    manifest = warc.write_archives(warc.record_table(odd_pages.coalesce(1)), str(tmp_path / "w"), most=1)
    assert manifest.count() > 5
    assert warc.read_archives(manifest).where("last").count() == odd_pages.count()
    for p in (tmp_path / "w").iterdir():
        raw = gzip.decompress(p.read_bytes())
        if b"tttt" in raw:
            p.write_bytes(gzip.compress(raw.replace(b"tttt", b"ttxt", 1)))
            for c in (tmp_path / "w").glob(".*crc"):
                c.unlink()
    with pytest.raises(Exception, match="disagree"):
        warc.read_archives(manifest).collect()


def test_bodies_are_not_moved(odd_pages):
    """Neither copies nor others: the plan of the record table has no exchange but that of the broadcast list."""
    out = warc.record_table(odd_pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange" in x and "ReusedExchange" not in x]
    assert len(exchanges) == 1
    assert "BroadcastExchange" in exchanges[0]
    assert out.where("record_type = 'revisit'").count() > 0


def test_a_long_list_of_revisits_is_shuffled(odd_pages, monkeypatch):
    want = sorted(map(str, warc.record_table(odd_pages).drop("chunk").collect()))
    monkeypatch.setattr(warc, "MOST_KEYS", 0)
    assert sorted(map(str, warc.record_table(odd_pages).drop("chunk").collect())) == want


@pytest.mark.parametrize("how", ["shuffled", "cut short"])
def test_records_out_of_order_are_told(odd_pages, tmp_path, how):
    rows = warc.record_table(odd_pages)
    rows = rows.coalesce(1).orderBy(F.desc("chunk_no")) if how == "shuffled" else rows.where("chunk_no + 1 < chunks")
    with pytest.raises(Exception, match=r"page \S+: (chunk|it ends)"):
        warc.write_archives(rows, str(tmp_path / "w"))


def test_no_pages(odd_pages):
    assert warc.read_archives(warc.write_archives(warc.record_table(odd_pages.limit(0)))).count() == 0


# --- queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def text(df):
        return sorted(tuple("" if pd.isna(x) else f"{x:.0f}" if isinstance(x, float) else str(x) for x in r) for r in df[names].itertuples(index=False))

    assert text(got) == text(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
