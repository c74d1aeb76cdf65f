import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import simhash

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_on_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert n[0] > n[1] > n[2] >= n[3]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    firsts = docs.where("piece = 0")
    assert Counter(r.doc_id for r in firsts.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_decisions_against_brute_force(spark, sf):
    """Each stage on its own input: exact groups, verified links, words near targets, ids of whole texts."""
    docs, held = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        rows = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        held[name] = (rows, docs)
    before, after = held["exact_dedup"][0], {r.doc_id for r in held["exact_dedup"][1].collect()}
    first = {}
    for r in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text), r.doc_id)
    assert after == set(first.values())
    before, after = held["near_dedup"][0], {r.doc_id for r in held["near_dedup"][1].collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            few, many = sorted((len(sets[a]), len(sets[b])))
            if a < b and few >= 0.8 * many > 0 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {i for i in sets if find(i) == i}
    words = Counter(), Counter()
    for k, rows in enumerate((held["mixing"][0], held["mixing"][1].collect())):
        for r in rows:
            words[k][r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
    assert abs(sum(words[1].values()) - 1.5 * sum(words[0].values())) <= 0.05 * sum(words[0].values())
    assert all(words[1][s] <= 2 * words[0][s] for s in words[0])


def test_run_agrees_with_itself(spark, sf):
    def digest(df):
        return sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())

    assert digest(pipeline.run(spark, sf)) == digest(pipeline.run(spark, sf))


def test_odd_documents_pass_all_stages(spark, odd_docs, sf, both_ids):
    """What each stage keeps of nulls, empty and long texts, ties and repeats, and the ids that are packed in the end."""
    docs, seen = odd_docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), odd_docs.schema)
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == odd_docs.columns
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in seen["exact_dedup"]]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in seen["quality"]})
    assert set(seen["near_dedup"]) <= set(seen["exact_dedup"])
    assert set(seen["mixing"]) <= set(seen["near_dedup"])
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(both_ids(t) for _, t in seen["mixing"])
    assert Counter(str(r.doc_id) for r in packed if r.piece == 0) == Counter(str(i) for i, _ in seen["mixing"])


def test_no_documents(spark, no_docs, sf):
    docs = no_docs
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.fixture
def both_ids(tokenizer):
    """Number of a text's ids with the end id, by the library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    return lambda text: len(library.encode(text or "", add_special_tokens=False).ids) + 1
