import pytest

WORDS = "amber birch cedar delta ember fjord grove heath inlet junco kelp larch maple nook otter pine quartz reed sage thorn".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(WORDS[i * i % 20] for i in range(30_000))
    rows = [
        (1, "Hello  there, World.", "en", "a"),
        (2, "Hello there,\tWorld.", "en", "b"),
        (3, "hello there, world.", None, None),
        (4, None, "de", "a"),
        (5, "", None, "b"),
        (6, long, "en", "a"),
        (7, long, "en", None),
        (8, "é ü — 日本語   x", "fr", "c"),
        (9, " \n\t ", "fr", "c"),
        (10, "one two", "en", "c"),
        (10, "one two", "en", "c"),
        (None, "no id here", "en", "a"),
        (None, None, None, None),
        (11, "x" * 5000, "en", "a"),
        (12, "<|endoftext|> it's 12.5 ok...", "en", "b"),
        (13, "1234 5678 !!!", "de", "c"),
    ]
    extra = [(*r, len(r[1] or ""), 0, 0, "k", "h", 0) for r in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size int, fp int, key string, h string, slot int"
    return spark.createDataFrame(extra, kind)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


