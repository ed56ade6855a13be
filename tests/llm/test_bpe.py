import random

import pytest

from threadloom.llm.bpe import Bpe, default_tokenizer, encode_digests, encode_documents, read_tokenizer
from threadloom.llm.counts import LEAF, CountTree, count_trees, edited_counts, edited_trees

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return Bpe(read_tokenizer(default_tokenizer()))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(default_tokenizer())


PARTS = ["'re", "'", "r", "e", "s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|end", "éà", "漢字", "1", "½", "a", "The", "ing", "😀", "\x85", "!!!", "ab", "lichkeit"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_round_trip_equal_the_library(bpe, library):
    sample = ["", " ", "x" * 5000, "ab " * 3000, *texts(800, 1)]
    mine = list(bpe.encode_batch(sample))
    assert mine == [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert [bpe.decode(i) for i in mine] == sample


def test_proposals_that_fail_are_merged(bpe):
    words = [t.strip() or "x" for t in texts(300, 2)]
    assert [bpe.merge(w.encode()) for w in words if "<" not in w]
    list(bpe.encode_batch(words))
    assert 0 < bpe.merged < bpe.proposed


def test_edits_equal_full_recounts(bpe):
    rng = random.Random(3)
    for text in [*texts(120, 4), "word " * 500, "   " * 200, "a" * 400]:
        tree = CountTree.build(bpe, text)
        for _ in range(6):
            start = rng.randint(0, len(text) + 1)
            end, new = start + rng.choice([0, 1, 3, 50]), rng.choice(["", " ", "e", *texts(1, rng.random())])
            tree.edit(start, end, new)
            start = min(start, len(text))
            text = text[:start] + new + text[max(start, end) :]
            assert tree.text == text
            tree = CountTree(bpe, text, *tree.leaves())  # kept and read again
            assert tree.n_tokens == len(next(iter(bpe.encode_batch([text]))))


def test_long_document_recounts_little(bpe):
    tree = CountTree.build(bpe, "some words here " * 5000)
    tree.edit(40_000, 40_004, "other")
    assert tree.recounted < 200


def test_depth_follows_the_text(bpe):
    tree = CountTree.build(bpe, "a few words")
    tree.edit(5, 5, "many more words " * 3000)
    assert tree.n_leaves > 9000 // (2 * LEAF)
    tree.recounted = 0
    tree.edit(20_000, 20_001, "x")
    assert tree.recounted < 200
    for _ in range(40):
        tree.edit(0, tree.length // 2, "")
    assert tree.n_leaves <= 8 and tree.n_tokens == len(next(iter(bpe.encode_batch([tree.text]))))


def test_queries_on_odd_rows(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, None, "x"), (None, "", None), (3, "long " * 4000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_digests(docs, default_tokenizer()).toPandas()
    assert sorted(out.n_tokens) == sorted(len(library.encode(t or "").ids) for _, t, _ in rows)
    assert {r.decoded for r in encode_documents(docs, default_tokenizer()).collect()} == {t or "" for _, t, _ in rows}
    assert encode_digests(docs.limit(0), default_tokenizer()).count() == 0
    shape = "array<struct<start:bigint,end:bigint,text:string>>"
    trees = count_trees(docs, default_tokenizer())
    one = "array(named_struct('start', 0L, 'end', 1L, 'text', 'zz'), NULL) AS edits"
    again = edited_trees(trees.selectExpr("*", one), default_tokenizer())
    expect = [len(library.encode("zz" + (t or "")[1:]).ids) for _, t, _ in rows]
    assert sorted(r.n_tokens for r in again.collect()) == sorted(expect)
    twice = edited_counts(again.selectExpr("*", one.replace("zz", "its")), default_tokenizer()).collect()
    assert sorted(r.n_tokens for r in twice) == sorted(expect) and {r.n_edits for r in twice} == {1}
    assert sorted(r.n_tokens_edited for r in twice) == sorted(len(library.encode("itsz" + (t or "")[1:]).ids) for _, t, _ in rows)
    none = edited_counts(trees.selectExpr("*", f"CAST(NULL AS {shape}) AS edits"), default_tokenizer()).collect()
    assert all(r.n_tokens == r.n_tokens_edited and r.n_recounted == r.n_edits == 0 for r in none)
    assert edited_counts(count_trees(docs.limit(0), default_tokenizer()).selectExpr("*", f"CAST(NULL AS {shape}) AS edits"), default_tokenizer()).count() == 0
