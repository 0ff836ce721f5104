import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.llm import bpe_trie, packing
from lectorium.llm.common import vocabulary_path

RANKS = bpe_trie.load_ranks(vocabulary_path("byte_bpe_50k.tiktoken"))
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe_trie.TrieEncoder(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_public_tokenizers(text):
    assert OWN.encode_texts([text]) == [KNOWN.encode_ordinary(text)]


def test_hard_texts():
    texts = ["a" * 5000, " " * 300 + "x", "\n\n \n", "it's they'll", "<|endoftext|>", "漢字かな" * 50, "́é", None, ""]
    assert OWN.encode_texts(texts) == [KNOWN.encode_ordinary(t) if t else [] for t in texts]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = bpe_trie.encode_corpus(df).collect()
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in rows) == sorted([(1, KNOWN.encode("a b")), (2, []), (3, []), (1, KNOWN.encode("a b")), (0, KNOWN.encode("x"))])
    assert {r["doc_id"]: r["tokens"] for r in bpe_trie.count_tokens(df).collect()}[2] == 0
    assert bpe_trie.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(0, 40), max_size=12), st.integers(20, 30))
def test_patterns_hold_every_item_once(histogram, capacity):
    packs = {}
    for length, slots in packing.place(histogram, capacity).items():
        ranks = [*slots[:, 0], histogram[length]]
        assert ranks[0] == 0
        for (rank, first, used), end in zip(slots, ranks[1:]):
            assert end > rank
            for i in range(end - rank):
                packs.setdefault(first + i, []).append((used, length))
    assert sorted(packs) == list(range(len(packs)))
    for items in packs.values():
        at = 0
        for used, length in sorted(items):
            assert used == at
            at += length
        assert at <= capacity
    assert sum(map(len, packs.values())) == sum(histogram.values())
    # no two packs could be one less: at most one is half empty or less
    assert sum(sum(n for _, n in p) * 2 <= capacity for p in packs.values()) <= 1


@pytest.mark.parametrize("ranked", [packing.RANKED, 7])  # with 7, each length is ranked in several parts
def test_packing_table(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    sizes = [(i, i % 7) for i in range(300)] + [(1000, 25), (1001, None), (5, 5), (5, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("size", F.lit(9)).withColumn("pack_id", F.lit(9))
    rows = packing.pack(df, 10).collect()
    assert sum(r["size"] for r in rows) == sum(n or 0 for _, n in sizes)
    assert sorted((r["piece"], r["size"]) for r in rows if r["doc_id"] == 1000) == [(0, 10), (1, 10), (2, 5)]
    assert all(r["piece"] == 0 for r in rows if r["doc_id"] != 1000)
    packs = {}
    for r in rows:
        if r["size"]:
            packs.setdefault(r["pack_id"], []).append((r["pack_offset"], r["size"]))
    for items in packs.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= 10
    assert sum(r["size"] == 0 for r in rows) == sum(not n for _, n in sizes)
    assert packing.pack(df.limit(0), 10).count() == 0
    every = packing.pack_all(df, [(1, 10), (2, 64)])
    assert {r[0]: r[1] for r in every.groupBy("container_id").agg(F.sum("size")).collect()} == {1: sum(n or 0 for _, n in sizes), 2: sum(n or 0 for _, n in sizes)}
    with pytest.raises(ValueError):
        packing.pack(df, 0)
