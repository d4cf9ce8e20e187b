"""Token ids against the tokenizers library; containers against their invariants."""

import random

import pytest

from jobmill.llm import queries as q
from jobmill.llm.packing import Windows, pack, pieces, token_counts
from jobmill.llm.tokenizer import DEFAULT_PATH, Encoder, encode_column


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def enc():
    return Encoder(DEFAULT_PATH)


def test_documents(spark, sf, library):
    got = {r.doc_id: r.ids for r in q.p7_ids(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (library(r.text) if r.text else [])


def test_random_texts(enc, library):
    rnd = random.Random(5)
    parts = ["a", "b", "the", "ing", "  ", "\n", "é", "中", "ไทย", "हि", "1", "99", "...", "'s", "'ll", "\x85", "​", "\xa0", "<|endoftext|>", "🎉", "==", "_", "\x00", "\r\n", " x"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert enc.encode(s) == (library(s) if s else []), repr(s)
    for s in ("a" * 20_000, "ab" * 10_000, " " * 3000 + "x", "".join(rnd.choice("aeiourst") for _ in range(20_000))):
        assert enc.encode(s) == library(s)


def test_every_token_merges_to_itself(enc):
    for token, i in list(enc.halves.items())[::7]:
        a, b = enc.halves[token]
        assert enc.merged[a, b] == token


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "", 8), (2, "hi", 7)], "k int, t string, ids int")  # a clashing name
    got = sorted((str(r.k), r.ids) for r in encode_column(df, "k", "t").collect())
    assert got == [("1", []), ("1", []), ("2", [5303]), ("None", [])]
    assert encode_column(df.limit(0), "k", "t").count() == 0
    assert token_counts(df, "k", "t").agg({"n_tokens": "sum"}).first()[0] == 1


def test_pieces():
    assert list(pieces(5, 5)) == [(0, 0, 5)] and list(pieces(0, 5)) == [(0, 0, 0)]
    assert list(pieces(11, 5)) == [(0, 0, 5), (1, 5, 10), (2, 10, 11)]


def test_best_fit():
    w = Windows(10, 2, 0)
    assert [w.place(s) for s in (6, 7, 3, 4, 8, 1, 2)] == [0, 1, 1, 0, 2, 2, 3] and w.closed == [1, 0]


def test_containers(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 3, 50, 90, 99, 100, 101, 250]) for _ in range(2000)] + [None, -4]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(7)
    got = pack(df, "id", "size", 100, 4).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.part_to - r.part_from
        parts.setdefault(r.id, []).append((r.piece_no, r.part_from, r.part_to))
    assert max(fill.values()) <= 100
    for i, s in enumerate(sizes):
        assert sorted(parts[i]) == list(pieces(max(s or 0, 0), 100))
    whole = sum(max(s or 0, 0) for s in sizes)
    assert len(fill) <= 1.06 * whole / 100 + 4
    assert pack(df.limit(0), "id", "size").count() == 0


def test_documents_fill_their_containers(spark, sf):
    got = q.p8_packed(spark, sf).toPandas()
    used = (got.part_to - got.part_from).groupby(got.container).sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.95


def test_windows_that_take_one_item_are_never_merged(spark):
    from jobmill.llm.packing import MERGED_AT_ONCE, merge_tasks

    df = spark.range(1_000_000, numPartitions=8).selectExpr("id", "1100 as size")
    got = pack(df, "id", "size", 2048, 64)
    assert got.select("container").distinct().count() == 1_000_000 and got.agg({"part_to": "sum"}).first()[0] == 1_100_000_000
    assert merge_tasks(8 * 64) == 1 and merge_tasks(MERGED_AT_ONCE * 3 + 1) == 4


def test_only_empty_items(spark):
    got = pack(spark.range(1000, numPartitions=3).selectExpr("id", "cast(null as int) as size"), "id", "size").collect()
    assert len(got) == 1000 and len({r.container for r in got}) <= 3 and len({r.id for r in got}) == 1000


def test_the_vocabulary_comes_with_the_job(spark):
    from pyspark import SparkFiles
    from pyspark.sql import functions as F

    encode_column(spark.createDataFrame([(1, "Hello there")], "k int, t string"), "k", "t").first()

    @F.pandas_udf("boolean")
    def there(names):
        import os

        return names.map(lambda n: os.path.exists(SparkFiles.get(n)))

    assert spark.createDataFrame([(DEFAULT_PATH.rpartition("/")[2],)], "n string").select(there("n")).first()[0]
