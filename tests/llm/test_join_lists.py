"""Operator 1: a pair of sets is handed on by one of the lists that it shares, not by each."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import ngram_join
from pactum.llm.ngram_join import Threshold


def test_common_member_against_sets():
    rnd = np.random.default_rng(3)
    sides = []
    for n in (7, 9):
        rows = [np.unique(rnd.integers(0, 40, rnd.integers(0, 6))) for _ in range(n)]
        sides.append((rows, (n, np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows))))
    got = ngram_join.common_member(*sides[0][1], *sides[1][1])
    assert got.tolist() == [[bool(set(x) & set(y)) for y in sides[1][0]] for x in sides[0][0]]


@pytest.mark.parametrize("step", [1 << 12, 2])
def test_common_member_in_steps(monkeypatch, step):
    monkeypatch.setattr(ngram_join, "COMMON_STEP", step)
    one, two = (3, np.array([0, 1, 1, 2]), np.array([5, 5, 9, 7])), (2, np.array([0, 0, 1]), np.array([9, 8, 7]))
    assert ngram_join.common_member(*one, *two).tolist() == [[False, False], [True, False], [False, True]]
    none = (2, np.zeros(0, int), np.zeros(0, int))
    assert not ngram_join.common_member(*none, *two).any()


def test_each_pair_comes_from_one_list(spark):
    """60 near copies share most of their prefixes; every pair used to come once for each shared list."""
    rnd, t = random.Random(5), Threshold(85, 100)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 2)):
            words[k] = f"x{rnd.randrange(4)}"
        texts.append((i, " ".join(words)))

    def sets_of(batches):
        import pyarrow as pa
        for b in batches:
            s = ngram_join.shingle_sets(b.column(1), 4)
            yield pa.RecordBatch.from_arrays([pa.array([ngram_join._key(x) for x in s]), pa.array([len(x) for x in s], pa.int32()),
                                              pa.array([x.tobytes() for x in s])], names=["key", "n", "members"])

    sets = spark.createDataFrame(texts, "id long, text string").mapInArrow(sets_of, "key binary, n int, members binary")
    indexed = ngram_join.index(sets.select("key", "n", "members"), t, 3).cache()
    lists = indexed.select("key", "n", "before", F.posexplode("prefix").alias("rank", "e")) \
        .withColumn("pos", F.col("before") + F.col("rank")).withColumn("comp", F.col("key")).drop("before")
    pairs = [tuple(sorted((bytes(r.a), bytes(r.b)))) for r in ngram_join.open_pairs(lists, indexed, t).collect()]
    shared = lists.alias("x").join(lists.alias("y"), "e").filter("x.key < y.key").count()
    assert 0 < len(pairs) == len(set(pairs)) < shared / 3

    held = {bytes(r.key): (r.n, set(np.frombuffer(r.members, np.uint64).tolist())) for r in indexed.collect()}
    linked = {(a, b) for a in held for b in held if a < b
              and 100 * len(held[a][1] & held[b][1]) >= 85 * (held[a][0] + held[b][0] - len(held[a][1] & held[b][1]))}
    assert linked and linked <= set(pairs)                       # no link is lost
