"""Mixes of sources: shares, caps, blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, mixing as M

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(bpe.VOCABULARY), reason="no vocabulary files")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    p = M.permuted(np.arange(n), n, 7)
    assert sorted(p) == list(range(n))
    assert n < 17 or (p != M.permuted(np.arange(n), n, 8)).any()


@pytest.mark.parametrize("scale", [1, 1000, 10**9, 10**14])
def test_shards_add_up(scale):
    totals = np.array([100, 2000, 0, 37, 5000]) * scale
    draw = M.ShardDraw(totals, 8, 42)
    got = [draw(i) for i in range(8)]
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(got, (M.shard_draw(totals, 8, i, 42) for i in range(8))))
    assert (sum(n for _, n in got) == totals).all()
    assert all((a + n == b).all() for (a, n), (b, _) in zip(got, got[1:]))
    sizes = [int(n.sum()) for _, n in got]
    assert max(sizes) - min(sizes) <= 1


def test_splits_follow_the_hypergeometric_law():
    totals, left = np.array([400, 90, 10]), 200
    own = np.array([M._split(totals, left, [7, i]) for i in range(4000)])
    other = np.random.default_rng(1).multivariate_hypergeometric(totals, left, 4000)
    assert (own.sum(axis=1) == left).all() and (own <= totals).all()
    assert np.allclose(own.mean(axis=0), left * totals / 500, atol=0.25) and np.allclose(own.var(axis=0), other.var(axis=0), rtol=0.12)
    counts = [np.bincount(x[:, 2], minlength=11) / 4000 for x in (own, other)]
    assert abs(counts[0] - counts[1]).max() < 0.04


def test_large_splits_are_drawn():
    totals = np.array([3 * 10**12, 10**12, 5])
    own = np.array([M._split(totals, 2 * 10**12, [3, i]) for i in range(600)])
    share, n = totals / totals.sum(), 2 * 10**12
    assert (own.sum(axis=1) == n).all() and len(set(own[:, 0].tolist())) > 590
    want = (n * share[0] * (1 - share[0]) * 0.5) ** 0.5
    assert abs(own[:, 0].std() / want - 1) < 0.1 and abs(own[:, 0].mean() - n * share[0]) < 5 * want / 600**0.5


def documents(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        source = rng.choice(["Big Paper"] * 8 + ["big  paper ", "Small", "SMALL", "other", None])
        rows.append((i, " ".join(rng.choice(["sea", "ship", "harbour", "Ⅳ"]) for _ in range(rng.randint(0, 60))), source))
    rows += [(1000, None, "Small"), (1001, "", "Small"), (1002, "word " * 3000, "Small"), (None, "no id", "Small"), (1003, "twice", "Small"), (1003, "twice", "Small")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash")).withColumn("source_key", F.lit("clash")).withColumn("block", F.lit("clash"))


def test_mix(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("Big Paper", 0.5, 1), ("Small", 0.4, 3), ("Lost", 0.1, 2), ("other", None, 2), ("none", -1.0, 2)], "source string, weight double, max_repeats int").withColumn("tokens", F.lit("clash"))
    result, shares = M.mix(docs, targets, block_tokens=16, shard_slots=50)
    rows, by = result.collect(), {r.source: r for r in shares.collect()}
    sizes = {r.source_key: r.n for r in M.sized_documents(docs).groupBy("source_key").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(sizes.values())
    big, small = by["Big Paper"], by["Small"]
    assert big.available_tokens == sizes["big paper"] and abs(big.tokens - 0.5 * total) <= 40 and big.most_repeats == 1
    assert abs(small.tokens - min(0.4 * total, 3 * sizes["small"])) <= 60 and small.most_repeats <= 3
    checked = {r.source: (r.met, r.capped) for r in M.shares_checked(shares, 16).collect()}
    assert checked == dict.fromkeys(by, (True, True))
    assert (by["Lost"].share, by["other"].tokens, by["none"].tokens) == (0, 0, 0)
    assert abs(sum(r.share for r in by.values()) - 1) < 1e-9
    assert sum(r.n_tokens for r in rows) == big.tokens + small.tokens
    uses = {}
    for r in rows:
        for t in range(r.first_token, r.first_token + r.n_tokens):
            uses.setdefault((r.source, r.doc_id, t), []).append((r.repetition, r.block))
    assert max(len(u) for k, u in uses.items() if k[0] == "Big Paper") == 1
    assert max(len(u) for k, u in uses.items() if k[0] == "Small" and k[1] != 1003) <= 3
    fill = {}
    for r in rows:
        fill[r.shard, r.slot] = fill.get((r.shard, r.slot), 0) + r.n_tokens
    assert max(fill.values()) == 16 and sum(v < 16 for v in fill.values()) <= 1 + 3
    assert sorted(map(tuple, M.mix(docs, targets, block_tokens=16, shard_slots=50)[0].collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_empty_tables(spark):
    docs, targets = documents(spark), spark.createDataFrame([("Small", 1.0, 1)], "source string, weight double, max_repeats int")
    for d, t in ((docs.where("false"), targets), (docs, targets.where("false")), (docs.where("text is null"), targets)):
        result, shares = M.mix(d, t)
        assert result.count() == 0 and all(r.tokens == 0 and r.share == 0 for r in shares.collect())


def test_listed_twice(spark):
    with pytest.raises(ValueError, match="twice"):
        M.quotas(M.sized_documents(documents(spark)), spark.createDataFrame([("A b", 0.5, 1), ("a  B", 0.5, 1)], "source string, weight double, max_repeats int"))


def test_a_chosen_total(spark):
    targets = spark.createDataFrame([("big paper", 1.0, 1)], "source string, weight double, max_repeats int")
    assert abs(M.mix(documents(spark), targets, total_tokens=640, block_tokens=16)[1].first().tokens - 640) <= 16
