"""Hot keys, samples, batches, graphs and schedules on small inputs, against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.functions import losses as L
from corpusmill.functions.hashing import chosen_suffixes
from corpusmill.functions.schedule import Schedule, scheduled_weight
from corpusmill.operators import graph as G
from corpusmill.operators.batches import assign_batches
from corpusmill.operators.evaluate import split_finite
from corpusmill.operators.groups import ranked, split_hot, windowed
from corpusmill.operators.index import hash_ranked, running_totals, with_global_index
from corpusmill.operators.planes import move_planes
from corpusmill.operators.profile import category_distribution, plane_usage
from corpusmill.operators.sampling import cap_rows, epochs, even_parts, global_shuffle, two_stage_sample
from corpusmill.operators.sequence import rolling_mean, step_rates
from corpusmill.operators.split import hash_split, holdout_files, holdout_shortfall
from corpusmill.session import shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, another third under NULL, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 50 + 1)
    return spark.range(3000).select("id", key.cast("int").alias("k"), ((F.col("id") * 7919) % 3001).alias("o")).cache()


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: r.o):
        groups.setdefault(r.k, []).append(r)
    return groups


def test_hot_keys_leave_the_window(spark, skewed):
    hot, cold = split_hot(skewed, ["k"], 200)
    assert {r.k for r in hot.select("k").distinct().collect()} == {0, None}
    assert hot.count() == 2000 and cold.count() == 1000
    assert split_hot(skewed, ["k"], 5000)[0] is None


def test_ranked_with_hot_keys(skewed):
    got = ranked(skewed, ["k"], ["o"], "rn", {"n": F.count(F.lit(1)), "first": F.min("o")}, hot_rows=200).collect()
    groups = brute(skewed.collect())
    expected = {r.id: (i + 1, len(g), g[0].o) for g in groups.values() for i, r in enumerate(g)}
    assert {r.id: (r.rn, r.n, r["first"]) for r in got} == expected and len(got) == 3000


def test_segments_look_back(skewed):
    means = rolling_mean(skewed, ["k"], ["o"], "o", 30, hot_rows=64).collect()
    expected = {}
    for group in brute(skewed.collect()).values():
        for i, r in enumerate(group):
            last = [x.o for x in group[max(0, i - 29) : i + 1]]
            expected[r.id] = sum(last) / len(last)
    assert len(means) == 3000 and all(abs(r.rolling_mean - expected[r.id]) < 1e-9 for r in means)
    with pytest.raises(ValueError):
        windowed(skewed, ["k"], ["o"], 10, lambda d, k: d, hot_rows=5)


def test_rates_with_hot_keys(spark):
    rows = spark.range(500).select(F.lit("a").alias("k"), "id", F.timestamp_seconds(F.col("id") * 2).alias("t"))
    plain, hot = (step_rates(rows, ["k"], ["t"], "t", hot_rows=h) for h in (10_000, 20))
    assert plain.exceptAll(hot).count() == 0 and hot.count() == 500
    assert hot.where("recent_rate != 0.5").count() == 0 and hot.where("average_rate IS NULL").count() == 1


def test_hash_order_is_the_same_for_any_layout(spark, skewed):
    results = [
        {(r.id, r.row_index) for r in hash_ranked(df, ["id"], 5, ["k"], digits=d).collect()}
        for df, d in ((skewed, None), (skewed.repartition(3), 1), (skewed.coalesce(1), 3))
    ]
    assert results[0] == results[1] == results[2]
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append(r.id)
    digest = lambda i: hashlib.md5(f"5|{i}".encode()).hexdigest()
    expected = {(i, n) for ids in groups.values() for n, i in enumerate(sorted(ids, key=digest))}
    assert results[0] == expected


def test_global_index_and_totals(spark, skewed):
    indexed = with_global_index(skewed, ["o"], partitions=7)
    assert [r.id for r in indexed.orderBy("row_index").collect()] == [r.id for r in sorted(skewed.collect(), key=lambda r: r.o)]
    # all order keys equal: still dense and complete
    flat = with_global_index(spark.range(1000).withColumn("c", F.lit(1)), ["c"], partitions=5)
    assert sorted(r.row_index for r in flat.collect()) == list(range(1000))
    totals = running_totals(skewed, ["o"], "id", "upto", 6).orderBy("o").collect()
    run = 0
    for r in totals:
        run += r.id
        assert r.upto == run


def test_global_shuffle_one_exchange(spark, skewed):
    shuffled = global_shuffle(skewed, ["id"], 3)
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0
    assert sorted(r.id for r in shuffled.collect()) == list(range(3000))


@pytest.mark.parametrize("total,parts", [(10, 3), (9, 3), (2, 5), (0, 2)])
def test_even_parts(spark, total, parts):
    got = even_parts(spark.range(total), "id", parts, total).groupBy("part").count().collect()
    sizes = [total // parts + (1 if p < total % parts else 0) for p in range(parts)]
    assert {r.part: r["count"] for r in got} == {p: s for p, s in enumerate(sizes) if s}


@pytest.mark.parametrize("n,size", [(10, 4), (9, 4), (8, 4), (3, 10), (1, 5), (7, 12)])
def test_padding(spark, n, size):
    df = spark.range(n).select(F.lit("f").alias("file"), "id")
    got = assign_batches(df, "file", ["id"], size).orderBy("batch_id", "slot").collect()
    expected = []
    for start in range(0, n, size):
        batch = list(range(start, min(start + size, n)))
        need = size - len(batch)
        pads = batch[-need:] if 0 < need <= len(batch) else (batch * need)[:need]
        expected += [(start // size, s, i, i) for s, i in enumerate(batch)]
        expected += [(start // size, len(batch) + s, i, -1) for s, i in enumerate(pads)]
    assert [(r.batch_id, r.slot, r.id, r.source_index) for r in got] == expected


def test_batches_with_hot_file(spark, skewed):
    plain, hot = (assign_batches(skewed, "k", ["o"], 64, True, h) for h in (10_000, 100))
    assert plain.exceptAll(hot).count() == 0 and plain.count() == hot.count()


def test_sampling(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("file"), "id")
    sample = two_stage_sample(df, "file", ["id"], 4000, 1).collect()
    assert len(sample) == 4000 and len({r.draw_id for r in sample}) == 4000
    per_file = [sum(r.file == f for r in sample) for f in range(4)]
    assert all(850 < n < 1150 for n in per_file)
    assert two_stage_sample(df.limit(0), "file", ["id"], 10, 1).count() == 0
    assert two_stage_sample(df, "file", ["id"], 200, 1, "uniform").count() == 200


@pytest.mark.parametrize("maximum", [0, 15, 20, 33, 60, 100])
def test_cap_rows(spark, maximum):
    df = spark.range(60).select(F.floor(F.col("id") / 15).alias("file"), "id")
    kept = cap_rows(df, "file", ["id"], maximum, 4).collect()
    assert len(kept) == len({r.id for r in kept}) == min(60, maximum)
    whole = maximum // 15
    assert {r.id for r in kept} >= set(range(min(60, whole * 15))) and all(r.file <= whole for r in kept)


def test_epochs_differ(spark):
    files = spark.range(20).select(F.concat(F.lit("f"), F.col("id")).alias("path"))
    order = {}
    for r in epochs(files, 3, 9).orderBy("epoch", "position").collect():
        order.setdefault(r.epoch, []).append(r.path)
    assert len(order) == 3 and all(sorted(o) == sorted(order[0]) for o in order.values())
    assert order[0] != order[1] != order[2]


def test_splits(spark):
    texts = [f"record {i % 400}" for i in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for chars, fraction in ((2, 0.1), (3, 0.2), (4, 0.05)):
        chosen = set(random.Random(3).sample([f"{i:0{chars}x}" for i in range(16**chars)], round(16**chars * fraction)))
        assert set(chosen_suffixes(fraction, 3, chars)) == chosen
        for r in hash_split(df, "text", fraction, 3, chars).collect():
            inside = hashlib.sha1(r.text.encode()).hexdigest()[-chars:] in chosen
            assert r.split == ("test" if inside else "train")
    assert chosen_suffixes(0.0001, 1, 2) and not chosen_suffixes(0, 1, 2) and not chosen_suffixes(1.0, 1, 2)
    assert hash_split(df, "text", 0.0).where("split = 'test'").count() == 0


def test_holdout(spark):
    files = spark.createDataFrame([("a", f"a{i}") for i in range(9)] + [("b", "b0")], "source string, path string")
    held = holdout_files(files, 3).where("split = 'test'").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in held} == {"a": 3, "b": 1}
    assert [(r.source, r.available) for r in holdout_shortfall(files, 3).collect()] == [("b", 1)]


def test_distributions_of_nothing(spark):
    none = spark.createDataFrame([], "c int, p int, d array<double>")
    assert [(r.category, r.rows, r.share) for r in category_distribution(none, "c", ("Loss", "Draw", "Win")).collect()] == [
        ("Loss", 0, 0.0), ("Draw", 0, 0.0), ("Win", 0, 0.0),
    ]
    for kind, column in (("index", "p"), ("dense", "d")):
        usage = plane_usage(none, column, 73, kind).collect()
        assert len(usage) == 73 and all(r.share == 0 for r in usage)


def test_board_paths(spark):
    edges = G.board_edges(spark)
    sources = spark.range(64).select(F.col("id").cast("int").alias("node"))
    paths = G.shortest_paths(edges, sources).cache()
    total = paths.agg(F.count(F.lit(1)), F.round(F.sum("dist"), 6), F.round(F.max("dist"), 6)).first()
    assert tuple(total) == (4096, 6984.2, 2.35)
    check = G.bias_checks(G.bias_matrix(paths)).first()
    assert check.cells == 65 * 65 and check.asymmetry < 1e-9 and check.diagonal == 0 and check.highest == 0
    assert round(check.lowest, 6) == -0.952574


def test_paths_by_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), round(rng.uniform(0, 3), 3)) for _ in range(120)]
    # one node holds a third of all edges
    edges += [(0, i % 30, 0.5 + i / 10) for i in range(60)]
    dist = {(s, s): 0.0 for s in (0, 7, 11)}
    for _ in range(40):
        for (s, u), d in list(dist.items()):
            for a, b, w in edges:
                if a == u and d + w < dist.get((s, b), math.inf):
                    dist[s, b] = d + w
    got = G.shortest_paths(
        spark.createDataFrame(edges, "src int, dst int, w double"), spark.createDataFrame([(0,), (7,), (11,)], "node int")
    )
    found = {(r.source, r.node): r.dist for r in got.collect()}
    assert found.keys() == dist.keys() and all(abs(found[k] - dist[k]) < 1e-9 for k in dist)


def test_move_table(spark):
    table = move_planes(spark)
    assert table.count() == 1792 and table.where("plane >= 56").count() == 336


def softmax(xs):
    top = max(xs)
    z = sum(math.exp(x - top) for x in xs)
    return [x - top - math.log(z) for x in xs]


def test_losses_by_hand(spark):
    x = [0.3, -1.2, 700.0, 2.0]
    df = spark.createDataFrame([(x, 1)], "x array<double>, t int")
    got = df.select(
        L.cross_entropy("x", "t"), L.smoothed_cross_entropy("x", "t", 0.1),
        L.masked_policy_loss("x", F.array(F.lit(0), F.lit(1)), "t"),
        L.masked_policy_loss("x", F.array(F.lit(0)), "t"),
        L.masked_policy_loss("x", F.array().cast("array<int>"), "t"),
        L.dense_policy_loss("x", F.array(F.lit(0.5), F.lit(0.5), F.lit(-1.0), F.lit(0.0))),
        L.scaled_huber(F.lit(50.0), F.lit(0)), L.scaled_huber(F.lit(4.0), F.lit(0)),
    ).first()
    logp = softmax(x)
    legal = softmax([0.3, -1.2, 2.0])
    expected = [
        -logp[1], -(0.9 * logp[1] + 0.1 / 3 * (logp[0] + logp[2] + logp[3])), -softmax([0.3, -1.2])[1], 0.0, 0.0,
        -0.5 * (legal[0] + legal[1]), 0.5 * (2.5 - 0.25), 0.02,
    ]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected))


def test_nan_logits_give_zero(spark):
    df = spark.createDataFrame([([float("nan"), 1.0], 1), ([float("inf"), 1.0], 1)], "x array<double>, t int")
    rows = df.select(L.masked_policy_loss("x", F.array(F.lit(0), F.lit(1)), "t").alias("l")).collect()
    assert [r.l for r in rows] == [0.0, 0.0]
    good, bad = split_finite(spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "v double"), ["v"])
    assert good.count() == 2 and bad.count() == 2


@pytest.mark.parametrize("kind", ["linear", "cosine", "exponential"])
def test_schedules_are_continuous(spark, kind):
    spec = Schedule(0.5, 2.0, 1000, 100, kind, 0.3)
    rows = spark.range(1300).select("id", scheduled_weight("id", spec).alias("w")).orderBy("id").collect()
    assert rows[100].w == 0.5 and rows[1100].w == 2.0
    assert all(0 <= b.w - a.w < 0.01 for a, b in zip(rows, rows[1:]))


def test_shared_folder_is_one_place(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_windows_are_plain_without_hot_keys(skewed):
    w = Window.partitionBy("k").orderBy("o")
    a = ranked(skewed, ["k"], ["o"])
    b = skewed.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert a.exceptAll(b).count() == 0


def test_tied_keys_keep_their_order(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 5)
    layouts = [df.repartition(7), df.coalesce(1), df.repartition(3, "k")]
    found = [{(r.id, r.row_index) for r in hash_ranked(d, ["k"], 1).collect()} for d in layouts]
    assert found[0] == found[1] == found[2] and {i for _, i in found[0]} == set(range(500))
