"""PageRank and components against plain loops, and the runtime beneath them."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.plans import components as cc
from gridloom.plans import pagerank as pr
from gridloom.plans import star
from gridloom.plans.bsp import Program, run
from gridloom.plans.star import star_components
from gridloom.streaming import ingest as streaming

DOCUMENTED = [(0, 1), (0, 2), (1, 3), (2, 0), (2, 1), (2, 3), (2, 4), (3, 2), (4, 0)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def plain_pagerank(edges, n, d, iterations, freeze=True):
    deg = [max(1, sum(s == i for s, _ in edges)) for i in range(n)]
    top = max((t for _, t in edges), default=-1) if freeze else n - 1
    score = [1 / n] * n
    for _ in range(iterations):
        new = [(1 - d) / n + d * sum(score[s] / deg[s] for s, t in edges if t == p) if p <= top else score[p] for p in range(n)]
        residual = sum(abs(a - b) for a, b in zip(new, score, strict=True))
        score = new
    return score, residual


def union_find(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_documented_graph(spark):
    e = frame(spark, DOCUMENTED)
    r = pr.pagerank(e, 5)
    assert r.iterations == 25 and r.residual == pytest.approx(9.8425e-07, abs=1e-10)
    got = {x.page: x.score for x in r.scores.collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.17800142, 0.17186769, 0.31160931, 0.24230450, 0.09621708], abs=1e-7)
    r = pr.pagerank(e, 5, max_iterations=5)
    got = {x.page: x.score for x in r.scores.collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.17777084, 0.17611644, 0.30294693, 0.24245463, 0.10071116], abs=1e-7)
    r = pr.pagerank(e, 5, mode="gauss_seidel")
    assert r.iterations == 27 and r.residual == pytest.approx(8.4947e-07, abs=1e-10)
    assert [x.page for x in pr.top_k(r.scores, 3).collect()] == [2, 3, 0]
    assert pr.top_k(r.scores, -1).count() == 5


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("freeze", [True, False])
def test_pagerank_equals_a_loop(spark, monkeypatch, small, freeze):
    if not small:
        monkeypatch.setattr(pr, "BROADCAST_NODES", 0)
        monkeypatch.setattr(pr, "HEAVY", 5)
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(20)) for _ in range(120)] + [(1, i) for i in range(20)] + [(4, 4), (4, 4)]
    want, residual = plain_pagerank(edges, 30, 0.85, 4, freeze)
    r = pr.pagerank(frame(spark, edges), 30, max_iterations=4, max_residual=0, freeze_tail=freeze)
    got = {x.page: x.score for x in r.scores.collect()}
    assert [got[i] for i in range(30)] == pytest.approx(want) and r.residual == pytest.approx(residual)


def test_graph_without_links(spark):
    e = frame(spark, [])
    for mode in ("jacobi", "gauss_seidel"):
        assert [x.score for x in pr.pagerank(e, 3, mode=mode).scores.collect()] == [1 / 3] * 3
    assert {(x.node, x.component) for x in cc.connected_components(e, 3).labels.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert star_components(e, "src", "dst").count() == 0


@pytest.mark.parametrize("method", ["star", "min_label"])
def test_components_equal_union_find(spark, method):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(7, 7)]
    r = cc.connected_components(frame(spark, edges), 90, method)
    assert {x.node: x.component for x in r.labels.collect()} == union_find(edges, range(90)) and r.converged
    assert cc.num_components(r.labels) == len(set(union_find(edges, range(90)).values()))
    assert sum(x.size for x in cc.component_sizes(r.labels).collect()) == 90


def test_a_long_chain_and_a_large_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)]
    got = {x.node: x.component for x in star_components(frame(spark, edges), "src", "dst").collect()}
    assert got == union_find(edges, {x for e in edges for x in e})


def test_sweeps_can_be_capped(spark):
    chain = frame(spark, [(i, i + 1) for i in range(8)])
    r = cc.connected_components(chain, 9, "min_label", max_iterations=3)
    assert r.iterations == 3 and not r.converged and r.propagations == 6
    r = cc.connected_components(chain, 9, "min_label")
    assert r.iterations == 9 and r.converged and r.propagations == 0
    r = cc.connected_components(chain, 9, max_iterations=1)
    assert r.iterations == 1 and not r.converged and r.propagations is None
    r = cc.connected_components(chain, 9)
    assert 1 < r.iterations < 8 and r.converged and r.propagations == 0
    with pytest.raises(RuntimeError):
        star_components(chain, "src", "dst", 1)


def test_a_hub_is_split_over_tasks(spark):
    """Both sides of the step's join are plain shuffles, which adaptive execution splits."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(20_000, 80_000, numPartitions=8).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).union(spark.range(1, 2000).selectExpr("id as u", "id + 100000 as v"))
        step = star._large_star(edges)
        assert step.count() == 61_999
        step.collect()
        assert "SortMergeJoin(skew=true)" in step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_working_folder_must_be_shared(spark):
    from types import SimpleNamespace

    from gridloom.storage import shared_dir

    def session(master):
        conf = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x-" + master, getConf=lambda: conf))

    assert shared_dir(session("local[3]")) == shared_dir(session("local[3]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_nulls_are_ignored(spark):
    e = frame(spark, [(1, None), (None, 2), (3, 4)])
    assert {(x.node, x.component) for x in star_components(e, "src", "dst").collect()} == {(3, 3), (4, 3)}


def test_programs(spark):
    class Doubling(Program):
        def init(self):
            return spark.range(3).select("id", F.lit(1.0).alias("x"))

        def step(self, state):
            return state.withColumn("x", F.col("x") * 2)

        def metrics(self):
            return {"total": F.sum("x")}

        def stop(self, iteration, metrics):
            return metrics["total"] > 20

    r = run(Doubling(), 10)
    assert r.iterations == 3 and [h["total"] for h in r.history] == [6.0, 12.0, 24.0]
    assert run(Doubling(), 2).iterations == 2


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "g.mtx"
    path.write_text("\n".join(["%%MatrixMarket matrix coordinate pattern general", "5 5 9", *(f"{a + 1} {b + 1}" for a, b in DOCUMENTED)]) + "\n")
    assert cli.main(["pagerank", str(path), "--print-top-k", "2"], spark) == 0
    out = capsys.readouterr().out
    assert "iterations,25" in out and out.strip().splitlines()[-2].startswith("2,0.3116")
    cli.main(["components", str(path), "--print-first-k", "1"], spark)
    assert "connected_components,1" in capsys.readouterr().out
    cli.main(["convert", str(path), str(tmp_path / "g.prm")], spark)
    cli.main(["convert", str(tmp_path / "g.prm"), str(tmp_path / "g"), "--layout", "csr"], spark)
    cli.main(["describe", str(tmp_path / "g")], spark)
    assert "nnz: 9" in capsys.readouterr().out


def test_streaming_ingest(spark, tmp_path):
    spark.createDataFrame([(0, 1, 2.0), (0, 2, 0.0), (1, 1, 3.0)], "a long, b long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long, v double").parquet(str(tmp_path / "in"))
    q = streaming.append_entries(streaming.entries(stream, ["a", "b"], "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = streaming.running_degrees(streaming.entries(stream, ["a", "b"], "v")).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.sql("select * from deg").collect()} == {(0, 1), (1, 1)}


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_sweeps_equal_a_loop_whatever_the_links(spark, monkeypatch, step):
    """No number of links is refused; pages scored together do not depend on one another."""
    monkeypatch.setattr(pr, "SWEEP_MOST", 10, raising=False)
    monkeypatch.setattr(pr, "SWEEP_STEP", step)
    rng = random.Random(step)
    edges = [(rng.randrange(60), rng.randrange(50)) for _ in range(150)] + [(i, 40) for i in range(60)] + [(4, 4), (4, 4), (48, 49)]
    deg = [max(1, sum(s == i for s, _ in edges)) for i in range(60)]
    score = [1 / 60] * 60
    for _ in range(3):
        residual = 0.0
        for p in range(50):
            new = 0.15 / 60 + 0.85 * sum(score[s] / deg[s] for s, t in edges if t == p)
            residual += abs(new - score[p])
            score[p] = new
    r = pr.pagerank(frame(spark, edges), 60, max_iterations=3, max_residual=0, mode="gauss_seidel")
    got = {x.page: x.score for x in r.scores.collect()}
    assert [got[i] for i in range(60)] == pytest.approx(score) and r.residual == pytest.approx(residual) and r.iterations == 3


@pytest.mark.parametrize("heavy", [10, 1 << 20])
def test_label_sweeps_deal_rows_by_their_number(spark, monkeypatch, heavy):
    """Tasks get about TASK_ROWS rows however many there are, links of a hub too."""
    from gridloom import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 50)
    monkeypatch.setattr(cc, "HEAVY", heavy, raising=False)
    rng = random.Random(heavy)
    edges = [(rng.randrange(700), rng.randrange(700)) for _ in range(400)] + [(650, i) for i in range(100, 400)] + [(7, 7), (3, 4), (4, 3), (3, 4), (699, None)]
    program = cc._MinLabel(frame(spark, edges), 700)
    step = program.step(program.init())
    want = -(-2 * 700 // 50)
    assert step.rdd.getNumPartitions() >= want
    links = program.links.withColumn("part", F.spark_partition_id())
    assert links.select("part").distinct().count() > want // 2
    assert links.count() == links.select("src", "dst").distinct().count()
    if heavy == 10:
        assert links.groupBy("part").count().agg(F.max("count")).first()[0] < 200
        assert links.where("src = 650").select("part").distinct().count() > 5
    program.release()
    r = cc.connected_components(frame(spark, edges), 700, "min_label")
    found = union_find([e for e in edges if None not in e], range(700))
    assert {x.node: x.component for x in r.labels.collect()} == found and r.converged


def test_settled_components_are_counted_without_a_table_of_them(spark, monkeypatch):
    from gridloom import format_queries

    edges = frame(spark, [(2 * i, 2 * i + 1) for i in range(200)] + [(401, 402), (402, 403), (403, 404)])
    monkeypatch.setattr(format_queries, "graph", lambda *_: (edges, 410))
    out = format_queries.components_run(spark, "")
    assert out.first() == (True, True, 0, 207)
    assert "hashpartitioning(component" not in out._jdf.queryExecution().executedPlan().toString()
    r = cc.connected_components(edges, 410, "min_label", max_iterations=1)
    assert not r.converged and r.labels.agg(r.components).first()[0] == r.labels.select("component").distinct().count()
