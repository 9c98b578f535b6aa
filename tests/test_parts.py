"""Sources, functions, models and streaming."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.functions import scalar, stats
from ledgerloom.models import forward, pruning
from ledgerloom.models.boosting import Booster, Params
from ledgerloom.operators import ledger, windows
from ledgerloom.sources import fixture, tables
from ledgerloom.streaming.windows import stream_edges

SMALL = Params(trees=10, depth=3, least_weight=1.0, least_gain=0.0)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(2.0, 4.0), (3.0, 0.0), (0.0, 0.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(scalar.flow_ratio(F.col("a"), F.col("b"))).collect()][:3] == [0.5, 1.0, 0.0]
    assert df.select(scalar.finite(F.col("a"))).collect()[3][0] == 0.0
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 4, 5, 9, 10, 49, 50, 99, 100, 499, 500)], "n long")
    assert [r[0] for r in sizes.select(scalar.size_band(F.col("n"))).collect()] == ["1", "2-4", "2-4", "5-9", "5-9", "10-49", "10-49", "50-99", "50-99", "100-499", "100-499", "500+"]


def test_student_t():
    # known quantiles of the t distribution
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-8)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1)
    assert math.isnan(stats.t_two_sided(float("nan"), 5))


def test_paired_t(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 4.5), (4.0, 7.0)], "a double, b double")
    t, n = stats.paired_t(F.col("a"), F.col("b"))
    r = df.agg(t.alias("t"), n.alias("n")).select("t", "n", stats.p_value("t", "n").alias("p")).first()
    d = np.array([-1, -2, -1.5, -3])
    assert r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and r.n == 3 and 0 < r.p < 0.05


def test_csv_with_repeated_header_and_cutoff(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0\n2022/09/02 00:00,1,A,2,B,1.0,Euro,1.1,Euro,Cash,1\n2022/09/02 00:01,1,A,2,B,1.0,Euro,1.1,Euro,Cash,1\n")
    df = tables.transactions_csv(spark, str(p))
    assert df.count() == 3 and df.first().from_account == "8000EBD30" and df.first().from_bank == "010"
    assert tables.up_to(df, "2022-09-02").count() == 2  # midnight itself stays, the rest of the day goes
    assert tables.up_to(df, None).count() == 3


def test_resume_adds_only_missing_partitions(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []

    def compute(wanted):
        seen.append(sorted(r.window_id for r in wanted.collect()))
        return wanted.withColumn("x", F.lit(1))

    one = spark.createDataFrame([(0,), (1,)], "window_id long")
    assert tables.resume(spark, path, one, compute).count() == 2
    assert tables.resume(spark, path, spark.createDataFrame([(0,), (1,), (2,)], "window_id long"), compute).count() == 3
    assert seen == [[0, 1], [2]]


def test_missing_rates_and_accounts(spark):
    tx = spark.createDataFrame([(1, "2024-01-01 10:00:00", 10, 20, 2.0, "Euro", "Cash", 0, "x"), (2, "2024-01-01 11:00:00", 10, 99, 2.0, "Franc", "Cash", 0, "x"), (3, "2024-01-02 11:00:00", 10, 20, 2.0, "Franc", "Cash", 0, "x")], "tx_id long, timestamp string, from_account long, to_account long, amount_sent_c double, payment_currency string, payment_format string, is_laundering int, event_type string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    rates = spark.createDataFrame([("2024-01-01", "Euro", 1.5)], "date string, currency string, rate double").withColumn("date", F.col("date").cast("date"))
    accounts = spark.createDataFrame([(10, 1, "a"), (20, 2, "b")], "account_number long, entity_id long, entity_name string")
    got = {r.tx_id: r.adj_sent for r in ledger.resolve(ledger.convert(tx, rates), accounts).collect()}
    assert got == {1: 3.0, 3: None}
    e = windows.edges(windows.assign(ledger.resolve(ledger.convert(tx, rates), accounts), spark.sql("SELECT DATE'2024-01-01' first_date, DATE'2024-01-03' last_date"))).collect()
    assert [(r.volume, r["count"]) for r in e] == [(3.0, 2)]
    only = windows.edges(windows.assign(ledger.resolve(ledger.convert(tx.where("tx_id = 3"), rates), accounts), spark.sql("SELECT DATE'2024-01-01' first_date, DATE'2024-01-03' last_date"))).first()
    assert only.volume is None and only.time_variance == 0.0


def test_calendar_rates(spark):
    prices = spark.createDataFrame([("2024-01-02", "Euro", 1.1), ("2024-01-04", "Euro", 1.3)], "date string, currency string, close_rate double").withColumn("date", F.col("date").cast("date"))
    got = {(str(r.date), r.currency): r.rate for r in ledger.calendar_rates(prices, "2024-01-01", "2024-01-05", ["Euro", "Yen"]).collect()}
    assert got["2024-01-01", "Euro"] == 1.1 and got["2024-01-03", "Euro"] == 1.1 and got["2024-01-05", "Euro"] == 1.3
    assert got["2024-01-03", "US Dollar"] == 1.0 and not any(c == "Yen" for _, c in got)


def test_assignment_matches_range_join(spark, sf):
    rows = ledger.convert(fixture.ledger(spark, sf), ledger.fill_rates(fixture.closes(spark, sf)))
    from ledgerloom.config import Config

    for size, stride in ((3, 1), (7, 7), (5, 2), (2, 3)):
        config = Config(window_days=size, stride_days=stride)
        got = windows.assign(rows, windows.bounds(rows), config).groupBy("window_id").count()
        cal = windows.calendar(rows, config)
        want = cal.join(rows, (F.col("tx_date") >= F.col("window_start")) & (F.col("tx_date") < F.col("window_end"))).groupBy("window_id").count()
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def _features(spark, n_windows=6, n=40):
    random = np.random.default_rng(3)
    rows = []
    for w in range(n_windows):
        for e in range(n):
            y = int(random.random() < 0.3)
            rows.append((w, e, y, float(y * 2 + random.normal()), float(random.normal())))
    return spark.createDataFrame(rows, "window_id long, entity_id long, is_fraud int, signal double, noise double").repartition(5)


def test_booster_learns_and_attributions_add_up():
    random = np.random.default_rng(0)
    x = random.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    b = Booster(replace(SMALL, trees=30)).fit(x, y)
    assert ((b.predict(x) > 0.5) == (y > 0)).mean() > 0.9
    phi = b.attributions(x[:50])
    # attributions add up to the margin less its mean over the trees' own shares
    rest = b.margin(x[:50]) - phi.sum(1)
    assert np.allclose(rest, rest[0])
    assert np.abs(phi[:, 3]).mean() < np.abs(phi[:, 0]).mean()


def test_attributions_against_all_subsets():
    import itertools

    random = np.random.default_rng(2)
    x = random.normal(size=(80, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    b = Booster(replace(SMALL, trees=3)).fit(x, y)

    def expected(tree, row, known, node=0):
        j = tree.feature[node]
        if j < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if j in known:
            return expected(tree, row, known, left if row[j] <= tree.cut[node] else right)
        return sum(tree.cover[c] / tree.cover[node] * expected(tree, row, known, c) for c in (left, right))

    for row in x[:5]:
        value = {s: sum(expected(t, row, set(s)) for t in b.trees) for k in range(4) for s in itertools.combinations(range(3), k)}
        for j in range(3):
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value[tuple(sorted((*s, j)))] - value[s]) for s in value if j not in s)
            assert b.attributions(row[None])[0, j] == pytest.approx(want)


def test_shared_codes_give_each_columns_histogram():
    """Columns of few bins are counted together; sums are exact, so parts of a level can be subtracted."""
    from ledgerloom.models import boosting

    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(size=3000), r.integers(0, 3, 3000), r.integers(0, 2, 3000), r.poisson(1, 3000), r.exponential(size=3000)])
    bins = boosting.Bins(x, 64)
    assert len(bins.groups) < 5 and sorted(j for g in bins.groups for j in g) == list(range(5))
    g, h = boosting._summable(r.normal(size=3000)), boosting._summable(r.random(3000))
    rows, columns = np.flatnonzero(r.random(3000) < 0.5), np.array([0, 2, 3, 4])
    node = r.integers(0, 3, len(rows))
    got = bins.histograms(rows, node, 3, g, h, columns, 64)
    for i, j in enumerate(columns):
        for side, w in enumerate((g, h)):
            assert (got[side, :, i] == np.bincount(node * 64 + bins.codes[rows, j], w[rows], 192).reshape(3, 64)).all()


def test_listed_cases_give_the_attributions_of_the_recursion():
    from ledgerloom.models import boosting

    r = np.random.default_rng(3)
    x = r.normal(size=(400, 7))
    b = Booster(replace(SMALL, trees=6, depth=5, least_weight=1.0)).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    want = np.zeros(x.shape)
    for tree in b.trees:
        boosting._attribute(tree, x, 0, {}, want)
    assert b.attributions(x) == pytest.approx(want) and b.fitted == pytest.approx(b.margin(x))


def test_each_test_window_is_a_task_of_its_own(spark):
    p = forward.forward_chain(_features(spark), ["signal", "noise"], replace(SMALL, trees=2)).select("window_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(p) == len({r.window_id for r in p}) == len({r.p for r in p}) == 4


def test_behavioural_columns_of_large_tables_fit_in_a_worker(spark):
    from ledgerloom.operators import features

    f = spark.range(2_520_000)
    assert forward.fits(f, list(features.BEHAVIOURAL)) and not forward.fits(f, [*features.BEHAVIOURAL, *features.TOPOLOGICAL])


def test_forward_chain_sees_only_earlier_windows(spark):
    rows = forward.chained(_features(spark), ["signal"]).where("NOT is_test")
    assert rows.where("window_id >= test_window").isEmpty()
    assert {r.test_window for r in rows.select("test_window").distinct().collect()} == {2, 3, 4, 5}
    gap = forward.chained(_features(spark), ["signal"], embargo=2).where("NOT is_test")
    assert gap.where("window_id + 2 >= test_window").isEmpty()


def test_predictions_are_probabilities_and_repeatable(spark):
    f = _features(spark)
    a, b = (sorted(map(tuple, forward.forward_chain(g, ["signal", "noise"], SMALL).collect())) for g in (f, f.repartition(2)))
    assert a == b and len(a) == 160 and all(0 <= r[3] <= 1 for r in a)
    assert sum(r[2] == r[4] for r in a) > 110
    c = forward.cascade(f, ["signal", "noise"], SMALL).collect()
    assert len(c) == 160 and all(0 <= r.y_prob <= 1 for r in c)


def test_importance_and_pruning(spark):
    f = _features(spark).withColumn("copy", F.col("signal") * 2)
    imp = {r.feature: r.mean_abs_shap for r in forward.importance(f, ["signal", "noise"], SMALL).collect()}
    assert imp["signal"] > imp["noise"]
    corr = pruning.spearman(f, ["signal", "noise", "copy"])
    assert pruning.collinear(corr, {"signal": 2.0, "noise": 1.0, "copy": 1.0}) == ["copy"]
    assert pruning.collinear(corr, {}) == ["copy"]
    assert pruning.protected({"a": 3.0, "b": 1.0, "c": 0.0}, ("b", "c")) == {"a", "b"}
    worth = {"a": 0.5, "b": 0.3, "c": 0.0, "d": 0.0, "e": 0.0, "f": 0.0, "g": 0.0}
    best, history = pruning.eliminate(list(worth), lambda c: (sum(worth[x] for x in c), worth), {"a"}, least=2)
    both = forward.judged(f, ["signal", "noise"], SMALL, sample=1000)
    assert {r.feature: r.m for r in both.where("feature IS NOT NULL").groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("m")).collect()}["signal"] == pytest.approx(forward.importance(f, ["signal", "noise"], SMALL).where("feature = 'signal'").first().mean_abs_shap)
    assert {(r.window_id, r.entity_id): r.y_prob for r in both.where("feature IS NULL").collect()} == pytest.approx({(r.window_id, r.entity_id): r.y_prob for r in forward.forward_chain(f, ["signal", "noise"], SMALL).collect()})
    assert set(best) == {"a", "b"} and history[-1]["dropped"] == ["b"] or set(best) >= {"a", "b"}


@pytest.mark.parametrize("often", [1000, 1])
def test_rank_correlations_take_every_row(spark, often):
    """More rows than a sample of 10,000 held; ``often`` of 1 joins all values."""
    f = spark.range(12000).selectExpr("id % 7 AS window_id", "id AS entity_id", "CASE WHEN id < 10500 THEN id % 5 ELSE 40.0 - id / 300 END AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE sqrt(id) END AS b", "double(id * 7919 % 12007) AS c", "1.0D AS d")
    want = f.select("a", "b", "c", "d").toPandas().astype(float).fillna(0.0).rank(method="average").corr().fillna(0.0)
    got = pruning.spearman(f, ["a", "b", "c", "d"], often=often)
    assert list(got.columns) == list("abcd") and np.abs(got - want).to_numpy().max() < 1e-9


def test_tables_beyond_a_worker_train_where_they_are(spark):
    f, small, few = _features(spark), Config(local_rows=10), replace(SMALL, trees=2, least_weight=1.0)
    p = forward.forward_chain(f, ["signal", "noise"], few, config=small).collect()
    assert len(p) == 160 and {r.window_id for r in p} == {2, 3, 4, 5} and all(r.y_pred == int(r.y_prob >= r.threshold) for r in p)
    for g in (forward.importance, forward.cascade):
        with pytest.raises(ValueError, match="local_rows"):
            g(f, ["signal", "noise"], few, config=small)


def test_arrays_json_and_logs(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    tables.write_array(a, str(tmp_path / "a"))
    assert (tables.read_array(str(tmp_path / "a")) == a).all()
    tables.write_json({"b": [1, "é"]}, f"file://{tmp_path}/x.json")
    assert tables.read_json(str(tmp_path / "x.json")) == {"b": [1, "é"]}
    tables.log_tee(str(tmp_path / "log"), "trial").info("written twice")
    assert "written twice" in (tmp_path / "log").read_text()


def test_undersample(spark):
    got = forward.undersample(_features(spark), ratio=1).groupBy("is_fraud").count().collect()
    counts = {r.is_fraud: r["count"] for r in got}
    assert counts[0] == counts[1]


def test_distributed_trees(spark):
    p = forward.distributed(_features(spark), ["signal", "noise"], [5], [0, 1, 2, 3, 4], replace(SMALL, trees=3, least_weight=1.0)).collect()
    assert len(p) == 40 and all(0 <= r.y_prob <= 1 for r in p)


def test_stream_edges_match_batch(spark, sf, tmp_path):
    rows = ledger.resolve(ledger.convert(fixture.ledger(spark, sf), ledger.fill_rates(fixture.closes(spark, sf))), fixture.accounts(spark, sf))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_edges(stream).writeStream.format("memory").queryName("streamed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("streamed").select("window_start", "source", "target", F.round("volume", 6).alias("volume"), "count")
    want = windows.edges(windows.assign(rows, windows.bounds(rows))).select("window_start", "source", "target", F.round("volume", 6).alias("volume"), "count")
    assert want.exceptAll(got).isEmpty()  # the stream has partial first and last windows too


def test_command_line(spark, sf, tmp_path, capsys):
    from ledgerloom.__main__ import main

    moves = "".join(f"2022/09/0{d} 00:2{d},1,{a},1,{b},9.5,Euro,9.5,Euro,Wire,{int(a == 'A')}\n" for d in range(1, 6) for a, b in (("A", "B"), ("B", "C"), ("C", "A")))
    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n" + moves)
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nx,1,A,E1,n1\nx,1,B,E2,n2\nx,1,C,E3,n3\n")
    rates = spark.createDataFrame([(f"2022-09-0{d}", "Euro", 1.1) for d in range(1, 6)], "date string, currency string, rate double")
    rates.withColumn("date", F.col("date").cast("date")).write.parquet(str(tmp_path / "r"))
    out = str(tmp_path / "out")
    assert main(["clean", "--transactions", str(tmp_path / "t.csv"), "--accounts", str(tmp_path / "a.csv"), "--output", out]) == 0
    assert main(["features", "--input", out, "--rates", str(tmp_path / "r"), "--output", str(tmp_path / "f")]) == 0
    f = spark.read.parquet(str(tmp_path / "f"))
    assert f.count() == 9 and {r.cycle_count for r in f.collect()} == {1} and {"hits_hub", "leiden_micro_size", "flow_ratio", "is_riser"} <= set(f.columns)
    assert main(["fraud-rate", "--input", out, "--output", str(tmp_path / "rates")]) == 0
    assert main(["query", "tx_fraud_rate", "--input", sf]) == 0
