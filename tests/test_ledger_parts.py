"""Reads, snapshots, metrics, clients, sources, graph limits and streams on small hand-made state."""

import pytest
from pyspark.sql import functions as F

from tallymill import functions as fn
from tallymill.operators import clients, events, graph, metrics, reads, snapshots
from tallymill.operators.replay import replay
from tallymill.operators.state import State, aggregate_supply, supply_from_events
from tallymill.schemas import ALLOWANCES, BALANCES, COMMAND_LOG, Config
from tallymill.sources import logs, workload
from tallymill.streaming import Follower, JournalFollower, LateEntry, Replica, drop_stale_stream, windowed_velocity


def some_state(spark):
    empty = State.empty(spark)
    balances = spark.createDataFrame([(0, 100, 350, 0), (0, 200, 150, 5), (2, 100, 7, 0)], BALANCES)
    allowances = spark.createDataFrame([(0, 1, 2, 10), (0, 2, 3, 0), (0, 3, 1, 5), (0, 3, 4, 1)], ALLOWANCES)
    return State(balances, allowances, empty.command_dedup, empty.batch_dedup)


def test_reads(spark):
    state = some_state(spark)
    requests = spark.createDataFrame(
        [(1, "BALANCE", None, 100, None, None, None), (2, "BALANCE", 0, 999, None, None, None), (3, "BATCH_BALANCE", 0, None, None, None, [200, 999, 200] + list(range(600))), (4, "ALLOWANCE", 0, None, 1, 2, None),
         (5, "ALLOWANCE", 9, None, 1, 2, None), (6, "TOTAL_SUPPLY", None, None, None, None, None), (7, "TOTAL_SUPPLY", 5, None, None, None, None), (8, None, None, None, None, None, None), (9, "BATCH_BALANCE", 0, None, None, None, None)],
        "request_id long, query_type string, asset_id long, account_id long, owner_id long, delegate_id long, account_ids array<long>")
    got = {r.request_id: r for r in reads.answer(requests, state, spark.createDataFrame([(42,)], "applied_position long")).collect()}
    assert (got[1].status, got[1].balance, got[1].exists, got[1].applied_position) == ("SUCCESS", 350, True, 42)
    assert (got[2].status, got[2].balance, got[2].exists) == ("NOT_FOUND", 0, False)
    assert got[3].status == "TRUNCATED" and len(got[3].balances) == 512 and [tuple(x) for x in got[3].balances[:3]] == [(200, 150, True), (999, 0, False), (200, 150, True)]
    assert (got[4].allowance, got[5].allowance, got[5].status) == (10, 0, "SUCCESS")
    assert (got[6].total_supply, got[7].total_supply, got[8].status, got[9].balances) == (505, 0, "UNSUPPORTED", [])
    assert reads.balance(state, 200).first().balance == 150 and not reads.balance(state, 1).first().exists
    assert reads.allowance(state, 3, 1).first().allowance == 5 and int(reads.total_supply(state, 2).first().total_supply) == 7
    assert [r.balance for r in reads.batch_balances(state, [200, 5, 100]).collect()] == [150, 0, 350]
    assert int(aggregate_supply(state.supply).first()[0]) == 512


def test_snapshots(spark, tmp_path):
    state, paths = some_state(spark), [f"{tmp_path}/{i}" for i in range(4)]
    for position, path in enumerate(paths):
        snapshots.write(state, path, position * 10)
    loaded, position = snapshots.load(spark, paths[3])
    assert position == 30 and snapshots.fingerprint(loaded).first() == snapshots.fingerprint(state).first()
    # a flipped balance, and a snapshot without its manifest
    state.balances.withColumn("available", F.col("available") + 1).write.mode("overwrite").parquet(f"{paths[3]}/balances")
    import shutil

    shutil.rmtree(f"{paths[2]}/manifest")
    with pytest.raises(snapshots.SnapshotError):
        snapshots.load(spark, paths[3])
    out = snapshots.load_newest(spark, paths, applied=5)
    assert out.position == 10 and dict(out.tried) == {paths[2]: "FAILED", paths[3]: "CORRUPT", paths[1]: "LOADED"}
    assert snapshots.load_newest(spark, paths[:2], applied=50).state is None
    # equal moves between two assets keep the sum but not each asset's supply
    shifted = State(state.balances.withColumn("available", F.col("available") + F.when((F.col("asset_id") == 0) & (F.col("account_id") == 100), -1).when(F.col("asset_id") == 2, 1).otherwise(0)), state.allowances, state.command_dedup, state.batch_dedup)
    assert snapshots.problems(shifted, state.supply, snapshots.read_manifest(spark, paths[1])) != []


def test_metrics_and_health(spark):
    results = spark.createDataFrame([(False, "SUCCESS", True), (False, "OVERFLOW", False), (True, "OVERFLOW", False), (False, "INSUFFICIENT_RESERVED", False), (False, "INVALID_AMOUNT", False)], "duplicate boolean, status string, evicted boolean")
    legs = spark.createDataFrame([(False, "INVALID_CHAIN")], "duplicate boolean, status string")
    batches = spark.createDataFrame([(False, False)], "duplicate boolean, evicted boolean")
    row = metrics.counters(results, legs, batches).first()
    assert (row.commands, row.duplicates, row.overflow, row.invalid_amount, row.dedup_evicted) == (6, 1, 1, 2, 1)
    assert "ledger_commands 6" in [r.line for r in metrics.prometheus(metrics.counters(results, legs, batches)).collect()]
    assert metrics.health(spark, applied_position=9).first().healthy
    assert metrics.gauges(some_state(spark)).first().balance_count == 3
    assert metrics.latency(spark.range(1001), "id").first().max == 1000


def test_clients(spark):
    sent = clients.number_commands(spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "client_id long, t long"), "t")
    assert sorted((r.client_id, r.t, r.client_seq) for r in sent.collect()) == [(1, 3, 0), (1, 5, 1), (2, 9, 0)]
    legs = spark.createDataFrame([(1, 1, 7, 8, 2, 0, False), (1, 0, 5, 6, 1, 0, True)], "batch long, leg_idx int, from_id long, to_id long, amount long, asset_id long, linked boolean")
    assert [x.from_id for x in clients.collect_batches(legs, ["batch"]).first().legs] == [5, 7]
    with pytest.raises(Exception, match="more than 1 legs"):
        clients.collect_batches(legs, ["batch"], 1).collect()
    ids = "command_id_hi long, command_id_lo long"
    both = clients.correlate(spark.createDataFrame([(1, 0), (2, 0)], ids), spark.createDataFrame([(2, 0), (3, 0)], ids))
    assert sorted((r.command_id_hi, r.outcome) for r in both.collect()) == [(1, "pending"), (2, "matched"), (3, "late")]


def test_functions(spark):
    top = 2**63 - 1
    row = spark.createDataFrame([(top, 1, -1, "a b-c:1", 70000)], "a long, b long, s long, l string, u long").select(
        fn.add_overflows("a", "b").alias("over"), fn.add_overflows("b", "b").alias("fine"), fn.slot_index("s", 16).alias("slot"), fn.sanitise_label("l").alias("label"), fn.uint16("u").alias("u")).first()
    assert tuple(row) == (True, False, 15, "a_b_c:1", 4464)
    assert fn.fits(100, 17) == (65536 - 104) // 17
    codes = spark.createDataFrame([("RELEASE", 9)], "n string, c int").select(fn.code_of("n", {"RELEASE": 9}).alias("c"), fn.name_of("c", {"RELEASE": 9}).alias("n")).first()
    assert tuple(codes) == (9, "RELEASE")


def test_sources(spark, tmp_path):
    workload.unit_transfers(spark, 20).write.parquet(f"{tmp_path}/log")
    assert logs.read_commands(spark, f"{tmp_path}/log", after=15).count() == 6
    frame, at = logs.read_first_of(spark, [f"{tmp_path}/missing", f"{tmp_path}/log"], COMMAND_LOG)
    assert at == 1 and frame.count() == 21
    out = replay(frame)
    assert {r.account_id: r.available for r in out.state.balances.collect()} == {100: 0, 200: 20}
    assert events.conservation(out.events).count() == 0
    assert int(supply_from_events(out.events).first().total_supply) == 20
    assert workload.random_commands(spark, 200, 1).filter("command_type is null or account_a not between 1 and 8").count() == 0
    hot = workload.hot_accounts(spark, 2000).filter("account_a <= 8").count()
    assert 1600 < hot < 1950
    risk = replay(workload.risk_traffic(spark))
    spikes = graph.velocity(graph.transfer_edges(risk.events), 200).orderBy(F.desc("transfers")).first()
    assert spikes.transfers >= 20


def test_graph_limits(spark):
    state = some_state(spark)
    out = graph.GraphQuery(state).hop("a", "b").path("a", "c", 1, 0).returns("a", "c", distinct=True)
    assert out.warning == "depth clamped to 8" and out.status == "SUCCESS"
    assert graph.GraphQuery(state).hop("a", "b").returns("a", ceiling=2).truncated
    with pytest.raises(ValueError, match="UNSUPPORTED"):
        graph.GraphQuery(state).hop("a", "b").hop("x", "y")
    with pytest.raises(ValueError, match="UNSUPPORTED"):
        graph.leaf("a", "id", "LIKE", 1)
    assert {(r.account_id, r.length) for r in graph.delegation_cycles(state.allowances).collect()} == {(1, 3), (2, 3), (3, 3)}
    assert {(r.src, r.dst) for r in graph.edges(state.allowances, "ANY").filter("src = 4").collect()} == {(4, 3)}
    assert graph.dormant_allowances(state).count() == 4 and graph.assets(state).count() == 2


def test_listeners(spark):
    seen = {}
    out = replay(workload.unit_transfers(spark, 3))
    events.dispatch(out.events, {"TRANSFER": lambda df: seen.update(n=df.count())})
    assert seen == {"n": 3} and events.tallies(out.events).first().balance_changed == 7


def test_follower_equals_batch(spark, tmp_path):
    log = workload.random_commands(spark, 300, 5)
    config = Config(dedup_window=16)
    for i, (low, high) in enumerate([(0, 120), (120, 200), (200, 400)]):
        log.filter((F.col("log_position") > low) & (F.col("log_position") <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        follower = Follower(spark, f"{tmp_path}/home", config)
        follower.start(f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    state, position = Follower(spark, f"{tmp_path}/home", config).current()
    whole = replay(log, config=config)
    assert position == 300
    assert snapshots.fingerprint(state).first() == snapshots.fingerprint(whole.state).first()
    assert follower.results().count() == 300 and follower.events().count() == whole.events.count()
    assert follower.apply(log) == 300  # delivered again: nothing changes


def two_logs(spark):
    """Commands at odd positions, batches at even ones, on common accounts."""
    c = workload.random_commands(spark, 120, 5)
    commands = c.withColumn("log_position", F.col("log_position") * 2 - 1)
    legs = F.array(*[F.struct((F.col("log_position") % 8 + 1).alias("from_id"), ((F.col("log_position") * 3 + k) % 8 + 1).alias("to_id"), (F.col("log_position") % 40).alias("amount"), F.lit(0).cast("long").alias("asset_id"), F.lit(k == 0).alias("linked")) for k in (0, 1)])
    p = F.col("log_position")
    batches = c.select((p * 2).alias("log_position"), p.alias("timestamp"), F.lit(7).cast("long").alias("client_id"), p.alias("client_seq"), p.alias("batch_id_hi"), p.alias("batch_id_lo"), legs.alias("legs"))
    return commands, batches


def test_follower_of_commands_and_batches(spark, tmp_path):
    commands, batches = two_logs(spark)
    whole = replay(commands, batches, config=Config(dedup_window=16))
    cuts = [(0, 90, 40), (1, 150, 170), (2, 400, 400)]
    done = [0, 0]
    for i, to_commands, to_batches in cuts:
        for df, name, k, to in ((commands, "commands", 0, to_commands), (batches, "batches", 1, to_batches)):
            df.filter((F.col("log_position") > done[k]) & (F.col("log_position") <= to)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            done[k] = to
        follower = Follower(spark, f"{tmp_path}/home", Config(dedup_window=16), snapshot_every=2)
        follower.start(f"{tmp_path}/commands", f"{tmp_path}/checkpoint", f"{tmp_path}/batches").awaitTermination()
        assert follower.position() <= min(to_commands, to_batches, 240)
    assert follower.catch_up(f"{tmp_path}/commands", f"{tmp_path}/batches", complete=True) == 240
    state, position = Follower(spark, f"{tmp_path}/home", Config(dedup_window=16)).current()
    assert position == 240 and snapshots.fingerprint(state).first() == snapshots.fingerprint(whole.state).first()
    assert follower.events().count() == whole.events.count() and follower.results().count() == 120


def test_late_entries_are_not_dropped_silently(spark, tmp_path):
    commands, batches = two_logs(spark)
    follower = Follower(spark, f"{tmp_path}/home")
    assert follower.apply(commands.filter("log_position in (1, 11)")) == 11
    with pytest.raises(LateEntry, match="batches: position 6"):
        follower.apply(None, batches.filter("log_position = 6"))
    with pytest.raises(LateEntry, match="commands: position 5"):
        follower.apply(commands.filter("log_position in (1, 5, 13)"))
    assert follower.apply(commands.filter("log_position in (1, 11)")) == 11  # delivered again


def test_a_damaged_snapshot_is_rebuilt_from_the_log(spark, tmp_path):
    import shutil

    commands, batches = two_logs(spark)
    follower = Follower(spark, f"{tmp_path}/home")
    for low, high in ((0, 60), (60, 120)):
        follower.apply(*(df.filter((F.col("log_position") > low) & (F.col("log_position") <= high)) for df in (commands, batches)))
    wanted = snapshots.fingerprint(follower.current()[0]).first()
    for path in sorted((tmp_path / "home/snapshots").iterdir()):
        shutil.rmtree(path / "manifest")
    again = Follower(spark, f"{tmp_path}/home")
    assert snapshots.fingerprint(again.current()[0]).first() == wanted and len(again.passed_over) == 2
    assert again.apply(*(df.filter("log_position > 120") for df in (commands, batches))) == 240
    assert snapshots.fingerprint(again.current()[0]).first() == snapshots.fingerprint(replay(commands, batches).state).first()


def test_replica_fails_over_in_the_middle_of_a_log(spark, tmp_path):
    import shutil

    commands, batches = two_logs(spark)
    for copy in ("a", "b"):
        commands.coalesce(1).write.parquet(f"{tmp_path}/{copy}/commands")
        batches.filter("log_position <= 100" if copy == "a" else "true").coalesce(1).write.parquet(f"{tmp_path}/{copy}/batches")
    waited, now = [], [0.0]
    replica = Replica(Follower(spark, f"{tmp_path}/home"), [(f"{tmp_path}/{c}/commands", f"{tmp_path}/{c}/batches") for c in ("a", "b")], sleep=waited.append, clock=lambda: now[0])
    assert replica.health().first().state == "CONNECTING"
    assert replica.step() == 100 and replica.state == "FOLLOWING"
    shutil.rmtree(f"{tmp_path}/a")  # the source is gone in the middle of the log
    assert replica.step() == 100 and replica.state == "DEGRADED" and waited == [1.0]
    assert replica.step() == 239 and replica.step(complete=True) == 240 and replica.failovers == 1
    row = replica.health().first()
    assert row.healthy and row.applied_position == 240 and f"{tmp_path}/b" in row.endpoint
    state, _ = replica.follower.current()
    assert snapshots.fingerprint(state).first() == snapshots.fingerprint(replay(commands, batches).state).first()
    now[0] = 11.0  # silence beyond the liveness limit
    replica.step()
    assert replica.state == "DEGRADED" and replica.failovers == 2


def test_journal_mark_survives_a_change_of_source(spark, tmp_path):
    journal = replay(*two_logs(spark)).events
    journal.filter("log_position <= 80").coalesce(1).write.parquet(f"{tmp_path}/a")
    journal.coalesce(1).write.parquet(f"{tmp_path}/b")
    follower = JournalFollower(spark, f"{tmp_path}/home")
    follower.start(f"{tmp_path}/a", f"{tmp_path}/c1").awaitTermination()
    assert follower.mark()[0] <= 80
    JournalFollower(spark, f"{tmp_path}/home").start(f"{tmp_path}/b", f"{tmp_path}/c2").awaitTermination()
    key = ["log_position", "event_index"]
    assert follower.events().select(key).exceptAll(journal.select(key)).count() == journal.select(key).exceptAll(follower.events().select(key)).count() == 0


def test_many_newest_transfers_without_one_task(spark):
    n, k = 60_000, F.col("id")
    events = spark.range(n).select(F.lit("TRANSFER").alias("kind"), (k * k % 40_009).alias("log_position"), k.cast("int").alias("event_index"), k.alias("timestamp"), F.lit(0).alias("asset_id"), k.alias("from_account"), k.alias("to_account"), F.lit(1).alias("amount"))
    keys = sorted(((r.log_position, r.event_index) for r in events.collect()), reverse=True)
    for last in (10_001, 25_000, 70_000):
        assert [(r.log_position, r.event_index) for r in graph.transfer_edges(events, last).collect()] == keys[:last]


def test_graph_results_flag_and_time_out(spark):
    state = some_state(spark)
    out = graph.GraphQuery(state, applied_position=9).hop("a", "b").returns("a", "b", ceiling=None)
    assert out.status == "SUCCESS" and out.applied_position == 9 and dict(out.columns) == {"a": "bigint", "b": "bigint"} and len(out.fetch(60)) == 4
    slow = graph.GraphResult(spark.range(10**13).selectExpr("max(hash(id))"))
    assert slow.fetch(1.0) is None and slow.status == "TIMEOUT"
    assert {(r.from_id, r.to_id): r.reachable for r in graph.reachable(state.allowances, spark.createDataFrame([(0, 1, 4), (0, 4, 1), (0, 1, 1), (0, 2, 2), (0, 1, 9)], "asset_id long, from_id long, to_id long"), 3).collect()} == {(1, 4): True, (4, 1): False, (1, 1): True, (2, 2): True, (1, 9): False}
    assert graph.delegation_cycles(state.allowances, 2).count() == 0


def test_streamed_high_water_mark(spark, tmp_path):
    rows = [(1, 0, 5, 0), (1, 1, 5, 1), (1, 2, 5, 0), (1, 3, 6, 0), (1, 4, 5, 9), (2, 5, 1, 0)]
    schema = "stream_id long, arrival long, log_position long, event_index int"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = drop_stale_stream(source).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.stream_id, r.log_position, r.event_index) for r in spark.table("kept").collect()) == [(1, 5, 0), (1, 5, 1), (1, 6, 0), (2, 1, 0)]
    assert windowed_velocity(spark.createDataFrame([(0, 1, 5)], "asset_id long, from_account long, amount long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))).first().volume == 5


def test_result_is_independent_of_partitioning(spark):
    log, prints = workload.random_commands(spark, 300, 9), set()
    for n, by in ((1, "asset"), (5, "component")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        prints.add(snapshots.fingerprint(replay(log, config=Config(partition_by=by)).state).first()[0])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(prints) == 1


def test_velocity_and_fan_out_see_every_transfer(spark):
    from pyspark.sql import functions as F

    from tallymill.operators import graph

    n, k = 1_048_577, F.col("id")
    events = spark.range(n).select(F.lit("TRANSFER").alias("kind"), k.alias("log_position"), F.lit(0).alias("event_index"), k.alias("timestamp"), F.lit(0).alias("asset_id"), F.when(k == 0, 1).otherwise(2).alias("from_account"), k.alias("to_account"), F.lit(1).alias("amount"))
    moves = graph.transfer_edges(events)
    assert graph.velocity(moves, n).agg(F.sum("transfers")).first()[0] == n
    assert {r.from_account: r.recipients for r in graph.fan_out(moves).collect()} == {1: 1, 2: n - 1}
    assert [r.log_position for r in graph.transfer_edges(events, 2).collect()] == [n - 1, n - 2]
