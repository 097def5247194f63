"""The engine against the sequential model on random logs, and rules one by one."""

import random

import pytest
from ledger_model import MAX, Model

from tallymill.operators.replay import replay
from tallymill.schemas import BATCH_LOG, COMMAND_LOG, COMMAND_TYPES, Config


def commands_df(spark, rows):
    """rows: (position, client, seq, type, a, b, c, amount, asset)."""
    return spark.createDataFrame([(p, p * 10, cl, sq, p, 0, t, a, b, c, m, None, s) for p, cl, sq, t, a, b, c, m, s in rows], COMMAND_LOG)


def batches_df(spark, rows):
    return spark.createDataFrame([(p, p * 10, cl, sq, p, 0, [tuple(x) for x in legs]) for p, cl, sq, legs in rows], BATCH_LOG)


def random_log(seed, n=400, accounts=8, assets=3, big=False):
    rng = random.Random(seed)
    types, commands, batches = [*COMMAND_TYPES], [], []
    for pos in range(1, n + 1):
        client, seq = rng.randint(1, 4), rng.choice([rng.randint(0, n // 4), -1, pos])
        amount = rng.choice([0, rng.randint(1, 1000), rng.randint(1, 1000), -5, MAX - 10 if big else 7])
        asset = rng.choice([None, *range(assets)])
        if rng.random() < 0.25:
            legs = [(rng.randint(1, accounts), rng.randint(1, accounts), rng.choice([rng.randint(0, 300), rng.randint(0, 300), -1 if rng.random() < 0.1 else 3]), rng.randrange(assets), rng.random() < 0.4) for _ in range(rng.randint(0, 10))]
            if legs and rng.random() < 0.85:
                legs[-1] = (*legs[-1][:4], False)
            batches.append((pos, client, seq, legs))
        else:
            kind = None if rng.random() < 0.02 else rng.choice(types + ["CREDIT"] * 6)
            commands.append((pos, client, seq, kind, rng.randint(1, accounts), rng.randint(1, accounts), rng.randint(1, accounts), amount, asset))
    return commands, batches


def run_model(commands, batches, **config):
    model = Model(**config)
    for row in sorted([(r[0], "c", r) for r in commands] + [(r[0], "b", r) for r in batches]):
        model.command(*row[2]) if row[1] == "c" else model.batch(*row[2])
    return model


def observed_events(df):
    out = []
    for r in df.collect():
        e = {"BALANCE_CHANGED": (r.account_id, r.new_balance, r.delta), "TRANSFER": (r.from_account, r.to_account, r.amount), "ALLOWANCE_CHANGED": (r.owner_id, r.delegate_id, r.new_allowance), "COMMAND_REJECTED": (r.account_id, r.reason)}
        out.append((r.log_position, r.event_index, r.kind, r.asset_id, *e.get(r.kind, (r.account_id, r.new_available, r.new_reserved))))
    return sorted(out)


def check(out, model):
    got = sorted((r.log_position, r.duplicate, r.evicted, r.status, r.result_balance, r.result_allowance, r.result_reserved) for r in out.results.collect())
    assert got == sorted(model.results)
    legs = sorted(((r.log_position, r.leg_idx, r.duplicate, r.status, r.result_balance) for r in out.batch_results.collect()))
    assert legs == sorted(model.legs)
    assert observed_events(out.events) == sorted(model.events)
    assert {(r.asset_id, r.account_id): (r.available, r.reserved) for r in out.state.balances.collect()} == {k: (v, model.rs.get(k, 0)) for k, v in model.av.items()}
    assert {(r.asset_id, r.owner_id, r.delegate_id): r.allowance for r in out.state.allowances.collect()} == model.al
    assert {r.asset_id: int(r.total_supply) for r in out.state.supply.collect()} == {s: v for s, v in model.supply.items() if any(k[0] == s for k in model.av)}
    ring = {(c, e[0]): e[1] for c, slots in model.rings.items() for e in slots if e and e[0] != -1}
    assert {(r.client_id, r.client_seq): (r.status, r.result_balance, r.result_allowance, r.result_reserved) for r in out.state.command_dedup.collect()} == ring


@pytest.mark.parametrize("seed,by,fast", [(1, "component", False), (2, "asset", False), (3, "component", True)])
def test_random_logs(spark, seed, by, fast):
    commands, batches = random_log(seed, big=seed == 2)
    model = run_model(commands, batches, window=16, batch_window=16, max_batch=8)
    config = Config(16, 16, 8, partition_by=by, fast_path=fast)
    check(replay(commands_df(spark, commands), batches_df(spark, batches), config=config), model)


@pytest.mark.parametrize("seed", [11, 12])
def test_accounts_that_are_only_paid_into(spark, seed):
    """Recipients that never spend, some of them near the largest long, credited, paid, captured for and spent for."""
    rng, commands, batches = random.Random(seed), [], []
    for pos in range(1, 301):
        source, sink, asset = rng.randint(1, 5), rng.randint(101, 104), rng.randrange(2)
        amount = rng.choice([0, -1, rng.randint(1, 50), rng.randint(1, 50)])
        kind = rng.choice(["CREDIT", "CREDIT", "TRANSFER", "RESERVE", "CAPTURE", "APPROVE", "DELEGATED_TRANSFER", "BATCH"])
        if kind == "BATCH":
            batches.append((pos, 1, -1, [(rng.randint(1, 5), rng.randint(101, 104), rng.randint(0, 60), asset, k < 2 and rng.random() < 0.6) for k in range(3)]))
        elif kind == "CREDIT":
            commands.append((pos, 1, -1, kind, rng.choice([source, sink]), None, None, MAX - 400 if seed == 12 and pos % 60 == 0 else amount, asset))
        elif kind == "DELEGATED_TRANSFER":
            commands.append((pos, 1, -1, kind, rng.randint(1, 5), source, sink, amount, asset))
        else:
            commands.append((pos, 1, -1, kind, source, rng.randint(1, 5) if kind == "APPROVE" else sink, None, amount, asset))
    config = Config(16, 16, 8)
    model = run_model(commands, batches, window=16, batch_window=16, max_batch=8)
    check(replay(commands_df(spark, commands), batches_df(spark, batches), config=config), model)
    half = lambda rows, first: [r for r in rows if (r[0] <= 150) == first]
    first = replay(commands_df(spark, half(commands, True)), batches_df(spark, half(batches, True)), config=config)
    rest = replay(commands_df(spark, half(commands, False)), batches_df(spark, half(batches, False)), initial=first.state, config=config)
    assert {(r.asset_id, r.account_id): r.available for r in rest.state.balances.collect()} == model.av


def test_payments_to_sinks_do_not_join_components(spark):
    from pyspark.sql import functions as F

    from tallymill.operators import fold
    from tallymill.plans import components, sinks
    from tallymill.sources.scratch import Scratch

    rows = [(i, 0, 0, True, "TRANSFER" if i % 2 else "LEG", 0, i % 20, 1000, None, 5) for i in range(200)] + [(900 + i, 0, 0, True, "CREDIT", 0, 2000, None, None, 1) for i in range(3)]
    ops = spark.createDataFrame(rows, fold.OPS.removesuffix(", sink boolean"))
    found = sinks.find(ops)
    assert {(r.account_id, r.start) for r in found.collect()} == {(1000, 0), (2000, 0)}
    named = components.with_component(sinks.mark(ops, found), "component", Scratch(spark))
    assert named.filter("op != 'CREDIT'").agg(F.countDistinct("component")).first()[0] == 20


def test_chains_are_numbered_in_one_step_a_leg(spark):
    from tallymill.operators import prepass

    rng = random.Random(3)
    batches = [(p, 1, -1, [(1, 2, 3, 0, rng.random() < 0.5) for _ in range(rng.randint(0, 9))]) for p in range(60)]
    got = {(r.log_position, r.leg_idx): (r.chain_id, r.chain_last) for r in prepass.explode_legs(batches_df(spark, batches), "log_position").collect()}
    wanted = {}
    for p, _, _, legs in batches:
        chain = 0
        for i, leg in enumerate(legs):
            wanted[p, i] = (chain, not leg[4])
            chain += not leg[4]
    assert got == wanted
    big = batches_df(spark, [(1, 1, -1, [(1, 2, 3, 0, i % 3 != 2) for i in range(1024)])])
    assert [r.chain_id for r in prepass.explode_legs(big, "log_position").orderBy("leg_idx").collect()] == [i // 3 for i in range(1024)]


def test_fast_path_settles_successful_components(spark):
    rows = [(i, 1, i, k, a, b, None, m, 0) for i, (k, a, b, m) in enumerate([
        ("CREDIT", 1, None, 100), ("TRANSFER", 1, 2, 30), ("RESERVE", 2, None, 10), ("CAPTURE", 2, 3, 4), ("RELEASE", 2, None, 6), ("DEBIT", 3, None, 4),
        ("TRANSFER", 1, 1, 70), ("CREDIT", 9, None, 5), ("DEBIT", 9, None, 6), ("RESERVE", 1, None, 70), ("CAPTURE", 1, 1, 70)], 1)]
    batches = [(50, 1, 0, [(1, 4, 10, 0, True), (4, 5, 10, 0, False)])]
    check(replay(commands_df(spark, rows), batches_df(spark, batches), config=Config(fast_path=True)), run_model(rows, batches))


def test_resume_equals_whole_replay(spark):
    commands, batches = random_log(7, n=300)
    config = Config(16, 16, 8)
    model = run_model(commands, batches, window=16, batch_window=16, max_batch=8)
    half = lambda rows, first: [r for r in rows if (r[0] <= 150) == first]
    first = replay(commands_df(spark, half(commands, True)), batches_df(spark, half(batches, True)), config=config)
    rest = replay(commands_df(spark, half(commands, False)), batches_df(spark, half(batches, False)), initial=first.state, config=config)
    model.results = [r for r in model.results if r[0] > 150]
    model.legs = [r for r in model.legs if r[0] > 150]
    model.events = [r for r in model.events if r[0] > 150]
    check(rest, model)


CASES = {
    "zero amounts": [("CREDIT", 1, None, None, 0), ("DEBIT", 1, None, None, 0), ("TRANSFER", 1, 2, None, 0), ("APPROVE", 1, 2, None, 0), ("RESERVE", 1, None, None, 0), ("CAPTURE", 1, 2, None, 0)],
    "overflow": [("CREDIT", 1, None, None, MAX), ("CREDIT", 1, None, None, 1), ("CREDIT", 2, None, None, 11), ("TRANSFER", 2, 1, None, 11), ("RESERVE", 1, None, None, MAX), ("CREDIT", 1, None, None, MAX), ("RELEASE", 1, None, None, MAX), ("RESERVE", 1, None, None, 1), ("CAPTURE", 1, 1, None, 1)],
    "self and missing": [("TRANSFER", 1, 1, None, 0), ("CREDIT", 1, None, None, 5), ("TRANSFER", 1, 1, None, 6), ("TRANSFER", 1, 1, None, 5), ("CAPTURE", 1, 1, None, 0), ("RELEASE", 3, None, None, 0)],
    "allowance before balance": [("CREDIT", 1, None, None, 5), ("DELEGATED_TRANSFER", 2, 1, 3, 9), ("APPROVE", 1, 2, None, 9), ("DELEGATED_TRANSFER", 2, 1, 3, 9), ("DELEGATED_TRANSFER", 2, 1, 1, 5), ("DELEGATED_TRANSFER", 2, 1, 3, 4), ("DECREASE_ALLOWANCE", 1, 2, None, 1), ("INCREASE_ALLOWANCE", 1, 2, None, MAX), ("INCREASE_ALLOWANCE", 1, 2, None, 1), ("DELEGATED_TRANSFER", 1, 7, 8, 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, name):
    rows = [(i, 1, i, k, a, b, c, m, 0) for i, (k, a, b, c, m) in enumerate(CASES[name], 1)]
    check(replay(commands_df(spark, rows)), run_model(rows, []))


def test_empty_log(spark):
    out = replay(commands_df(spark, []))
    assert out.results.count() == out.events.count() == out.state.balances.count() == 0


def test_config_rejects_bad_windows():
    for bad in (0, -1, 3, 12):
        with pytest.raises(ValueError):
            Config(dedup_window=bad)
    assert Config.load({"ledger.dedupWindow": "32"}, environ={"LEDGER_MAX_BATCH_SIZE": "8"}) == Config(dedup_window=32, max_batch_size=8)
