"""DuckDB SQL that must return the same rows as the registered queries."""

from __future__ import annotations

SINGLE = """single as (
  select event_id + 1 as log_position, user_id as client_id, row_number() over (partition by user_id order by event_id) - 1 as client_seq,
    case event_type when 'signup' then 'CREDIT' when 'purchase' then 'DEBIT' when 'click' then 'RESERVE' when 'view' then 'RELEASE' else 'CAPTURE' end as command_type,
    event_id % 3 as asset_id, user_id as account_a,
    cast(round(value * 100) as bigint) * case when event_id % 97 = 0 then -1 else 1 end as amount
  from events)"""

RETRY = (
    SINGLE
    + """, retry as (
  select p as log_position, client_id, client_seq, command_type, asset_id, account_a, amount from (
    select *, unnest(list_filter([2 * log_position - 1, case when (log_position - 1) % 10 = 9 then 2 * log_position end,
      case when (log_position - 1) % 25 = 0 then 2 * (log_position + 500) end, case when (log_position - 1) % 50 = 3 then 2 * (log_position + 5000) end], lambda x: x is not null)) as p
    from single)),
looked as (select *, lag(client_seq) over (partition by client_id, client_seq & 15 order by log_position) as prior from retry),
flagged as (select *, coalesce(prior = client_seq, false) as duplicate from looked),
marked as (
  select *, not duplicate and coalesce(prior <> client_seq, false) as evicted,
    last_value(case when not duplicate then log_position end ignore nulls) over (partition by client_id, client_seq & 15 order by log_position rows between unbounded preceding and current row) as origin
  from flagged)"""
)

_STATUS = """case when o.amount < 0 then 'INVALID_AMOUNT' when o.command_type = 'CREDIT' then 'SUCCESS' when s.av is null then 'INVALID_ACCOUNT'
  when o.command_type in ('DEBIT', 'RESERVE') and s.av < o.amount then 'INSUFFICIENT_BALANCE'
  when o.command_type in ('RELEASE', 'CAPTURE') and s.rs < o.amount then 'INSUFFICIENT_RESERVED' else 'SUCCESS' end"""


def folded(source: str) -> str:
    """CTEs ``ops`` and ``st``: a fold per (asset, account) of ``source``, one row per operation and a row 0 per key."""
    return f"""ops as (select *, row_number() over (partition by asset_id, account_a order by log_position) as n from {source}),
st as (
  select distinct asset_id, account_a, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, '' as command_type, cast(0 as bigint) as amount, '' as status, cast(null as bigint) as av, cast(0 as bigint) as rs from ops
  union all
  select asset_id, account_a, n, log_position, command_type, amount, status,
    case when status <> 'SUCCESS' then av when command_type = 'CREDIT' then coalesce(av, 0) + amount when command_type in ('DEBIT', 'RESERVE') then av - amount else av + amount end,
    case when status <> 'SUCCESS' then rs when command_type = 'RESERVE' then rs + amount when command_type in ('RELEASE', 'CAPTURE') then rs - amount else rs end
  from (select o.*, s.av, s.rs, {_STATUS} as status from st s join ops o on o.asset_id = s.asset_id and o.account_a = s.account_a and o.n = s.n + 1))"""


FRESH = f"with recursive {RETRY}, {folded('(select * from marked where not duplicate)')}"
PLAIN = f"with recursive {SINGLE}, {folded('single')}"
LAST = "(select asset_id, account_a as account_id, max_by(av, n) as available, max_by(rs, n) as reserved from st group by all having max_by(av, n) is not null)"

_HELD = "command_type in ('RESERVE', 'RELEASE', 'CAPTURE')"
RESULTS = f"""select m.log_position, m.duplicate, m.evicted, r.status, case when r.status = 'SUCCESS' then r.av end as result_balance, cast(null as bigint) as result_allowance,
  case when r.status = 'SUCCESS' and r.{_HELD} then r.rs end as result_reserved from marked m join st r on r.log_position = m.origin"""

MULTI = """multi as (
  select event_id + 1 as log_position, cast(floor(user_id / 5) as bigint) as g, event_id,
    case event_type when 'signup' then 'CREDIT' when 'purchase' then case when event_id % 2 = 0 then 'TRANSFER' else 'DEBIT' end
      when 'click' then case when event_id % 2 = 0 then 'RESERVE' else 'APPROVE' end when 'view' then case when event_id % 2 = 0 then 'CAPTURE' else 'RELEASE' end
      else case event_id % 3 when 0 then 'DELEGATED_TRANSFER' when 1 then 'INCREASE_ALLOWANCE' else 'DECREASE_ALLOWANCE' end end as command_type,
    cast(user_id % 5 + 1 as int) as a, cast(case when event_id % 41 = 0 then user_id % 5 else (user_id + 1 + event_id % 4) % 5 end + 1 as int) as b, cast((user_id + 2) % 5 + 1 as int) as c,
    cast(round(value * 100) as bigint) as amount
  from events),
mops as (select *, row_number() over (partition by g order by log_position) as n from multi),
mst as (
  select distinct g, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, '' as command_type, 0 as a, 0 as b, 0 as c, cast(0 as bigint) as amount, '' as status,
    [cast(null as bigint), null, null, null, null] as av, [cast(0 as bigint), 0, 0, 0, 0] as rs, list_transform(range(25), lambda x: cast(null as bigint)) as al from mops
  union all
  select g, n, log_position, command_type, a, b, c, amount, status,
    case when status <> 'SUCCESS' then av else list_transform(av, lambda v, i:
      case when command_type = 'CREDIT' and i = a then coalesce(v, 0) + amount
        when command_type in ('DEBIT', 'RESERVE') and i = a then v - amount
        when command_type = 'RELEASE' and i = a then v + amount
        when command_type = 'TRANSFER' and a <> b and i = a then v - amount
        when command_type = 'TRANSFER' and a <> b and i = b then coalesce(v, 0) + amount
        when command_type = 'CAPTURE' and i = b then coalesce(v, 0) + amount
        when command_type = 'DELEGATED_TRANSFER' and b <> c and i = b then v - amount
        when command_type = 'DELEGATED_TRANSFER' and b <> c and i = c then coalesce(v, 0) + amount else v end) end,
    case when status <> 'SUCCESS' then rs else list_transform(rs, lambda v, i:
      case when i = a and command_type = 'RESERVE' then v + amount when i = a and command_type in ('RELEASE', 'CAPTURE') then v - amount else v end) end,
    case when status <> 'SUCCESS' then al else list_transform(al, lambda v, i:
      case when i = k and command_type = 'APPROVE' then amount when i = k and command_type = 'INCREASE_ALLOWANCE' then coalesce(v, 0) + amount
        when i = k and command_type in ('DECREASE_ALLOWANCE', 'DELEGATED_TRANSFER') then coalesce(v, 0) - amount else v end) end
  from (
    select o.g, o.n, o.log_position, o.command_type, o.a, o.b, o.c, o.amount, s.av, s.rs, s.al,
      case when o.command_type = 'DELEGATED_TRANSFER' then (o.b - 1) * 5 + o.a else (o.a - 1) * 5 + o.b end as k,
      case when o.command_type in ('CREDIT', 'APPROVE', 'INCREASE_ALLOWANCE') then 'SUCCESS'
        when o.command_type = 'DECREASE_ALLOWANCE' then case when coalesce(s.al[(o.a - 1) * 5 + o.b], 0) < o.amount then 'INSUFFICIENT_ALLOWANCE' else 'SUCCESS' end
        when o.command_type = 'DELEGATED_TRANSFER' then case when coalesce(s.al[(o.b - 1) * 5 + o.a], 0) < o.amount then 'INSUFFICIENT_ALLOWANCE'
          when s.av[o.b] is null then 'INVALID_ACCOUNT' when s.av[o.b] < o.amount then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end
        when s.av[o.a] is null then 'INVALID_ACCOUNT'
        when o.command_type in ('RELEASE', 'CAPTURE') then case when s.rs[o.a] < o.amount then 'INSUFFICIENT_RESERVED' else 'SUCCESS' end
        when s.av[o.a] < o.amount then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end as status
    from mst s join mops o on o.g = s.g and o.n = s.n + 1)),
mdone as (
  select log_position, g, command_type, a, b, c, amount, status,
    case when status = 'SUCCESS' and command_type in ('CREDIT', 'DEBIT', 'TRANSFER', 'RESERVE', 'RELEASE', 'CAPTURE') then av[a] when status = 'SUCCESS' and command_type = 'DELEGATED_TRANSFER' then av[b] end as result_balance,
    case when status <> 'SUCCESS' then null when command_type in ('APPROVE', 'INCREASE_ALLOWANCE', 'DECREASE_ALLOWANCE') then al[(a - 1) * 5 + b] when command_type = 'DELEGATED_TRANSFER' then al[(b - 1) * 5 + a] end as result_allowance,
    case when status = 'SUCCESS' and command_type in ('RESERVE', 'RELEASE', 'CAPTURE') then rs[a] end as result_reserved
  from mst where n > 0),
mlast as (select g, max_by(av, n) as av, max_by(rs, n) as rs, max_by(al, n) as al from mst group by g),
mbalances as (select cast(0 as bigint) as asset_id, g * 5 + i - 1 as account_id, av[i] as available, rs[i] as reserved from mlast, range(1, 6) t(i) where av[i] is not null),
mallowances as (select cast(0 as bigint) as asset_id, g * 5 + (i - 1) // 5 as owner_id, g * 5 + (i - 1) % 5 as delegate_id, al[i] as allowance from mlast, range(1, 26) t(i) where al[i] is not null)"""
GROUPS = f"with recursive {MULTI}"
#: Transfers of the multi-account journal: who paid whom, and where in its command's events.
TRANSFERS = """mmoves as (
  select log_position, cast(case command_type when 'CAPTURE' then 2 else 2 end as int) as event_index, g * 5 + case command_type when 'DELEGATED_TRANSFER' then b else a end - 1 as from_account,
    g * 5 + case command_type when 'DELEGATED_TRANSFER' then c else b end - 1 as to_account, amount
  from mdone where status = 'SUCCESS' and ((command_type in ('TRANSFER', 'CAPTURE') and a <> b) or (command_type = 'DELEGATED_TRANSFER' and b <> c)))"""


def typed(*kinds: str) -> str:
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"{GROUPS} select log_position, command_type, status, result_balance, result_allowance, result_reserved from mdone where command_type in ({names})"


LEGS = """legs as (
  select o_custkey as customer, l_orderkey + 1000001 as log_position, 1000000 + l_suppkey as supplier, cast(round(l_quantity * 100) as bigint) as amount,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as leg_idx,
    count(*) over (partition by l_orderkey) as n_legs
  from lineitem join orders on l_orderkey = o_orderkey)"""
FUNDS = "funds as (select cast(c_custkey as bigint) as account_id, cast(round(c_acctbal * 100) as bigint) as available from customer where cast(round(c_acctbal * 100) as bigint) >= 0)"
PAID = f"""with recursive {LEGS}, {FUNDS},
batch as (select customer, log_position, sum(amount) as total, row_number() over (partition by customer order by log_position) as n from legs group by customer, log_position),
bst as (
  select customer, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, cast(available as hugeint) as av, cast(available as hugeint) as before, '' as status from (select distinct customer from batch) left join funds on account_id = customer
  union all
  select customer, n, log_position, case when status = 'SUCCESS' then av - total else av end, av, status from (
    select b.*, s.av, case when s.av is null then 'INVALID_ACCOUNT' when s.av < b.total then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end as status from bst s join batch b on b.customer = s.customer and b.n = s.n + 1)),
paid as (
  select l.log_position, cast(l.leg_idx as int) as leg_idx, l.supplier, l.amount, b.status, b.status = 'SUCCESS' as has_balance,
    case when b.status = 'SUCCESS' then cast(b.before - sum(l.amount) over (partition by l.log_position order by l.leg_idx) as bigint) end as result_balance
  from legs l join bst b using (log_position))"""
ALONE = f"""with recursive {LEGS}, {FUNDS},
each as (select *, row_number() over (partition by customer order by log_position, leg_idx) as n from legs),
est as (
  select customer, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, cast(0 as bigint) as leg_idx, available as av, '' as status from (select distinct customer from each) left join funds on account_id = customer
  union all
  select customer, n, log_position, leg_idx, case when status = 'SUCCESS' then av - amount else av end, status from (
    select e.*, s.av, case when s.av is null then 'INVALID_ACCOUNT' when s.av < e.amount then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end as status from est s join each e on e.customer = s.customer and e.n = s.n + 1))"""

THREES = f"""with recursive {LEGS}, {FUNDS},
chains as (select customer, log_position, leg_idx // 3 as chain, sum(amount) as total, row_number() over (partition by customer order by log_position, leg_idx // 3) as n from legs group by customer, log_position, leg_idx // 3),
cst as (
  select customer, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, cast(0 as bigint) as chain, cast(available as hugeint) as av, cast(available as hugeint) as before, '' as status from (select distinct customer from chains) left join funds on account_id = customer
  union all
  select customer, n, log_position, chain, case when status = 'SUCCESS' then av - total else av end, av, status from (
    select c.*, s.av, case when s.av is null then 'INVALID_ACCOUNT' when s.av < (
      select max(t.so_far) from (select sum(l.amount) over (order by l.leg_idx) as so_far from legs l where l.log_position = c.log_position and l.leg_idx // 3 = c.chain) t) then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end as status
    from cst s join chains c on c.customer = s.customer and c.n = s.n + 1))"""
BATCHES = f"""with recursive {LEGS}, {FUNDS},
heads as (select customer as client_id, log_position as own, row_number() over (partition by customer order by log_position) - 1 as client_seq from legs group by customer, log_position),
sent as (select *, unnest(list_filter([4 * own, case when (own - 1000001) % 5 = 0 then 4 * own + 1 end, case when (own - 1000001) % 7 = 0 then 4 * own + 162 end], lambda x: x is not null)) as log_position from heads),
looked as (select *, lag(client_seq) over (partition by client_id, client_seq & 15 order by log_position) as prior from sent),
flagged as (select *, coalesce(prior = client_seq, false) as duplicate from looked),
bmarked as (
  select *, not duplicate and coalesce(prior <> client_seq, false) as evicted,
    last_value(case when not duplicate then log_position end ignore nulls) over (partition by client_id, client_seq & 15 order by log_position rows between unbounded preceding and current row) as origin
  from flagged)"""
EDGES = """edges as (
  select event_id % 3 as asset_id, user_id as owner_id, delegate_id, max_by(cast(round(value * 100) as bigint), event_id) as allowance
  from (select *, lead(user_id) over (order by event_id) as delegate_id from events) where event_type = 'purchase' and delegate_id is not null group by all)"""
GRAPH = f"with recursive {SINGLE}, {folded('single')}, {EDGES}, nodes as {LAST}"


def reach(edges: str, seeds: str, hops: int) -> str:
    return f"""walk as (
  select asset_id, seed, seed as node, 0 as hop from ({seeds})
  union
  select w.asset_id, w.seed, e.delegate_id, w.hop + 1 from walk w join {edges} e on e.asset_id = w.asset_id and e.owner_id = w.node where w.hop < {hops}),
near as (select asset_id, seed, node, min(hop) as hop from walk where hop > 0 group by all)"""


GRID = "grid as (select id % 2 = 0 as flag, cast(id // 2 % 7 * 10 as bigint) as now, cast(id // 14 % 5 as bigint) as retries, cast(id // 70 % 4 as bigint) as max_retries from range(280) t(id))"
_HWM = """n as (select max(event_id) as n from events),
sent as (
  select event_id + case when event_id % 50 = 0 then 7 else 0 end * 1.0::double as arrival, event_id // 4 as log_position, cast(event_id % 4 as int) as event_index from events
  union all
  select event_id + 0.5::double + n * 0.3::double, event_id // 4, cast(event_id % 4 as int) from events, n where event_id * 5 < n)"""


def oracle_sql() -> dict[str, str]:
    events = f"""select log_position, 0 as event_index,
      case when status <> 'SUCCESS' then 'COMMAND_REJECTED' when command_type in ('CREDIT', 'DEBIT') then 'BALANCE_CHANGED' when command_type = 'RESERVE' then 'RESERVED' when command_type = 'RELEASE' then 'RELEASED' else 'CAPTURED' end as kind,
      asset_id, account_a as account_id, case when status = 'SUCCESS' and command_type in ('CREDIT', 'DEBIT') then av end as new_balance,
      case when status = 'SUCCESS' and command_type in ('CREDIT', 'DEBIT') then case command_type when 'CREDIT' then amount else -amount end end as delta,
      case when status = 'SUCCESS' and command_type in ('CREDIT', 'DEBIT') then command_type end as cause,
      case when status = 'SUCCESS' and {_HELD} then av end as new_available, case when status = 'SUCCESS' and {_HELD} then rs end as new_reserved,
      case when status <> 'SUCCESS' then command_type end as command_type, case when status <> 'SUCCESS' then status end as reason from st where n > 0"""
    ok = "select log_position, leg_idx, status, has_balance, result_balance from paid"
    return {
        "command_log_validate": f"with {SINGLE} select log_position, asset_id, command_type, amount, case when amount < 0 then 'INVALID_AMOUNT' else 'OK' end as verdict from single",
        "dedup_flags": f"with {RETRY} select log_position, client_id, client_seq, duplicate, evicted, origin as origin_position from marked",
        "dedup_evictions": f"with {RETRY} select client_id, cast(count(*) filter (duplicate) as bigint) as duplicates, cast(count(*) filter (evicted) as bigint) as evictions from marked group by client_id",
        "dedup_final_slots": f"with {RETRY} select client_id, client_seq & 15 as slot, max_by(client_seq, log_position) as client_seq from retry group by all",
        "dedup_client_counts": f"with {RETRY} select count(distinct client_id) as clients, count(distinct (client_id, client_seq & 15)) as slots from retry",
        "single_account_results": f"{FRESH} {RESULTS}",
        "dedup_replayed_results": f"{FRESH} {RESULTS} where m.duplicate",
        "single_account_balances": f"{FRESH} select * from {LAST}",
        "single_account_supply": f"{FRESH} select asset_id, cast(sum(available + reserved) as bigint) as total_supply from {LAST} group by asset_id",
        "status_counts": f"{FRESH} select status, count(*) as n from st where n > 0 group by status",
        "core_counters": f"""{FRESH} select (select count(*) from marked) as commands, (select count(*) from marked where duplicate) as duplicates, (select count(*) from marked where evicted) as dedup_evicted,
          count(*) filter (status = 'INSUFFICIENT_ALLOWANCE') as insufficient_allowance, count(*) filter (status = 'INSUFFICIENT_BALANCE') as insufficient_balance, count(*) filter (status = 'INVALID_ACCOUNT') as invalid_account,
          count(*) filter (status in ('INVALID_AMOUNT', 'INVALID_CHAIN')) as invalid_amount, count(*) filter (status = 'OVERFLOW') as overflow from st where n > 0""",
        "size_gauges": f"{GROUPS} select (select count(*) from mbalances) as balance_count, (select count(distinct owner_id) from mallowances) as owner_count, (select count(distinct user_id) from events) as client_count",
        "transfer_results": typed("TRANSFER", "CAPTURE", "CREDIT", "DEBIT", "RESERVE", "RELEASE"),
        "transfer_balances": f"{GROUPS} select * from mbalances",
        "allowance_results": typed("APPROVE", "INCREASE_ALLOWANCE", "DECREASE_ALLOWANCE"),
        "delegated_transfer_results": typed("DELEGATED_TRANSFER"),
        "allowance_final": f"{GROUPS} select * from mallowances",
        "batch_chains": f"with {LEGS} select log_position, cast(leg_idx as int) as leg_idx, 0 as chain_id, leg_idx = n_legs - 1 as chain_last, customer as from_id, supplier as to_id, amount from legs",
        "batch_structural_rejects": f"with {LEGS} select log_position, cast(count(*) as int) as legs, case when count(*) > 8 then 'INVALID_CHAIN' else 'OK' end as verdict from legs group by log_position",
        "batch_oversized_results": f"with {LEGS} select 'INVALID_CHAIN' as status, cast(8 * count(distinct log_position) as bigint) as n from legs where n_legs > 8",
        "batch_leg_results": f"{PAID} {ok}",
        "batch_independent_legs": f"{ALONE} select log_position, cast(leg_idx as int) as leg_idx, status, status = 'SUCCESS' as has_balance, case when status = 'SUCCESS' then av end as result_balance from est where n > 0",
        "batch_multi_chains": f"with {LEGS} select log_position, cast(leg_idx as int) as leg_idx, cast(leg_idx // 3 as int) as chain_id, leg_idx % 3 = 2 or leg_idx = n_legs - 1 as chain_last, customer as from_id, supplier as to_id, amount from legs",
        "batch_multi_chain_results": f"""{THREES} select l.log_position, cast(l.leg_idx as int) as leg_idx, status, status = 'SUCCESS' as has_balance,
          case when status = 'SUCCESS' then cast(before - sum(l.amount) over (partition by l.log_position, l.leg_idx // 3 order by l.leg_idx) as bigint) end as result_balance
          from legs l join cst on cst.log_position = l.log_position and cst.chain = l.leg_idx // 3 and cst.n > 0""",
        "batch_dedup_flags": f"{BATCHES} select log_position, client_id, client_seq, duplicate, evicted, origin as origin_position from bmarked",
        "batch_replayed_legs": f"""{BATCHES},
          runs as (select log_position, client_id as customer, own, row_number() over (partition by client_id order by log_position) as n, (select sum(amount) from legs l where l.log_position = own) as total from bmarked where not duplicate),
          rst as (
            select customer, cast(0 as bigint) as n, cast(-1 as bigint) as log_position, cast(-1 as bigint) as own, cast(available as hugeint) as av, cast(available as hugeint) as before, '' as status from (select distinct customer from runs) left join funds on account_id = customer
            union all
            select customer, n, log_position, own, case when status = 'SUCCESS' then av - total else av end, av, status from (
              select r.*, s.av, case when s.av is null then 'INVALID_ACCOUNT' when s.av < r.total then 'INSUFFICIENT_BALANCE' else 'SUCCESS' end as status from rst s join runs r on r.customer = s.customer and r.n = s.n + 1))
          select m.log_position, cast(l.leg_idx as int) as leg_idx, r.status, r.status = 'SUCCESS' as has_balance,
            case when r.status = 'SUCCESS' then cast(r.before - sum(l.amount) over (partition by m.log_position order by l.leg_idx) as bigint) end as result_balance
          from bmarked m join rst r on r.log_position = m.origin join legs l on l.log_position = m.own where m.duplicate""",
        "batch_events": f"""{PAID}, each as (select p.*, l.customer, sum(case when p.status = 'SUCCESS' then p.amount else 0 end) over (partition by p.supplier order by p.log_position, p.leg_idx) as got from paid p join legs l on l.log_position = p.log_position and l.leg_idx = p.leg_idx)
          select log_position, cast(leg_idx * 3 as int) as event_index, 'BALANCE_CHANGED' as kind, customer as account_id, result_balance as new_balance, -amount as delta, 'TRANSFER_DEBIT' as cause, cast(null as bigint) as from_account, cast(null as bigint) as to_account, cast(null as bigint) as amount, cast(null as varchar) as reason from each where status = 'SUCCESS'
          union all select log_position, cast(leg_idx * 3 + 1 as int), 'BALANCE_CHANGED', supplier, cast(got as bigint), amount, 'TRANSFER_CREDIT', null, null, null, null from each where status = 'SUCCESS'
          union all select log_position, cast(leg_idx * 3 + 2 as int), 'TRANSFER', null, null, null, null, customer, supplier, amount, null from each where status = 'SUCCESS'
          union all select log_position, cast(leg_idx as int), 'COMMAND_REJECTED', customer, null, null, null, null, null, amount, status from each where status <> 'SUCCESS'""",
        "edge_results": """select c_custkey * 8 + i + 1 as log_position, status, bal as result_balance, res as result_reserved from customer, (values
          (0, 'SUCCESS', 9223372036854775797, null), (1, 'OVERFLOW', null, null), (2, 'INVALID_AMOUNT', null, null), (3, 'SUCCESS', 9223372036854775807, null), (4, 'INVALID_ACCOUNT', null, null),
          (5, 'SUCCESS', 7, null), (6, 'SUCCESS', 9223372036854775802, null), (7, 'INSUFFICIENT_BALANCE', null, null::bigint)) t(i, status, bal, res)""",
        "edge_balances": "select cast(a as bigint) as asset_id, cast(c_custkey as bigint) as account_id, v as available, cast(0 as bigint) as reserved from customer, (values (0, 9223372036854775802), (1, 7)) t(a, v)",
        "batch_open_chain": f"with {LEGS} select 'INVALID_CHAIN' as status, count(*) as n from legs",
        "batch_supplier_balances": f"{PAID} select supplier as account_id, cast(sum(amount) as bigint) as available from paid where status = 'SUCCESS' group by supplier",
        "events_exploded": f"{FRESH} {events}",
        "event_counts": f"""{GROUPS} select kind, cast(sum(n) as bigint) as n from (
          select 'COMMAND_REJECTED' as kind, count(*) as n from mdone where status <> 'SUCCESS'
          union all select 'BALANCE_CHANGED', sum(case when command_type in ('CREDIT', 'DEBIT') then 1 when command_type = 'TRANSFER' and a <> b then 2 when command_type = 'CAPTURE' and a <> b then 1 when command_type = 'DELEGATED_TRANSFER' and b <> c then 2 else 0 end) from mdone where status = 'SUCCESS'
          union all select 'TRANSFER', sum(case when (command_type in ('TRANSFER', 'CAPTURE') and a <> b) or (command_type = 'DELEGATED_TRANSFER' and b <> c) then 1 else 0 end) from mdone where status = 'SUCCESS'
          union all select 'ALLOWANCE_CHANGED', count(*) from mdone where status = 'SUCCESS' and command_type in ('APPROVE', 'INCREASE_ALLOWANCE', 'DECREASE_ALLOWANCE', 'DELEGATED_TRANSFER')
          union all select case command_type when 'RESERVE' then 'RESERVED' when 'RELEASE' then 'RELEASED' else 'CAPTURED' end, count(*) from mdone where status = 'SUCCESS' and command_type in ('RESERVE', 'RELEASE', 'CAPTURE') group by 1)
          where n > 0 group by kind""",
        "event_tallies": f"""{FRESH}, ev as ({events}) select count(*) as total, count(*) filter (kind = 'BALANCE_CHANGED') as balance_changed, cast(0 as bigint) as transfers, cast(0 as bigint) as allowance_changed,
          count(*) filter (kind in ('RESERVED', 'CAPTURED', 'RELEASED')) as holds, count(*) filter (kind = 'COMMAND_REJECTED') as rejected from ev""",
        "event_conservation": f"{GROUPS} select cast(0 as bigint) as net, count(*) as entries from mdone where status = 'SUCCESS' and ((command_type = 'TRANSFER' and a <> b) or (command_type = 'DELEGATED_TRANSFER' and b <> c)) having count(*) > 0",
        "hwm_dedup": f"""with {_HWM}, seen as (select *, max(log_position * 4 + event_index) over (order by arrival, log_position, event_index rows between unbounded preceding and 1 preceding) as mark from sent)
          select log_position, event_index from seen where mark is null or log_position * 4 + event_index > mark""",
        "balance_lookup": f"""with {FUNDS}, asked as (select cast(c_custkey as bigint) as request_id, cast(c_custkey as bigint) as account_id from customer union all select -1 - id, -1000 - id from range(3) t(id))
          select request_id, case when available is null then 'NOT_FOUND' else 'SUCCESS' end as status, (select max(c_custkey) + 1 from customer) as applied_position, asked.account_id, coalesce(available, 0) as balance, available is not null as exists
          from asked left join funds using (account_id)""",
        "batch_balance_lookup": f"""with {FUNDS}, asked as (
            select 10000000 + c_nationkey as request_id, cast(c_custkey as bigint) as account_id, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pos, count(*) over (partition by c_nationkey) as n from customer
            union all select 20000000, id, id, 600 from range(600) t(id))
          select request_id, case when n > 512 then 'TRUNCATED' else 'SUCCESS' end as status, cast(pos as int) as pos, asked.account_id, coalesce(available, 0) as balance, available is not null as exists
          from asked left join funds using (account_id) where pos < 512""",
        "allowance_lookup": f"""with {EDGES} select 30000000 + owner_id * 1000000 + delegate_id as request_id, 'SUCCESS' as status, owner_id, delegate_id, allowance from edges where asset_id = 0
          union all select -100 - id, 'SUCCESS', -5 - id, id, 0 from range(2) t(id)""",
        "total_supply_lookup": f"with {FUNDS} select -200 - id as request_id, 'SUCCESS' as status, id as asset_id, case when id = 0 then (select cast(sum(available) as bigint) from funds) else 0 end as total_supply from range(4) t(id)",
        "unsupported_query": "select cast(-1000 - c_custkey as bigint) as request_id, case when c_custkey % 2 = 0 then 'HISTORY' end as query_type, 'UNSUPPORTED' as status, (select max(c_custkey) + 1 from customer) as applied_position from customer",
        "state_at_position": f"""{PLAIN} select asset_id, account_a as account_id, max_by(av, n) as available, max_by(rs, n) as reserved from st
          where log_position <= (select (max(event_id) + 1) // 2 from events) group by all having max_by(av, n) is not null""",
        "snapshot_sections": f"""{GROUPS} select * from (values ('asset_supply', 1::bigint)) t(section, n) union all select 'balances', count(*) from mbalances union all select 'allowances', count(*) from mallowances
          union all select 'command_dedup', count(distinct (user_id, s & 1023)) from (select user_id, row_number() over (partition by user_id order by event_id) - 1 as s from events) union all select 'batch_dedup', 0""",
        "snapshot_checksum": f"{FRESH} select cast(sum(available + reserved) as bigint) as checksum from {LAST}",
        "snapshot_resume_equal": f"{FRESH} select true as equal, count(*) as accounts, cast(sum(available + reserved) as bigint) as held from {LAST}",
        "advance_only_snapshot": "select max(event_id + 1) as log_position from events where event_id % 1000 = 0 and event_id % 3000 <> 0 and event_id + 1 > 2500 having count(*) > 0",
        "retry_policy_write": f"""with {GRID} select flag, now, retries, max_retries, case when not flag or not (retries = 3 or now - 30 >= 0) then 'WAIT' when max_retries > 0 and retries >= max_retries then 'EXPIRE' else 'RETRY' end as action from grid""",
        "retry_policy_read": f"""with {GRID} select flag, now, retries, max_retries, case when not flag or now - 30 < 0 then 'WAIT' when now - 5 > 45 or (max_retries > 0 and retries >= max_retries) then 'EXPIRE' else 'RETRY' end as action from grid""",
        "latency_percentiles": "select quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.99) as p99, quantile_cont(value, 0.999) as p999, max(value) as max from events",
        "graph_out_edges": f"with {EDGES} select asset_id, owner_id as src, delegate_id as dst, allowance as amount from edges",
        "graph_in_edges": f"with {EDGES} select asset_id, delegate_id as src, owner_id as dst, allowance as amount from edges",
        "graph_any_edges": f"""with {EDGES}, ends as (select asset_id, owner_id as src, delegate_id as dst, allowance from edges union all select asset_id, delegate_id, owner_id, allowance from edges)
          select asset_id, src, count(*) as edges, count(distinct dst) as neighbours, cast(sum(allowance) as bigint) as amount from ends group by asset_id, src""",
        "graph_two_hop": f"""with {EDGES} select x.asset_id, x.owner_id as a, x.delegate_id as b, y.delegate_id as c, x.allowance as x_amount, y.allowance as y_amount from edges x join edges y on x.delegate_id = y.owner_id and x.asset_id = y.asset_id
          where x.allowance >= 5000 and y.allowance < 2000 and x.owner_id <> y.delegate_id""",
        "graph_optional_match": f"{GRAPH} select nodes.asset_id, account_id as a, available as a_balance, delegate_id as b, allowance as x_amount from nodes left join edges on edges.asset_id = nodes.asset_id and owner_id = account_id where available > 0",
        "graph_not_exists": f"{GRAPH} select asset_id, account_id as a, available as a_balance from nodes where not exists (select 1 from edges where edges.asset_id = nodes.asset_id and delegate_id = account_id)",
        "graph_exists_or_not": f"{GRAPH} select asset_id, account_id as a, available as a_balance, reserved as a_reserved from nodes where (available <= 20000 or reserved = 0) and account_id <> 7 and available <> 1 and exists (select 1 from edges where edges.asset_id = nodes.asset_id and delegate_id = account_id)",
        "graph_bound_target": f"with {EDGES} select x.asset_id, x.owner_id as a, x.delegate_id as b, x.allowance as x_amount, y.allowance as y_amount from edges x join edges y on x.asset_id = y.asset_id and x.delegate_id = y.owner_id and y.delegate_id = x.owner_id where x.owner_id < x.delegate_id",
        "graph_aggregate_topk": f"""with {EDGES} select asset_id, delegate_id as b, count(distinct owner_id) as owners, cast(sum(allowance) as bigint) as total, min(allowance) as least, max(allowance) as most, count(*) as edges
          from edges group by asset_id, b order by total desc, asset_id, b limit 10 offset 2""",
        "graph_var_length": f"""with recursive {EDGES}, {reach("edges", "select distinct asset_id, owner_id as seed from edges", 3)}
          select asset_id, seed as a, node as b, hop as b_hop from near where hop >= 2""",
        "risk_trace_allowance": f"""with recursive {EDGES}, {reach("edges", "select distinct asset_id, owner_id as seed from edges", 4)}
          select asset_id, seed, node, hop, case hop when 1 then 'CRITICAL' when 2 then 'HIGH' when 3 then 'MEDIUM' else 'LOW' end as risk from near where node <> seed""",
        "risk_reachability": f"""with recursive {EDGES}, {reach("edges", "select distinct asset_id, owner_id as seed from edges", 3)},
          pairs as (select distinct asset_id, owner_id as from_id, (owner_id * 7 + 3) % (select max(owner_id) + 1 from edges) as to_id from edges)
          select p.asset_id, from_id, to_id, hop is not null as reachable from pairs p left join near on near.asset_id = p.asset_id and seed = from_id and node = to_id""",
        "risk_delegation_cycles": f"""with recursive {EDGES}, {reach("edges", "select distinct asset_id, owner_id as seed from edges", 4)} select asset_id, seed as account_id, hop as length from near where node = seed""",
        "risk_hotspots": f"with {EDGES} select asset_id, delegate_id, count(distinct owner_id) as fan_in from edges group by all order by fan_in desc, asset_id, delegate_id limit 10",
        "risk_dormant_allowances": f"{GRAPH} select edges.asset_id, owner_id, delegate_id, allowance from edges left join nodes on nodes.asset_id = edges.asset_id and account_id = owner_id where coalesce(available, 0) = 0",
        "risk_concentration": f"""{GRAPH}, supply as (select asset_id, sum(available + reserved) as total from nodes group by asset_id)
          select nodes.asset_id, account_id, available from nodes join supply using (asset_id) where total > 0 and available * 100 >= total * 1""",
        "transfer_velocity": f"{GROUPS}, {TRANSFERS} select cast(0 as bigint) as asset_id, from_account, log_position // 1000 as slot, count(*) as transfers, cast(sum(amount) as bigint) as volume from mmoves group by all",
        "transfer_fanout": f"{GROUPS}, {TRANSFERS} select cast(0 as bigint) as asset_id, from_account, count(distinct to_account) as recipients, max(log_position) as last_position from mmoves group by all",
        "transfer_recent": f"{GROUPS}, {TRANSFERS} select log_position, from_account, to_account, amount from mmoves order by log_position desc limit 50",
    }
