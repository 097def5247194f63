"""The ordered fold: what each operation does to balances, holds and allowances.

``Book`` holds the state of the keys of one partition. Operations arrive in log order,
batch legs in leg order. Every rule is one method that checks first and then writes
through ``_put``, which notes the old value while a chain is open, so that a failed chain
is undone by restoring the notes in reverse. Amounts are 64-bit: Python integers don't
wrap, so sums are compared with the largest long. Unlike plain 64-bit addition, holds are
checked for overflow too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

MAX = (1 << 63) - 1
LOAD_BALANCE, LOAD_ALLOWANCE, LEG = "LOAD_BALANCE", "LOAD_ALLOWANCE", "LEG"

OPS = "log_position bigint, leg_idx int, chain_id int, chain_last boolean, op string, asset_id bigint, a bigint, b bigint, c bigint, amount bigint, sink boolean"
_EVENT = ("kind", "asset_id", "account_id", "new_balance", "delta", "cause", "new_available", "new_reserved", "from_account", "to_account", "amount", "owner_id", "delegate_id", "new_allowance")
EVENT_NAMES = _EVENT
EVENT_STRUCT = "struct<kind:string,asset_id:bigint,account_id:bigint,new_balance:bigint,delta:bigint,cause:string,new_available:bigint,new_reserved:bigint,from_account:bigint,to_account:bigint,amount:bigint,owner_id:bigint,delegate_id:bigint,new_allowance:bigint>"
RESULTS = f"log_position bigint, leg_idx int, op string, status string, result_balance bigint, result_allowance bigint, result_reserved bigint, events array<{EVENT_STRUCT}>"

_TYPES = [pa.string() if k in ("kind", "cause") else pa.int64() for k in _EVENT]


class Rejected(Exception):
    """A rule failed; nothing was written."""


def balance_event(asset, account, new, delta, cause):
    return ("BALANCE_CHANGED", asset, account, new, delta, cause, None, None, None, None, None, None, None, None)


def hold_event(kind, asset, account, available, reserved):
    return (kind, asset, account, None, None, None, available, reserved, None, None, None, None, None, None)


def transfer_event(asset, source, target, amount):
    return ("TRANSFER", asset, None, None, None, None, None, None, source, target, amount, None, None, None)


def allowance_event(asset, owner, delegate, new):
    return ("ALLOWANCE_CHANGED", asset, None, None, None, None, None, None, None, None, None, owner, delegate, new)


class Book:
    """Balances, holds and allowances by key, and the rules that change them."""

    def __init__(self):
        self.available: dict = {}
        self.reserved: dict = {}
        self.allowed: dict = {}
        self.notes: list | None = None
        self.blind = False  # whether the operation pays into an account whose balance is summed up afterwards
        self.rules = {
            "CREDIT": self.credit, "DEBIT": self.debit, "TRANSFER": self.transfer, LEG: self.transfer, "APPROVE": self.approve,
            "INCREASE_ALLOWANCE": self.increase, "DECREASE_ALLOWANCE": self.decrease, "DELEGATED_TRANSFER": self.delegated,
            "RESERVE": self.reserve, "RELEASE": self.release, "CAPTURE": self.capture,
        }

    def _put(self, table: dict, key, value) -> None:
        if self.notes is not None:
            self.notes.append((table, key, table.get(key)))
        table[key] = value

    def _funds(self, key, amount: int) -> int:
        have = self.available.get(key)
        if have is None:
            raise Rejected("INVALID_ACCOUNT")
        if have < amount:
            raise Rejected("INSUFFICIENT_BALANCE")
        return have

    def _held(self, key, amount: int) -> tuple[int, int]:
        have = self.available.get(key)
        if have is None:
            raise Rejected("INVALID_ACCOUNT")
        held = self.reserved.get(key, 0)
        if held < amount:
            raise Rejected("INSUFFICIENT_RESERVED")
        return have, held

    @staticmethod
    def _sum(a: int, b: int) -> int:
        if a + b > MAX:
            raise Rejected("OVERFLOW")
        return a + b

    def _received(self, key, amount: int) -> int | None:
        """The balance after a payment; unknown here where it is summed up afterwards."""
        return None if self.blind else self._sum(self.available.get(key, 0), amount)

    # each rule returns (balance, allowance, reserved, events)
    def credit(self, asset, a, b, c, amount):
        new = self._sum(self.available.get((asset, a), 0), amount)
        self._put(self.available, (asset, a), new)
        return new, None, None, [balance_event(asset, a, new, amount, "CREDIT")]

    def debit(self, asset, a, b, c, amount):
        new = self._funds((asset, a), amount) - amount
        self._put(self.available, (asset, a), new)
        return new, None, None, [balance_event(asset, a, new, -amount, "DEBIT")]

    def _move(self, asset, source, target, amount, causes):
        """Funds from one account to another, which is created if need be."""
        have = self._funds((asset, source), amount)
        new = self._received((asset, target), amount)
        self._put(self.available, (asset, source), have - amount)
        if new is not None:
            self._put(self.available, (asset, target), new)
        return have - amount, [balance_event(asset, source, have - amount, -amount, causes[0]), balance_event(asset, target, new, amount, causes[1]), transfer_event(asset, source, target, amount)]

    def transfer(self, asset, a, b, c, amount):
        if a == b:
            return self._funds((asset, a), amount), None, None, []
        left, events = self._move(asset, a, b, amount, ("TRANSFER_DEBIT", "TRANSFER_CREDIT"))
        return left, None, None, events

    def _allow(self, asset, owner, delegate, value):
        self._put(self.allowed, (asset, owner, delegate), value)
        return None, value, None, [allowance_event(asset, owner, delegate, value)]

    def approve(self, asset, a, b, c, amount):
        return self._allow(asset, a, b, amount)

    def increase(self, asset, a, b, c, amount):
        return self._allow(asset, a, b, self._sum(self.allowed.get((asset, a, b), 0), amount))

    def _spare(self, asset, owner, delegate, amount) -> int:
        rest = self.allowed.get((asset, owner, delegate), 0) - amount
        if rest < 0:
            raise Rejected("INSUFFICIENT_ALLOWANCE")
        return rest

    def decrease(self, asset, a, b, c, amount):
        return self._allow(asset, a, b, self._spare(asset, a, b, amount))

    def delegated(self, asset, a, b, c, amount):
        """``a`` spends what ``b`` allowed it, in favour of ``c``."""
        rest = self._spare(asset, b, a, amount)
        if b == c:
            left, events = self._funds((asset, b), amount), []
        else:
            left, events = self._move(asset, b, c, amount, ("DELEGATED_DEBIT", "DELEGATED_CREDIT"))
        _, _, _, more = self._allow(asset, b, a, rest)
        return left, rest, None, events + more

    def _hold(self, kind, asset, account, available, reserved):
        self._put(self.available, (asset, account), available)
        self._put(self.reserved, (asset, account), reserved)
        return available, None, reserved, [hold_event(kind, asset, account, available, reserved)]

    def reserve(self, asset, a, b, c, amount):
        have = self._funds((asset, a), amount)
        return self._hold("RESERVED", asset, a, have - amount, self._sum(self.reserved.get((asset, a), 0), amount))

    def release(self, asset, a, b, c, amount):
        have, held = self._held((asset, a), amount)
        return self._hold("RELEASED", asset, a, self._sum(have, amount), held - amount)

    def capture(self, asset, a, b, c, amount):
        have, held = self._held((asset, a), amount)
        if a == b:
            return self._hold("CAPTURED", asset, a, self._sum(have, amount), held - amount)
        new = self._received((asset, b), amount)
        self._put(self.reserved, (asset, a), held - amount)
        if new is not None:
            self._put(self.available, (asset, b), new)
        events = [hold_event("CAPTURED", asset, a, have, held - amount), balance_event(asset, b, new, amount, "TRANSFER_CREDIT"), transfer_event(asset, a, b, amount)]
        return have, None, held - amount, events

    def apply(self, op, asset, a, b, c, amount):
        """(status, balance, allowance, reserved, events) of one operation."""
        if amount < 0:
            return "INVALID_AMOUNT", None, None, None, []
        try:
            return "SUCCESS", *self.rules[op](asset, a, b, c, amount)
        except Rejected as e:
            return str(e), None, None, None, []

    def undo(self) -> None:
        for table, key, old in reversed(self.notes or ()):
            if old is None:
                table.pop(key, None)
            else:
                table[key] = old
        self.notes = None


class Folder:
    """Feeds operations to a book, chain by chain, and yields finished result rows."""

    def __init__(self):
        self.book, self.chain, self.failed = Book(), [], None

    def feed(self, position, leg, last, op, asset, a, b, c, amount, sink=False) -> list[tuple]:
        book = self.book
        book.blind = sink
        if op == LOAD_BALANCE:
            book.available[asset, a], book.reserved[asset, a] = amount, b or 0
            return []
        if op == LOAD_ALLOWANCE:
            book.allowed[asset, a, b] = amount
            return []
        if op != LEG:
            return [(position, leg, op, *book.apply(op, asset, a, b, c, amount))]
        if not self.chain:
            self.failed, book.notes = None, []
        row = (self.failed, None, None, None, []) if self.failed else book.apply(op, asset, a, b, c, amount)
        if row[0] != "SUCCESS" and not self.failed:
            self.failed = row[0]
            book.undo()
        self.chain.append((position, leg, op, *row))
        if not last:
            return []
        book.notes, out, self.chain = None, self.chain, []
        return [(p, i, o, self.failed, None, None, None, []) for p, i, o, *_ in out] if self.failed else out


def result_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 8
    events = [e for own in columns[7] for e in own]
    fields = list(zip(*events)) if events else [[]] * len(_EVENT)
    offsets, total = [0], 0
    for own in columns[7]:
        total += len(own)
        offsets.append(total)
    struct = pa.StructArray.from_arrays([pa.array(f, t) for f, t in zip(fields, _TYPES)], names=list(_EVENT))
    arrays = [pa.array(c, t) for c, t in zip(columns[:7], (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], names=["log_position", "leg_idx", "op", "status", "result_balance", "result_allowance", "result_reserved", "events"])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the operations of one partition, sorted by (log_position, leg_idx); ``mapInArrow`` function."""
    folder = Folder()
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch[c].to_pylist() for c in ("log_position", "leg_idx", "chain_last", "op", "asset_id", "a", "b", "c", "amount", "sink"))):
            out += folder.feed(*row)
        yield result_batch(out)
