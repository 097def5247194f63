"""A sequential model of the ledger, written apart from the engine: one pass over the log, plain rings, whole-state copies for rollback."""

import copy

MAX = 2**63 - 1


class Model:
    def __init__(self, window=1024, batch_window=1024, max_batch=1024):
        self.av, self.rs, self.al, self.supply = {}, {}, {}, {}
        self.rings, self.batch_rings = {}, {}
        self.window, self.batch_window, self.max_batch = window, batch_window, max_batch
        self.results, self.legs, self.events, self.evicted = [], [], [], 0

    def _slot(self, rings, window, client, seq):
        return rings.setdefault(client, [None] * window), seq & (window - 1)

    def command(self, pos, client, seq, kind, a, b, c, amount, asset):
        asset = asset or 0
        ring, i = self._slot(self.rings, self.window, client, seq)
        if seq != -1 and ring[i] and ring[i][0] == seq:
            self.results.append((pos, True, False, *ring[i][1]))
            return
        evicted = bool(ring[i]) and ring[i][0] not in (-1, seq)
        out, ev = self.apply(kind, asset, a, b, c, amount)
        ring[i] = (seq, out)
        self.results.append((pos, False, evicted, *out))
        if out[0] != "SUCCESS":
            ev = [("COMMAND_REJECTED", asset, a, out[0])]
        self.events += [(pos, k, *e) for k, e in enumerate(ev)]

    def apply(self, kind, s, a, b, c, amt):
        fail = lambda x: ((x, None, None, None), [])
        if kind is None or amt is None or amt < 0:
            return fail("INVALID_AMOUNT")
        A, B, C = (s, a), (s, b), (s, c)
        if kind == "CREDIT":
            if self.av.get(A, 0) + amt > MAX:
                return fail("OVERFLOW")
            self.av[A] = self.av.get(A, 0) + amt
            self.supply[s] = self.supply.get(s, 0) + amt
            return ("SUCCESS", self.av[A], None, None), [("BALANCE_CHANGED", s, a, self.av[A], amt)]
        if kind in ("APPROVE", "INCREASE_ALLOWANCE", "DECREASE_ALLOWANCE"):
            now = self.al.get((s, a, b), 0)
            new = {"APPROVE": amt, "INCREASE_ALLOWANCE": now + amt, "DECREASE_ALLOWANCE": now - amt}[kind]
            if new < 0:
                return fail("INSUFFICIENT_ALLOWANCE")
            if new > MAX:
                return fail("OVERFLOW")
            self.al[s, a, b] = new
            return ("SUCCESS", None, new, None), [("ALLOWANCE_CHANGED", s, a, b, new)]
        if kind == "DELEGATED_TRANSFER":
            left = self.al.get((s, b, a), 0) - amt
            if left < 0:
                return fail("INSUFFICIENT_ALLOWANCE")
            if B not in self.av:
                return fail("INVALID_ACCOUNT")
            if self.av[B] < amt:
                return fail("INSUFFICIENT_BALANCE")
            ev = []
            if b != c:
                if self.av.get(C, 0) + amt > MAX:
                    return fail("OVERFLOW")
                self.av[B] -= amt
                self.av[C] = self.av.get(C, 0) + amt
                ev = [("BALANCE_CHANGED", s, b, self.av[B], -amt), ("BALANCE_CHANGED", s, c, self.av[C], amt), ("TRANSFER", s, b, c, amt)]
            self.al[s, b, a] = left
            return ("SUCCESS", self.av[B], left, None), [*ev, ("ALLOWANCE_CHANGED", s, b, a, left)]
        if A not in self.av:
            return fail("INVALID_ACCOUNT")
        if kind in ("RELEASE", "CAPTURE"):
            if self.rs.get(A, 0) < amt:
                return fail("INSUFFICIENT_RESERVED")
            to = A if kind == "RELEASE" else B
            if self.av.get(to, 0) + amt > MAX:
                return fail("OVERFLOW")
            self.rs[A] = self.rs.get(A, 0) - amt
            self.av[to] = self.av.get(to, 0) + amt
            ev = [("RELEASED" if kind == "RELEASE" else "CAPTURED", s, a, self.av[A], self.rs[A])]
            if to != A:
                ev += [("BALANCE_CHANGED", s, b, self.av[B], amt), ("TRANSFER", s, a, b, amt)]
            return ("SUCCESS", self.av[A], None, self.rs[A]), ev
        if self.av[A] < amt:
            return fail("INSUFFICIENT_BALANCE")
        if kind == "RESERVE":
            if self.rs.get(A, 0) + amt > MAX:
                return fail("OVERFLOW")
            self.av[A] -= amt
            self.rs[A] = self.rs.get(A, 0) + amt
            return ("SUCCESS", self.av[A], None, self.rs[A]), [("RESERVED", s, a, self.av[A], self.rs[A])]
        if kind == "DEBIT":
            self.av[A] -= amt
            self.supply[s] = self.supply.get(s, 0) - amt
            return ("SUCCESS", self.av[A], None, None), [("BALANCE_CHANGED", s, a, self.av[A], -amt)]
        if a == b:
            return ("SUCCESS", self.av[A], None, None), []
        if self.av.get(B, 0) + amt > MAX:
            return fail("OVERFLOW")
        self.av[A] -= amt
        self.av[B] = self.av.get(B, 0) + amt
        return ("SUCCESS", self.av[A], None, None), [("BALANCE_CHANGED", s, a, self.av[A], -amt), ("BALANCE_CHANGED", s, b, self.av[B], amt), ("TRANSFER", s, a, b, amt)]

    def batch(self, pos, client, seq, legs):
        """legs: (from, to, amount, asset, linked)."""
        ring, i = self._slot(self.batch_rings, self.batch_window, client, seq)
        if seq != -1 and ring[i] and ring[i][0] == seq:
            self.legs += [(pos, k, True, *r) for k, r in enumerate(ring[i][1])]
            return
        if len(legs) > self.max_batch:
            out, ev = [("INVALID_CHAIN", None)] * self.max_batch, None
        elif legs and legs[-1][4]:
            out, ev = [("INVALID_CHAIN", None)] * len(legs), None
        else:
            out, ev, k = [], [], 0
            while k < len(legs):
                end = k
                while legs[end][4]:
                    end += 1
                saved, rows, own = (copy.copy(self.av), copy.copy(self.supply)), [], []
                for f, t, amt, s, _ in legs[k : end + 1]:
                    r, e = self.apply("TRANSFER", s, f, t, None, amt)
                    if r[0] != "SUCCESS":
                        self.av, self.supply = saved
                        rows, own = [(r[0], None)] * (end + 1 - k), [("COMMAND_REJECTED", legs[j][3], legs[j][0], r[0]) for j in range(k, end + 1)]
                        break
                    rows.append((r[0], r[1]))
                    own += e
                out += rows
                ev += own
                k = end + 1
        if ev is None:
            ev = [("COMMAND_REJECTED", legs[j][3], legs[j][0], "INVALID_CHAIN") for j in range(len(out))]
        ring[i] = (seq, out)
        self.legs += [(pos, k, False, *r) for k, r in enumerate(out)]
        self.events += [(pos, k, *e) for k, e in enumerate(ev)]
