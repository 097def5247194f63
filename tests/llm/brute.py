"""Plain Python versions of what the operators must return, and a small awkward corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hits string, label long, slot string, node string, curve string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(rng.choice((30, vocabulary, 9000)))}" for _ in range(n)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def corpus(seed=1, n=120):
    """Rows of DOCS: ordinary texts, copies, near copies, junk, personal data, empties, nulls, very long ones, a repeated row."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text = prose(rng, rng.choice([3, 8, 40, 120, 300]))
        if i % 9 == 1 and out:
            text = rng.choice(out)[1]
        if i % 7 == 2 and out and out[-1][1]:
            words = out[-1][1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        if i % 11 == 3:
            text = " ".join(f"{w}%%%" for w in (text or "x").split())
        if i % 13 == 4:
            text = f"{text}\nmail a.b@c-d.org, +49 30 123456, 10.0.0.256 or 10.0.0.25, 4111 1111 1111 1111 and 4111 1111 1111 1112"
        if i % 17 == 5:
            text = "same line\n" * 9
        out.append((i, text))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "é" * 3000 + " " + prose(rng, 6000)), (1004, "x" * 50_000), (1005, "ÀÉ ß 日本 🙂 <|endoftext|> <s>[INST]"), (None, "a row without an id"), (None, None)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", None]), len(t or ""), "clash", 7, "clash", "clash", "clash") for i, t in out]
    return rows + [rows[0], rows[0]]


def quality_base(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def benchmark_hits(docs, items):
    windows = {}
    for item, text in items:
        words = LETTER_WORD.findall(lower(text))
        size = min(10, len(words))
        for j in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[j : j + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = LETTER_WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for j in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[j : j + size]))
                if items_here:
                    hit |= set(range(j, j + size))
                    found |= items_here
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingle_set(text):
    words = SPACE_WORD.findall(lower(text))
    return frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()


def components(docs):
    """{doc_id: (set size, smallest reachable id)}."""
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_only = lambda m: re.sub("[^0-9]", "", m)
PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_only(m)) <= 19 and luhn(_only(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_only(m)) <= 15),
]


def pii_base(text):
    counts, spans = [], []
    for kind, pattern, valid in PII:
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if valid(m[0])]
        counts.append(len(own))
        spans += own
    return counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


def unigram(docs):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = [(i, SPACE_WORD.findall(lower(t)) + [" "]) for i, t in docs]
    count = Counter(w for i, own in words if not fold(i) for w in own)
    total, kinds = sum(count.values()), len(count)
    score = lambda own: sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
    return [(i, fold(i), len(own), sum(count[w] > 0 for w in own), total, score(own)) for i, own in words]
