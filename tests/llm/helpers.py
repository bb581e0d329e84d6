"""Tables with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

import xxhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, uid string, size string, row string, key string, "
    "kind string, shard string, slot string, bucket int, fp string, n int, target string, queue string, seq string, number string, id string"
)


def make_docs(spark, rows):
    """Rows of (doc_id, text, source), with further columns whose names the operators use inside."""
    clash = ["x"] * 7 + [3, "x", 4, "x", "x", "x", "x", "x"]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *clash) for i, t, s in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}é" if draw.random() < 0.1 else f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def awkward():
    """NULLs in every column, empty and blank texts, ties, repeated rows, shared passages, and a very long text."""
    passage = " ".join(words(60, 1))
    base = " ".join(words(300, 2))
    near = base.replace(base.split()[150], "changed", 1)
    rows = [
        (None, "No id here.", "b"), (None, None, None), (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (4, "One", "a"), (5, "oNE", None),
        (6, "Repeated row\nRepeated row", "b"), (6, "Repeated row\nRepeated row", "b"), (7, "ÉCOLE école", "b"), (8, "École école", "b"),
        (9, f"{' '.join(words(50, 3))}\n{passage}\n{' '.join(words(20, 4))}", "c"), (10, f"{' '.join(words(11, 5))} {passage}", "c"),
        (11, base, "c"), (12, base.upper(), "c"), (13, near, "c"), (14, "same " * 90, "a"), (15, "ab ab ab " * 30, "a"),
        (16, " ".join(words(20_000, 6, 50_000)), "c"), (17, "😀 " * 40, "\U0001f600"), (18, "x" * 5_000, "ﬀ"),
    ]
    rows += [(100 + i, base, "c") for i in range(40)]
    rows += [(200 + i, " ".join(words(40 + i, 100 + i)), f"s{i % 4}") for i in range(30)]
    return rows


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, each=3):
    w = split(lower(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + each]) for i in range(max(1, len(w) - each + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    """Least index reachable from each index."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def without_repeats(texts, window):
    """(words, removed, sha256 of the rest) of each text."""
    split_texts = [split(t) for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split_texts for i in range(len(w) - window + 1))
    out = []
    for w in split_texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    forms = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for kind, form in forms:
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def ordered(value):
    """A sort key with NULL first."""
    return (value is not None, value if value is not None else 0)
