"""Spelling variants against brute force: the scan, the split of crowded lists, whole tables, and the awkward cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from noonday.llm import spelling
from tests.llm import helpers as H


def truth(rows):
    """(word, n, form, form_n, root, n_near) of each word."""
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = H.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    left, near = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :], i].add(w)
    for (rest, _), found in left.items():
        for a in found:
            near[a] |= found - {a}
            if rest in count:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, form[w], count.get(form[w]), root(w), len(near[w])) for w, n in count.items())


def result(frame, **settings):
    return sorted(tuple(r) for r in spelling.variants(frame, **settings).select("word", "n", "form", "form_n", "root", "n_near").collect())


def test_scan():
    draw = random.Random(1)
    for t in range(300):
        shared = "" if t % 3 else "xyq"
        words = sorted({shared + "".join(draw.choice("ab" if t % 2 else "abcdé") for _ in range(draw.randint(0, 7))) for _ in range(40)})
        assert sorted(spelling.scan(words, len(shared))) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if H.edits(words[i], words[j]) == 1]


def variant_rows():
    """A chain of three forms, ties between forms, letters that are no letters, words that share long prefixes and suffixes."""
    draw, rows = random.Random(4), []
    chain = ["wonderful " * 1200, "wonderfuls " * 100, "wonderfulsy " * 9, "wonderfulsyx "]
    rows += [(900, " ".join(chain), "a"), (901, "ÉCOLIERS écoliers Écoliers ÷÷÷÷÷÷÷÷ ××××××××", "a"), (902, "abcdefg " * 20 + "abcdefx " * 20 + "abcdefy " * 2, "a")]
    rows += [(902, "abcdefg " * 20, "b"), (902, "abcdefg " * 20, "b"), (None, "abcdefg nulltext nulltext", None), (903, "Z" * 30_000 + " " + "z" * 30_000, "a")]
    for k in range(60):
        stem = "".join(draw.choice("abc") for _ in range(5))
        rows.append((1000 + k, " ".join(draw.choice(["internationally", "", "tion"]) + stem + draw.choice(["", "tionally", "x"]) for _ in range(60)), "c"))
    return rows


@pytest.mark.parametrize("most", [2048, 5])
def test_variants(spark, most):
    rows = H.awkward() + variant_rows()
    want = truth(rows)
    assert result(H.make_docs(spark, rows).repartition(3), most=most) == want
    by_word = {w[0]: w for w in want}
    assert by_word["wonderfulsy"][2] == "wonderfuls" and by_word["wonderfulsy"][4] == "wonderful"
    assert by_word["abcdefy"][2] == "abcdefg" and len(want) > 100


def test_crowded_lists_are_split(spark):
    """A third of the vocabulary shares its first letters; no list stays long, and every pair is given once."""
    draw = random.Random(9)
    words = {"commonprefix" + "".join(draw.choice("abcd") for _ in range(draw.randint(3, 7))) for _ in range(700)}
    words |= {"".join(draw.choice("abcdefgh") for _ in range(draw.randint(7, 12))) for _ in range(1400)}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = Counter(r["list"] for r in spelling.lists(table, 50).collect())
    open_ = {r["list"]: len(r["word"]) - r["head"] - r["tail"] for r in spelling.lists(table, 50).collect()}
    assert all(n <= 50 or open_[k] <= 3 for k, n in sizes.items())
    got = [(r["word"], r["near"]) for r in spelling.near_pairs(table, 50).collect()]
    assert len(got) == len(set(got))
    ordered = sorted(words)
    assert {(a, b) for a, b in got if a < b} == {(ordered[i], ordered[j]) for i, j in spelling.scan(ordered, 0)}


def test_nothing(spark):
    empty = H.make_docs(spark, [(1, None, "a")]).where("false")
    assert result(empty) == [] and result(H.make_docs(spark, [(1, None, None), (2, "", None)])) == []
