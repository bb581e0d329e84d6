"""Rows without an id whose texts collide in a short hash are still told apart."""

import xxhash

from noonday.llm import substring_dedup
from tests.llm import helpers as H


def test_colliding_texts_without_id(spark):
    made = lambda i: " ".join(f"q{i}x{j}" for j in range(50))
    one, other = made(73874), made(125153)
    assert xxhash.xxh32_intdigest(one.encode()) == xxhash.xxh32_intdigest(other.encode()) and one != other
    third = " ".join([*one.split()[:40], *H.words(30, 1)])
    rows = [(None, one, "a"), (None, other, "a"), (7, third, "b")]
    found = substring_dedup.kept_words(H.make_docs(spark, rows), 35)
    truth = H.without_repeats([t for _, t, _ in rows], 35)
    assert sorted(r.n_removed for r in found.collect()) == sorted(n for _, n, _ in truth) == [0, 40, 40]


def test_many_rows_without_id(spark):
    passage = " ".join(H.words(45, 3, 10_000))
    texts = [" ".join(H.words(60 + i % 7, 100 + i, 50_000)) for i in range(200)]
    texts = [f"{t} {passage}" if i % 20 == 0 else t for i, t in enumerate(texts)] + [None, ""]
    found = substring_dedup.kept_words(H.make_docs(spark, [(None, t, "a") for t in texts]), 35)
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())
    assert got == sorted(H.without_repeats(texts, 35))
