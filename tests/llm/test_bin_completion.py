"""Best-fit packing: ids against the tokenizer, solutions against the optimum, whole tables against the law."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noonday.llm import bin_completion as B
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_the_tokenizers(tokenizer):
    draw = random.Random(3)
    texts = [
        None, "", " \n\t ", "don't we'll 'S it'RE x've ''s", "École ÀÉÎ ßẞ × ÷ 3×4", "²½ ⅷ 中文 字 १२३ ab1２c", "á b\x1c c\x85d \xa0é f ́x", "ΑΣ ΣΑΣ İi",
        "<|endoftext|> a<|startoftext|>b <|endoftext|", "😀👍🏽 ẹ́", "a​x\x00 z﻿ \x01 \x7f", "w" * 5000, "</w> a</w>b", *(t for _, t, _ in H.awkward() if t and len(t) < 50_000),
    ]
    texts += ["".join(draw.choice("aB'sté \n\t́\x1f<|>9_-中À×") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    want = [[*x.ids, B.END] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    assert [x.tolist() for part in B._few(batch) for x in B.encoder()(part.column("text"))] == want


def optimum(lengths, room):
    best = [(0, 0)] + [(99, 0)] * (2 ** len(lengths) - 1)  # full sequences and what the last one holds, for each set of pieces
    best[0] = (1, 0)
    for m in range(1, len(best)):
        for i, x in enumerate(lengths):
            if m >> i & 1:
                k, used = best[m ^ (1 << i)]
                best[m] = min(best[m], (k, used + x) if used + x <= room else (k + 1, x))
    return best[-1][0]


def test_small_sets_are_packed_best():
    draw, better = random.Random(2), 0
    for t in range(150):
        room = draw.choice([20, 50, 100])
        lengths = [draw.randint(draw.choice([1, room // 5]), room if t % 3 else room // 2) for _ in range(draw.randint(1, 10))]
        got, best = B.complete(lengths, room), optimum(lengths, room)
        assert sorted(x for g in got for x in g) == sorted(lengths) and all(sum(g) <= room for g in got)
        assert B.lower_bound(lengths, room) <= best == len(got)
        better += len(B.best_fit(lengths, room)) > best
    lengths = [60, 50, 30, 20, 20, 20]  # best fit needs three sequences
    assert len(B.best_fit(lengths, 100)) == 3 and len(B.complete(lengths, 100)) == 2


def test_dominance():
    assert B.dominates((5,), (3, 2)) and B.dominates((5, 4), (4, 4, 1)) and not B.dominates((3, 2), (5,)) and not B.dominates((4, 4), (5,))
    stock = B.Stock([7, 5, 4, 3, 2])
    assert stock.fillings(7, 7) == [(7,)] and set(stock.fillings(8, 0)) <= {(5, 3), (4, 2, 2), (5, 2)} and (5, 3) in stock.fillings(8, 0)


def check_law(found, texts, tokenizer, length):
    """Every id in exactly one piece, only long documents cut, sequences without gaps; gives the number of sequences."""
    want = sorted(
        (H.ordered(i), k, start, len(ids[start : start + length]), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))
        for i, t in texts
        for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, B.END]]
        for k, start in enumerate(range(0, len(ids), length))
    )
    assert sorted((H.ordered(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= length
    return len(by)


@pytest.mark.parametrize(("length", "block"), [(4096, 4096), (64, 50)])
def test_pack(spark, tokenizer, length, block):
    rows = H.awkward()
    docs = H.make_docs(spark, rows).repartition(3)
    packed = B.pack(docs, length=length, block=block).cache()
    found = packed.collect()
    used = check_law(found, [(i, t) for i, t, _ in rows], tokenizer, length)
    least = B.lower_bound([r.length for r in found], length)
    assert used <= least * 1.05 + 1
    ids = {(r.doc_id, r.piece): r.ids for r in found}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found) and ids[2, 0] == [B.END]
    whole = B.sequences(packed).collect()
    assert sorted(x for r in whole for x in r.input_ids) == sorted(x for r in found for x in r.ids)


def test_blocks_lose_little(spark, tokenizer):
    """Many blocks, repacked once, against one block of all; over a third of all documents have about one length."""
    draw = random.Random(8)
    texts = [(i, " ".join(H.words(draw.choice([30, draw.randint(1, 120)]), i))) for i in range(1200)]
    found = B.pack(H.make_docs(spark, [(i, t, "a") for i, t in texts]), length=256, block=150, with_ids=False).collect()
    used = check_law(found, texts, tokenizer, 256)
    lengths = [r.length for r in found]
    assert used <= len(B.complete(lengths, 256)) + 4 and used <= len(B.best_fit(lengths, 256)) + 4


def test_nothing(spark):
    docs = H.make_docs(spark, [(1, None, None)])
    assert B.pack(docs.where("false")).count() == 0
    assert [(r.length, r.offset) for r in B.pack(docs.where(F.lit(True))).collect()] == [(1, 0)]
