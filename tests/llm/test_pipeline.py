"""The registered queries' shapes, and the pipeline's stages against a brute-force version."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from noonday.llm import quality
from noonday.llm.queries import QUERIES
from tests.llm import helpers as H

SHAPES = {
    2: "doc_id bigint n_email bigint n_ip bigint n_card bigint n_phone bigint base_sha256 string spans string",
    3: "doc_id bigint fingerprint string component_id bigint",
    4: "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
    5: "doc_id bigint n_words bigint n_removed bigint kept_sha256 string",
    6: "doc_id bigint held_out boolean score double predicted int",
    7: "doc_id bigint start bigint length bigint ids_crc32 bigint doc_tokens bigint sequence_id bigint offset bigint",
    8: "doc_id bigint size bigint source_size bigint target double taken bigint",
    9: "doc_id bigint keep_id bigint group_size bigint kept boolean text_sha256 string",
    10: "query_id bigint rank int vec_id bigint score double",
    11: "word string n bigint form string form_n bigint root string n_near bigint",
    12: "anchor_id bigint positive_id bigint rank int negative_id bigint positive_score bigint negative_score bigint",
    13: "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
}


@pytest.mark.parametrize("name", QUERIES)
def test_shape(spark, name):
    number = int(name[2:].split("_")[0])
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    if number in SHAPES:
        assert " ".join(f"{c} {t}" for c, t in found.dtypes) == SHAPES[number]
    assert found.count() > 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad documents, copies in another case, near copies by a few code points, an empty text, NULLs."""
    draw, rows, labels = random.Random(4), [], []
    for i in range(240):
        good = i % 4 != 0
        words = H.words(draw.randint(30, 200), i)
        rows.append((i, " ".join(words) + ("." if good else " !!! $$$ ### %%%" * 12), f"s{i % 5}"))
        labels.append((i, int(good), 0))
    rows += [(300 + i, rows[i][1].upper(), "s1") for i in range(1, 40)]
    rows += [(400 + i, rows[i + 1][1] + " end", "s2") for i in range(40, 60)] + [(500, None, "s1"), (501, "", None), (None, rows[9][1], "s0"), (9, rows[9][1], "s0")]
    path = tmp_path_factory.mktemp("tables")
    H.make_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "simhash", "mixing", "packing"]
    pairs = lambda d: sorted(((r.doc_id, r.text, r.source) for r in d.collect()), key=str)

    good = stages["quality"](spark, docs, folder).cache()
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = Counter((r.doc_id, r.predicted) for r in quality.score(docs, model).collect())
    assert good.columns == columns
    assert Counter(r.doc_id for r in good.collect()) == Counter({i: n for (i, p), n in scored.items() if p})
    assert all(r.doc_id is None or r.doc_id >= 240 or r.doc_id % 4 for r in good.collect())

    single = stages["exact_dedup"](spark, good, folder).cache()
    groups = defaultdict(list)
    for i, t, s in pairs(good):
        groups[H.lower(t)].append((i, t, s))
    assert pairs(single) == sorted((max(g, key=lambda x: H.ordered(x[0])) for g in groups.values()), key=str)
    assert single.count() < good.count() and single.columns == columns

    apart = stages["simhash"](spark, single, folder).cache()
    rows = pairs(single)
    roots = H.components([H.fingerprint(t) for _, t, _ in rows], lambda a, b: bin(a ^ b).count("1") <= 3)
    low = {r: min((rows[k] for k in range(len(rows)) if roots[k] == r), key=lambda x: (x[0] is None, x[0])) for r in set(roots)}
    assert pairs(apart) == sorted(low.values(), key=str) and apart.columns == columns

    mixed = stages["mixing"](spark, apart, folder).cache()
    size, longest = Counter(), Counter()
    for _, t, s in pairs(apart):
        size[s] += len(H.split(t))
        longest[s] = max(longest[s], len(H.split(t)))
    from tests.llm.test_operators import mixing_truth

    order = sorted(size, key=lambda s: (s is None, s))
    took, times = Counter(), Counter()
    for i, t, s in pairs(mixed):
        took[s] += len(H.split(t))
        times[i] += 1
    assert set(pairs(mixed)) <= set(pairs(apart)) and max(times.values()) <= 3 and mixed.columns == columns
    assert all(abs(took[s] - x) <= longest[s] / 2 + 1 for s, x in zip(order, mixing_truth([size[s] for s in order]), strict=True))

    packed = stages["packing"](spark, mixed, folder).collect()
    assert Counter(i for i, _, _ in pairs(mixed)) == Counter(r.doc_id for r in packed if r.start == 0)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in packed)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert all(fill[s] == 2048 for s in range(len(fill) - 1))


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns[:7] == [p for p in SHAPES[7].split()[::2]] and found.count() > 0


def test_empty_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
