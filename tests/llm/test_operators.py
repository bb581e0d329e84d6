"""Every operator against a brute-force version on a table with the awkward cases, and on an empty table."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from noonday.llm import exact_dedup, line_dedup, mixing, neighbours, packing, pii, quality, sharding, simhash, substring_dedup
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return H.make_docs(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def tuples(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=lambda t: [H.ordered(x) if not isinstance(x, str) else (True, x) for x in t])


def as_sorted(found):
    return sorted(found, key=lambda t: [H.ordered(x) if not isinstance(x, str) else (True, x) for x in t])


# 1 line dedup


def test_edit_distance(spark):
    draw, pairs = random.Random(3), []
    for _ in range(1500):
        a = [draw.choice("abcé") for _ in range(draw.randint(6, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(b))
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "bé"[: draw.randint(1, 2)]])
        pairs.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string").withColumn("x", line_dedup.codes(F.col("a"))).withColumn("y", line_dedup.codes(F.col("b"))).withColumn("n", F.length("a"))
    for most in (1, 2, 3):
        near = frame.where((F.abs(F.col("n") - F.length("b")) <= most) & (F.length("b") >= most))
        got = near.select("a", "b", line_dedup.edit_distance(F.col("x"), F.col("y"), most).alias("e"), (F.bit_count(line_dedup.parities(F.col("a")).bitwiseXOR(line_dedup.parities(F.col("b")))) <= 2 * most).alias("may")).collect()
        assert len(got) > 500
        for r in got:
            assert min(r.e, most + 1) == min(H.edits(r.a, r.b), most + 1)
            assert r.may or r.e > most


def line_truth(rows, most, least):
    lines = [(i, n, line.strip(" \t\r\x0b\x0c")) for i, t, _ in rows for n, line in enumerate((t or "").split("\n"))]
    first, copies = {}, Counter(line for _, _, line in lines if line)
    for i, n, line in sorted(lines, key=lambda x: (H.ordered(x[0]), x[1])):
        if line:
            first.setdefault(line, (i, n))
    long, links = [x for x in first if least <= len(x) < 1000], defaultdict(list)
    for a in long:
        for b in long:
            if a != b and abs(len(a) - len(b)) <= most and H.edits(a, b) <= most:
                links[a].append(b)
    out, rank = [], lambda p: (H.ordered(p[0]), p[1])
    for i, n, line in lines:
        if not line:
            out.append((i, n, None, None, 1, 0, True))
            continue
        own, near = first[line], [first[x] for x in links[line] if rank(first[x]) < rank(first[line])]
        out.append((i, n, *own, copies[line], len(links[line]), own == (i, n) and not near))
    return out


@pytest.mark.parametrize("frequent", [10_000, 4])
def test_line_dedup(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    draw, more = random.Random(5), []
    for k in range(60):
        line = " ".join(H.words(9, 500 + k % 12))
        at = draw.randrange(len(line))
        more.append((300 + k, "\n".join([line[:at] + draw.choice(["", "x", "yz"]) + line[at + draw.randint(0, 2) :], "", "short", line]), "d"))
    every = [r for r in rows if r[0] not in (16, 18)] + more
    got = line_dedup.judged(H.make_docs(spark, every))
    truth = line_truth(every, line_dedup.EDITS, line_dedup.LEAST)
    assert any(t[5] for t in truth) and any(not t[6] for t in truth)
    assert tuples(got, "doc_id", "number", "class_doc", "class_number", "copies", "links", "kept") == as_sorted(truth)


def test_line_dedup_cleaned(spark):
    frame = H.make_docs(spark, [(1, "first line of some length\n\nother", "a"), (2, "first line of some lengths\nother\nown", "a"), (3, None, "a")])
    assert dict(map(tuple, line_dedup.cleaned(frame).collect())) == {1: "first line of some length\n\nother", 2: "own", 3: ""}


# 2 personal data


def test_pii_base(spark, rows):
    texts = [
        "a.b@c.de x@y z@w.q_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 0255.001.2.3", "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436468", "+1 (555) 555-0100 +12 +49 30 1234567890123456",
        "é😀 mail a@b.co é 10.0.0.1!", "9" * 30_000, "1." * 20_000, "a" * 30_000 + "@", "a@b" + ".c" * 10_000, "+1" * 500 + "((((", "",
    ]
    every = rows + [(1000 + i, t, "p") for i, t in enumerate(texts)]
    got = pii.find(H.make_docs(spark, every)).select("doc_id", pii.digest(F.col("base")).alias("base"), pii.digest(F.col("spans")).alias("spans"))
    assert tuples(got, "doc_id", "base") == as_sorted([(i, ",".join(f"{k}:{a}:{b}" for k, a, b in H.base_spans(t))) for i, t, _ in every])


def test_pii_learns_from_context(spark):
    draw = random.Random(1)
    known = [(i, f"{' '.join(H.words(5, i))} please call me on +1 555 {draw.randrange(1000, 9999)} {draw.randrange(1000, 9999)} any day {i}", "a") for i in range(12)]
    unseen = [(100, "please call me on 555 0199 7788 any day", "a"), (101, "the year was 1999 and nothing else", "a"), (102, "invoice 555 0199 9999 paid", "a")]
    spans = dict(map(tuple, pii.find(H.make_docs(spark, known + unseen)).select("doc_id", pii.digest(F.col("spans"))).collect()))
    assert spans[100] == "phone:18:31" and spans[101] == "" and spans[102] == ""
    assert all(spans[i].startswith("phone:") and "," not in spans[i] for i in range(12))


# 3 SimHash


@pytest.mark.parametrize("bucket", [512, 1])
def test_simhash(docs, rows, bucket):
    prints = [H.fingerprint(t) for _, t, _ in rows]
    roots = H.components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    low = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    truth = [(i, f"{p:016x}", low[r]) for (i, _, _), p, r in zip(rows, prints, roots, strict=True)]
    got = simhash.components_of(docs, bucket=bucket)
    assert tuples(got, "doc_id", "fingerprint", "component_id") == as_sorted(truth)


@pytest.mark.parametrize("bucket", [512, 3])
def test_simhash_chains(spark, bucket):
    """Fingerprints in chains and crowds, where components are longer than a link."""
    draw, values = random.Random(9), set()
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            values.add(x)
            for _ in range(draw.randint(1, 4)):
                x ^= 1 << draw.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket)
    from noonday.llm.graph import components

    root = {r.node: r.root for r in components(edges).collect()}
    truth = H.components(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    mine = defaultdict(set)
    for v in signed:
        mine[root.get(v, v)].add(v)
    theirs = defaultdict(set)
    for v, r in zip(signed, truth, strict=True):
        theirs[r].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_one_of_each(docs, rows):
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    classes = {r.component_id for r in simhash.components_of(docs).collect()}
    assert sorted((r.doc_id for r in found.collect()), key=H.ordered) == sorted(classes, key=H.ordered)


def test_one_of_each_keeps_unlike_texts(spark):
    """One row per component, also where unlike texts have no id or the same id, and where an id is in two components."""
    base, other = " ".join(H.words(300, 2)), " ".join(H.words(200, 3))
    near = base.replace(base.split()[150], "changed", 1)
    assert 0 < bin(H.fingerprint(base) ^ H.fingerprint(near)).count("1") <= 3
    lone = [(None, " ".join(H.words(50, 50 + i)), "a") for i in range(4)]
    same = [(7, " ".join(H.words(50, 70 + i)), "b") for i in range(4)]
    rows = [*lone, lone[0], *same, same[0], (3, base, "c"), (5, near, "c"), (5, other, "d"), (None, other, "d")]
    roots = H.components([H.fingerprint(t) for _, t, _ in rows], lambda a, b: bin(a ^ b).count("1") <= 3)
    low = {r: min((x for x, y in zip(rows, roots, strict=True) if y == r), key=lambda x: (x[0] is None, x[0])) for r in set(roots)}
    got = simhash.one_of_each(H.make_docs(spark, rows).repartition(3))
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str) == sorted(low.values(), key=str)
    assert len(low) == 10


# 4 sharding


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 512])
def test_sharding(docs, rows, bucket_bytes):
    got = sharding.place(docs, bucket_bytes=bucket_bytes).collect()
    sizes = as_sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows])
    assert as_sorted([(r.doc_id, r.size, r.text_crc32) for r in got]) == sizes
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert got == sharding.place(docs, bucket_bytes=bucket_bytes).collect()


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), n_shards=4, bucket_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert as_sorted([(r.doc.doc_id, r.doc.text or "") for r in back.collect()]) == as_sorted([(i, t or "") for i, t, _ in rows])
    assert [r.shard for r in back.select("shard").distinct().orderBy("shard").collect()] == [0, 1, 2, 3]


def test_shards_hold_what_place_reports(spark, docs, rows, monkeypatch):
    """Whole records are written, where and in the order that ``place`` says, and row counts are at most one apart."""
    folders = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda d, path, *more: folders.append(path) or write(d, path, *more))
    got = sharding.place(docs, n_shards=3, bucket_bytes=20_000).collect()
    back = spark.read.parquet(folders[0])
    assert back.schema["doc"].dataType == docs.schema
    held = {(r.shard, r.slot): r.doc for r in back.collect()}
    assert len(held) == len(got) == len(rows) and back.select("bucket").distinct().count() > 3
    for r in got:
        text = (held[r.shard, r.slot].text or "").encode()
        assert (held[r.shard, r.slot].doc_id, len(text) + 1, zlib.crc32(text)) == (r.doc_id, r.size, r.text_crc32)
    n = Counter(s for s, _ in held)
    assert max(n.values()) - min(n[s] for s in range(3)) <= 1 and all(sorted(k for t, k in held if t == s) == list(range(n[s])) for s in range(3))
    for file in back.inputFiles():
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == sorted(slots)


# 5 substring dedup


@pytest.mark.parametrize(("window", "rounds"), [(35, 6), (35, 2), (5, 4), (1, 1)])
def test_substring_dedup(docs, rows, window, rounds):
    truth = [(i, *x) for (i, _, _), x in zip(rows, H.without_repeats([t for _, t, _ in rows], window), strict=True)]
    got = substring_dedup.kept_words(docs, window, rounds)
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256") == as_sorted(truth)


def test_recompression_never_loses_a_repeat():
    """Small vocabularies, runs and periods: every repeated window survives the symbol filter."""
    draw = random.Random(11)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abcdefgh"
        texts = [" ".join(draw.choice(letters) * 1 for _ in range(draw.randint(0, 120))) for _ in range(4)]
        texts.append(" ".join(["a"] * 50 + ["b", "c"] * 20))
        texts.append(" ".join(texts[0].split()[5:60] + texts[1].split()[3:70]))
        window, rounds = draw.choice([3, 8, 20, 35]), draw.randint(0, 7)
        laid = substring_dedup.Laid.of(texts)
        keys, low, form = substring_dedup.anchors(laid, window, rounds)
        times, own = Counter(keys.tolist()), laid.text_of(low)
        lone = [[(int(a - laid.starts[i]) << 32) | int(f) for k, a, f, t in zip(keys.tolist(), low, form, own, strict=True) if t == i and times[k] == 1] for i in range(len(texts))]
        places = [[(int(a - laid.starts[i]) << 32) | int(f) for a, f, t in zip(low, form, own, strict=True) if t == i] for i in range(len(texts))]
        left, starts = substring_dedup.survivors(np.array([len(w) for w in laid.words]), places, lone, window)
        alive = set(left.tolist())
        assert starts.tolist() == laid.starts.tolist()
        counts = Counter(tuple(laid.words[i][j : j + window]) for i in range(len(texts)) for j in range(len(laid.words[i]) - window + 1))
        for i, s in enumerate(laid.starts.tolist()):
            for j in range(len(laid.words[i]) - window + 1):
                assert counts[tuple(laid.words[i][j : j + window])] == 1 or s + j in alive


# 6 quality


def test_quality_rules_compile(spark, docs, rows):
    model = quality.Model((quality.Rule((("__words", True, 2.0), ("__marks", False, 0.3)), 1.5), quality.Rule((("__digits", True, 0.01),), -0.7)), 0.2)
    frame, names = quality.with_statistics(docs, "doc_id")
    for r in frame.join(quality.score(docs, model).select(F.col("doc_id").alias("d"), "score"), F.col("doc_id") == F.col("d")).collect():
        total = 0.2 + 1.5 * (r["__words"] > 2.0 and r["__marks"] <= 0.3) - 0.7 * (r["__digits"] > 0.01)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12
    assert quality.score(docs, model).count() == len(rows)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_learns_and_holds_out(spark):
    rows, labels = [], []
    for i in range(900):
        good = i % 3 != 0
        rows.append((i, " ".join(H.words(60, i)) + ("." if good else " !!! $$$ ### %%%" * 6), "a"))
        labels.append((i, int(good), 0))
    docs, marks = H.make_docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, marks)).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    unseen = [i for i in range(900) if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 3 != 0) for i in unseen]) > 0.97
    flipped = marks.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, flipped)).collect()} == {i: r.score for i, r in found.items()}
    none = quality.score(docs, quality.fit(docs, marks.where("false"))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_lasso_drops_what_does_not_tell():
    draw = np.random.default_rng(0)
    x = draw.random((800, 6))
    model = quality.fit_rules(x, (x[:, 2] > 0.5).astype(float), [f"__{i}" for i in range(6)])
    used = {name for r in model.rules for name, _, _ in r.bounds if abs(r.weight) > 0.2}
    assert "__2" in used and len(model.rules) < 200


# 7 packing


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [exact.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows]
    got = packing.pack(docs, window=4096).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
        by_doc[r.doc_id].append(r)
    expected = defaultdict(list)
    for (i, _, _), x in zip(rows, ids, strict=True):
        expected[i] += [(at, v) for at, v in enumerate(x)]
    for i, pieces in by_doc.items():
        assert sorted((r.start + k, v) for r in pieces for k, v in enumerate(r.ids)) == sorted(expected[i])
    assert set(by_doc) == set(expected)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    total = sum(map(len, ids))
    assert sorted(filled) == list(range(-(-total // 2048)))
    for s, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == (2048 if (s + 1) * 2048 <= total else total % 2048)
    whole = packing.sequences(packing.pack(docs)).collect()
    assert sum(len(r.input_ids) for r in whole) == total


def test_many_sources(spark, monkeypatch):
    """Above the bound on queues every source still has its own, and every piece the same place as below it."""
    rows = [(i, " ".join(H.words(1 + i * 7 % 90, i)), None if i % 41 == 0 else f"s{min(i % 60, 37)}") for i in range(150)]
    docs = H.make_docs(spark, rows).repartition(3).cache()
    few = sorted(map(tuple, packing.pack(docs, length=64, window=300).collect()))
    monkeypatch.setattr(packing, "QUEUES", 2)
    monkeypatch.setattr(packing, "WINDOWS_EACH", 4)
    assert sorted(map(tuple, packing.pack(docs, length=64, window=300).collect())) == few
    queues = {s for _, _, s in rows}
    assert packing.tokens(docs).select("queue").distinct().count() == len(queues)


def test_windows_hold_the_mixture():
    totals = [10_000, 3_333, 17, 1]
    turns = packing.Turns(totals, 500)
    place = {}
    for q, t in enumerate(totals):
        for a, b, at in turns.served(q, 0, t):
            place.update({at + k: q for k in range(b - a)})
    assert sorted(place) == list(range(sum(totals)))
    share = sum(totals) / turns.windows
    edges = [sum(turns.earned(k)) for k in range(turns.windows + 1)]
    for low, high in zip(edges, edges[1:], strict=False):
        served = Counter(place[x] for x in range(low, high))
        assert all(abs(served[q] - t / turns.windows) < 1 for q, t in enumerate(totals)) and abs(high - low - share) < len(totals)


def test_encodings_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, draw = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    texts = ["", " ", "\n\n  x", "it's we'll I'M", "<|endoftext|> a", "a" * 3000, "123 456,7", "  é", "日本語 ñandú 😀"]
    texts += ["".join(chr(draw.choice([32, 10, 39, *range(33, 127), *range(0xA1, 0x250), 0x4E2D, 0x1F600])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert packing.encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids + [1]


# 8 mixing


def mixing_truth(sizes):
    """Targets of sources (in order) by repeated sharing."""
    weights, target, held = [1 + i % 3 for i in range(len(sizes))], [0.0] * len(sizes), set()
    rest = float(sum(sizes))
    while rest > 1e-9 and len(held) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in held]
        total = sum(weights[i] for i in free)
        for i in free:
            target[i] += rest * weights[i] / total
        rest = 0.0
        for i in free:
            if target[i] >= 3 * sizes[i]:
                rest += target[i] - 3 * sizes[i]
                target[i] = 3.0 * sizes[i]
                held.add(i)
    return target


@pytest.mark.parametrize("slots", [1 << 20, 50])
def test_mixing(docs, rows, slots, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 8)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(H.split(t))
    order = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), None]
    target = dict(zip(order, mixing_truth([size[s] for s in order]), strict=True))
    found, pieces = mixing.mix(docs, slots=slots)
    took = {r.uid: r.w for r in pieces.groupBy("uid").agg(F.sum("words").alias("w")).collect()}
    taken = Counter()
    for r in found.collect():
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert took.get(r.uid, 0) <= 3 * r.size
        taken[r.source] += took.get(r.uid, 0)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert as_sorted([(r.doc_id, r.size) for r in found.collect()]) == as_sorted([(i, len(H.split(t))) for i, t, _ in rows])


def test_mixing_is_even_and_reruns_agree(docs):
    _, pieces = mixing.mix(docs, slots=200)
    sources, _ = mixing.mix(docs, slots=200)
    named = pieces.join(sources.select("uid", "source"), "uid").orderBy("turn").collect()
    assert sorted(map(tuple, mixing.taken(docs).collect()), key=str) == sorted(map(tuple, mixing.taken(docs).collect()), key=str)
    total, half = Counter(), Counter()
    for k, r in enumerate(named):
        total[r.source] += r.words
        half[r.source] += r.words * (r.turn < 100)
    big = total.most_common(1)[0][0]
    assert abs(half[big] / sum(half.values()) - total[big] / sum(total.values())) < 0.1


# 9 exact dedup


@pytest.mark.parametrize(("least", "most"), [(1024, 8192), (2, 5)])
def test_exact_dedup(docs, rows, least, most):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[H.lower(t)].append(i)
    truth = []
    for text, ids in groups.items():
        keep, sha = max(ids, key=H.ordered), hashlib.sha256(text.encode()).hexdigest()
        stays = [True] + [False] * (ids.count(keep) - 1)
        truth += [(i, keep, len(ids), i == keep and stays.pop(0), sha) for i in ids]
    got = exact_dedup.find_copies(docs, least, most)
    assert tuples(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == as_sorted(truth)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and as_sorted([(r.doc_id,) for r in left.collect()]) == as_sorted([(t[0],) for t in truth if t[3]])


def test_chunks_cover_and_realign(spark):
    text = "".join(f"{' '.join(H.words(40, k))}. " for k in range(400))
    frame = spark.createDataFrame([(1, text), (2, "inserted words here " + text)], "doc_id long, text string")
    found = {r.doc_id: [c.id for c in r.recipe] for r in exact_dedup.recipes(frame, F.col("text")).collect()}
    assert len(found[1]) > 20 and len(set(found[1]) & set(found[2])) > len(found[1]) * 0.8
    pieces = frame.select(F.array_join(F.regexp_extract_all("text", F.lit(exact_dedup.chunk_pattern()), F.lit(0)), "").alias("t"), "text").collect()
    assert all(r.t == r.text for r in pieces)


def test_untrusted_chunk_ids(spark, docs, rows, monkeypatch):
    """With identifiers that collide the SHA-256 values decide."""
    plain = exact_dedup.recipes

    def colliding(*a):
        return plain(*a).withColumn("recipe", F.transform("recipe", lambda c: F.struct(F.lit(7).cast("long").alias("id"), c["sha"].alias("sha"))))

    expected = tuples(exact_dedup.find_copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    monkeypatch.setattr(exact_dedup, "recipes", colliding)
    assert tuples(exact_dedup.find_copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected


# 10 neighbours


def vector_rows():
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, rows[0][1]), (0, rows[0][1])]
    bad = [[0.0] * 8, None, [], [float("nan")] * 8, [1.0, None] * 4, [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    rows += [(3000 + i, v) for i, v in enumerate(bad)] + [(3050, bad[0]), (None, rows[1][1]), (3100, [1e-30] * 8), (3150, [1e30] * 8)]
    return rows


def nearest_truth(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0 and q not in out:
            x = x / np.abs(x).max()
            scored = []
            for i, v in good:
                if i != q:
                    v = v / np.abs(v).max()
                    scored.append((-round(float(v @ x / np.sqrt((v @ v) * (x @ x))), 12), i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_neighbours_exact_when_nothing_may_be_missed(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rows, got = vector_rows(), defaultdict(list)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, miss=1e-12).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    truth = nearest_truth(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in truth.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in got for a, b in zip(got[q], truth[q], strict=True))


def test_neighbours_recall(spark):
    from noonday.llm.common import table

    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    matrix, ids = np.array([v for _, v in rows], dtype=float), np.array([i for i, _ in rows])
    unit = matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))
    found = defaultdict(list)
    for r in neighbours.search(vectors, F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        hits += len(set(ids[np.argsort(-score)[:5]]) & set(found[q]))
        total += 5
    assert hits / total >= 0.9


def test_few_candidates(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 51, round(0.5**0.5, 9))]


# empty tables


def test_empty_tables(spark, nothing):
    assert line_dedup.judged(nothing).count() == 0
    assert pii.find(nothing).count() == 0
    assert simhash.components_of(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert sharding.place(nothing).count() == 0
    assert substring_dedup.kept_words(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(nothing, quality.fit(nothing, labels)).count() == 0
    assert packing.pack(nothing).count() == 0
    assert mixing.taken(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert exact_dedup.find_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, F.col("vec_id") % 50 == 0).count() == 0
