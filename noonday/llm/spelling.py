"""Spelling variants of a corpus' vocabulary: words one edit apart, found by a scan of sorted lists.

A word's list is scanned in sorted order with the edit matrix of the asking word, one row per letter of the listed word and
only the three cells around the diagonal in it. The next word shares a prefix with the last one (the list's LCP), so the
rows of that prefix are used again; where all three cells of a row exceed one edit, every word with that prefix is skipped.

Spark deals the sorted lists out so that each is short. Two words one edit apart, the longer of n letters, share their first
or their last n // 2 letters, whichever side the edit is not on. Every word stands in the list of its first and in that of its
last half (words of odd length also in the lists of the next longer words), the latter list sorted by the reversed words.
A list of more than ``LIST`` words, such as that of a prefix with a third of the vocabulary, is split in the same way
by the halves of what its words do not share, again and again, until all lists are short or their words differ in two
letters at most. A pair is given by one list only: the one for the common prefix if that is long enough, else the other.

Defined cases: NULL and empty texts have no words; a NULL id counts as an empty string in ``<doc_id>:<run>``; texts of any
length are read whole; repeated rows count each time; of near words with equal counts the smallest in code-point order is the
form; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonday.llm.common import ascii_lower, kept

#: Words of a list at most, unless they differ in two letters only; pairs that a task sends on at a time.
LIST, SENT = 2048, 1 << 16
#: The alphabet of words, their least length and count, the share of runs that are disturbed, and how much more frequent a form is.
LETTERS, LEAST, OFTEN, ONE_IN, TIMES = r"A-Za-zÀ-ÿ", 7, 2, 31, 10


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, one_in: int = ONE_IN) -> DataFrame:
    """``word`` and its count ``n``, after one letter of every ``one_in``-th run, by a hash of document and run, is deleted.

    A run shorter than ``least`` can't become a word, so only longer ones are taken from the text.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"),
    )
    lower = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = "int(h % length(run))"
    word = F.when(F.col("h") % one_in == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _split(rows: DataFrame) -> DataFrame:
    """Each word in the lists of its halves: ``head`` and ``tail`` letters are shared by all words of the list.

    ``below`` bounds the common prefix of the list's pairs, so that a pair is given once; ``guest`` has a bit for each
    split in which the word stands with the next longer ones, and two guests are no pair of that list.
    """
    inner = F.expr("substring(word, head + 1, length(word) - head - tail)")
    halves = F.expr("transform(if(m % 2 = 1, array(m div 2, m div 2 + 1), array(m div 2)), (h, i) -> struct(int(h) as h, i as late))")
    at = rows.withColumn("inner", inner).withColumn("m", F.length("inner")).withColumn("half", F.explode(halves))
    h = F.col("half.h")
    guests = (F.col("guest") * 2 + F.col("half.late")).alias("guest")
    side = lambda mark, text: F.concat("list", F.lit(mark), h.cast("string"), F.lit(":"), text).alias("list")
    left = F.struct(side(">", F.substring("inner", F.lit(1), h)), (F.col("head") + h).alias("head"), F.col("tail"), F.col("below"), guests)
    right = F.struct(
        side("<", F.expr("substring(inner, m - half.h + 1, half.h)")), F.col("head"), (F.col("tail") + h).alias("tail"),
        F.least("below", F.col("head") + h).alias("below"), guests,
    )
    return at.select("word", "n", F.explode(F.array(left, right)).alias("s")).select("word", "n", "s.*")


def lists(words: DataFrame, most: int = LIST) -> DataFrame:
    """The short lists: rows of ``word``, ``n``, ``list``, ``head``, ``tail``, ``below``, ``guest``."""
    start = {"list": F.lit(""), "head": F.lit(0), "tail": F.lit(0), "below": F.lit(1 << 30), "guest": F.lit(0)}
    rows, short = kept(_split(words.select("word", "n", *[c.alias(k) for k, c in start.items()])), "lists"), None
    while True:
        longest = F.max(F.length("word") - F.col("head") - F.col("tail"))
        sizes = rows.groupBy("list").agg(F.count("*").alias("size"), longest.alias("open"))
        crowded = kept(sizes.where((F.col("size") > most) & (F.col("open") > 2)).select("list"), "crowded")
        some = not crowded.isEmpty()
        fit = rows.join(crowded, "list", "left_anti") if some else rows
        short = fit if short is None else short.unionByName(fit)
        if not some:
            return short
        rows = kept(_split(rows.join(crowded, "list", "left_semi")), "lists")


def scan(words: list[str], shared: int) -> Iterator[tuple[int, int]]:
    """Positions i < j of the words one edit apart in a sorted list whose words all share ``shared`` first letters."""
    size = len(words)
    lcp = [0, *(len(commonprefix(words[k : k + 2])) for k in range(size - 1)), -1]
    following = [size] * (size + 1)  # of each position, the next one whose prefix in common with its predecessor is shorter
    stack: list[int] = []
    for k in range(size + 1):
        while stack and lcp[stack[-1]] > lcp[k]:
            following[stack.pop()] = k
        stack.append(k)
    for i, asked in enumerate(words):
        n = len(asked)
        rows = [(1, 0, 1)] * (n + 2)  # of the asked word's own prefixes
        j = i + 1
        while lcp[j] >= shared and j < size:
            word, depth = words[j], lcp[j]
            low, mid, high = rows[depth]
            while depth < len(word):
                c = word[depth]
                below = min(low + (depth == 0 or depth > n or asked[depth - 1] != c), mid + 1)
                mid = min(mid + (depth >= n or asked[depth] != c), below + 1, high + 1)
                high = min(high + (depth + 1 >= n or asked[depth + 1] != c), mid + 1)
                low = below
                depth += 1
                if low > 1 and mid > 1 and high > 1:
                    break
                rows[depth] = low, mid, high
            else:
                # D[len][n]: the cell of the row that stands for the whole asked word
                if -1 <= n - depth <= 1 and (low, mid, high)[n - depth + 1] == 1:
                    yield i, j
                j += 1
                continue
            j += 1
            while lcp[j] >= depth:
                j = following[j]


PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by list: every pair one edit apart, in both directions."""
    names = ["list", "scanned", "word", "n", "head", "tail", "below", "guest"]

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)

    def sent(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), PAIRS.types, strict=True)], schema=PAIRS)

    found: list[tuple] = []
    for _, members in groupby(rows(), itemgetter(0)):
        members = list(members)
        if len(members) == 1:
            continue
        _, _, _, _, head, tail, below, _ = members[0]
        for i, j in scan([x[1] for x in members], max(head, tail)):
            (_, _, a, a_n, *_, a_guest), (_, _, b, b_n, *_, b_guest) = members[i], members[j]
            if not a_guest & b_guest and len(commonprefix((a, b))) < below:
                found += [(a, a_n, b, b_n), (b, b_n, a, a_n)]
        if len(found) >= SENT:
            yield sent(found)
            found = []
    if found:
        yield sent(found)


def near_pairs(words: DataFrame, most: int = LIST) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all ordered pairs of words that differ by one code point."""
    short = lists(words, most)
    scanned: Column = F.when(F.col("tail") > F.col("head"), F.reverse("word")).otherwise(F.col("word"))
    dealt = short.withColumn("scanned", scanned).repartition("list").sortWithinPartitions("list", "scanned")
    return dealt.mapInArrow(_pairs, "word string, n long, near string, near_n long")


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, one_in: int = ONE_IN, times: int = TIMES, most: int = LIST) -> DataFrame:
    """One row per word: ``word``, ``n``, its ``form`` and ``form_n``, the ``root`` its forms lead to, and ``n_near``."""
    words = kept(vocabulary(docs, least, often, one_in), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.less") >= times * F.col("n")
    found = kept(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    # counts grow tenfold along a chain of forms, so it is short; each round doubles the steps taken
    steps = kept(found.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = kept(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
