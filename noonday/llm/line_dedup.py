"""Line dedup by a segment-partition edit join.

Lines, trimmed of ASCII white space, are classes by content. Two different classes are linked if one is at most ``edits``
single-character edits from the other and both have ``least`` characters or more. A line is cut into ``edits + 1``
segments of even length; whatever is within ``edits`` of it holds one of them unchanged, near the same place. So each line
is indexed by its segments with number and line length, and probes the index of its own and each smaller length with the
few substrings that can be in place there. Lines that meet no other line at any key are left behind; the others come back
with their text, and their matches are verified, by character parities and then by edit distance: a band of ``2 * edits + 1`` diagonals is
held in the bits of one number and advanced a character at a time.

Of linked lines the first in order of (``doc_id``, ``line``) stays: a line is removed if an earlier line of its class or
an earlier class within ``edits`` exists.

Only hashes of segments and lines are joined. A line met in more than one of ``FREQUENT`` parts of all lines is taken
once: there are less than ``FREQUENT`` of them, so they are broadcast; the signatures of all others are made where they
are read.

Defined cases: a NULL text is one blank line; blank lines stay and have no class; lines under ``least`` characters match
exactly only; a NULL ``doc_id`` comes before every number; rows repeated in ``doc_id`` and text have lines of equal rank,
of which one stays; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions.plan import computed_once
from noonday.llm.common import kept

EDITS, LEAST, FREQUENT = 2, 20, 10_000
#: Bits of the number that holds the band; the highest is the lowest row of the band.
TOP = 31
WORD = (1 << (TOP + 1)) - 1
#: Bits of the bitmap that thins out lines before a join; 32,768 times a power of two.
BITMAP = 1 << 23


def codes(text: Column) -> Column:
    """The code points of a string."""
    return F.transform(F.split(text, ""), F.ascii)


def edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """The edit distance of two arrays of code points, exact up to ``edits``.

    Both have at least ``edits`` characters, and their lengths differ by no more. The published bit-vector recurrence,
    on a band that moves down one row with each character of ``b``. Up to the last row the distance is read along the
    band's lowest diagonal, then along the last row; once it is so high that the rest cannot bring it back, it is left
    there. ``a`` and ``b`` should be plain columns.
    """
    full, zero, turn = F.lit(WORD).cast("long"), F.lit(0).cast("long"), F.size(a) - edits
    band = (((1 << (edits + 1)) - 1) << (TOP - edits)) & WORD
    start = F.struct(F.lit(band).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).alias("dist"), F.lit(0).alias("j"))

    def step(s: Column, c: Column) -> Column:
        vp, vn, j, eq = s["vp"], s["vn"], s["j"], zero
        for d in range(-edits, edits + 1):
            same = F.coalesce(F.get(a, j + d) == c, F.lit(False))
            eq = eq.bitwiseOR(F.when(same, F.lit(1 << (TOP - edits + d)).cast("long")).otherwise(zero))
        d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)
        hp, hn, down = vn.bitwiseOR(full.bitwiseXOR(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
        on_row = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(TOP - 1) - (j - turn))
        diagonal = F.when(d0.bitwiseAND(F.lit(1 << TOP).cast("long")) != 0, 0).otherwise(1)
        across = F.when(hp.bitwiseAND(on_row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(on_row) != 0, 1).otherwise(0)
        moved = F.struct(
            hn.bitwiseOR(full.bitwiseXOR(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
            (s["dist"] + F.when(j < turn, diagonal).otherwise(across)).alias("dist"), (j + 1).alias("j"),
        )
        return F.when(s["dist"] > 2 * edits + F.size(b) - F.size(a), s).otherwise(moved)

    return F.aggregate(b, start, step, lambda s: s["dist"])


def parities(line: Column) -> Column:
    """64 bits: whether characters come an odd number of times, by code point modulo 64. An edit turns two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(bit(c)))


def places(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(gap, segment, shift) of all keys of a line; its own segments are those without gap and shift.

    Segment i of a line shorter by ``gap`` can only stand, unchanged, where no more than ``edits`` edits fit in before and
    after it.
    """
    return [
        (gap, i, shift)
        for gap in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)
    ]


def signatures(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``lines`` (``line``, its length ``n``, and others) with a ``key`` for each of its places, and whether it is its ``own``.

    Lines are cut into ``edits + 1`` segments, the last ones a character longer where the length does not divide. A key
    is a segment's text, its number, and the length of the line that it is a segment of.
    """
    parts = edits + 1
    at = F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for g, i, s in places(edits)]))
    placed = lines.withColumn("c", at).select(*lines.columns, F.col("c.gap"), F.col("c.i"), F.col("c.shift"), (F.col("n") - F.col("c.gap")).alias("of"))
    begin = f"i * (of div {parts}) + greatest(i - {parts} + of % {parts}, 0) + shift"
    size = f"(of div {parts}) + if(i >= {parts} - of % {parts}, 1, 0)"
    cut = placed.withColumn("begin", F.expr(begin).cast("int")).withColumn("size", F.expr(size).cast("int")).where("begin >= 0 and begin + size <= n")
    key = F.xxhash64(F.expr("substring(line, begin + 1, size)"), "i", "of")
    return cut.select(*lines.columns, key.alias("key"), F.expr("gap = 0 and shift = 0").alias("own"))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``id`` is in ``ids``.

    A bitmap of the ids' low bits, of one size whatever the table's, is broadcast first: few rows then need the exact
    join. As it fills up it lets more pass, and the join alone decides.
    """
    bit = F.col("id").bitwiseAND(F.lit(BITMAP - 1))
    bitmaps = ids.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    marked = rows.withColumn("b", bit).withColumn("part", F.expr("bitmap_bucket_number(b)"))
    near = marked.join(F.broadcast(bitmaps), "part")  # BITMAP / 8 bytes, always
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(b) div 8 + 1 as int), 1)")), 16, 10).cast("long")
    set_ = F.expr("shiftright(byte, cast(bitmap_bit_position(b) % 8 as int)) & 1 = 1")
    # Computed once, so that the exact join is not moved below the bitmap, where it would shuffle all rows.
    thin = computed_once(near.withColumn("byte", byte).where(set_).select(*rows.columns))
    return thin.join(ids, "id", "left_semi")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line`` (number from 0), ``text`` trimmed, of every line."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "raw"))
    return split.select("doc_id", F.col("number").cast("long").alias("number"), F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line"))


def met(lines: DataFrame, edits: int) -> DataFrame:
    """The ids of the lines (``id``, ``line``, ``n``) that meet any other at a key, as one of the two's own."""
    keys = signatures(lines, edits).select("key", "id", "own")
    every = Window.partitionBy("key")
    told = keys.select("id", F.min("id").over(every).alias("low"), F.max("id").over(every).alias("high"), F.max("own").over(every).alias("held"))
    return told.where("low < high and held").select("id").distinct()


def verified(lines: DataFrame, edits: int) -> DataFrame:
    """``a``, ``b``: the different ``line``s within ``edits`` of each other.

    Matches at a key whose character parities are too far apart never leave the join; the others are verified.
    """
    texts = kept(lines.withColumn("odd", parities(F.col("line"))), "texts")
    keys = signatures(texts, edits).select("key", "id", "n", "odd", "own")
    x, y = keys.where("own").alias("x"), keys.alias("y")
    # Of two lines of one length the probe has the larger hash, of others it is the longer: a pair is met from one side.
    side = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    near = F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= 2 * edits
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & near & side).select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).distinct()
    left, right = (texts.select(F.col("id").alias(i), F.col("line").alias(c)) for i, c in (("i", "a"), ("j", "b")))
    ready = computed_once(kept(pairs, "pairs").join(left, "i").join(right, "j").select("a", "b", codes(F.col("a")).alias("x"), codes(F.col("b")).alias("y")))
    fits = F.abs(F.size("x") - F.size("y")) <= edits
    return ready.where(fits & (edit_distance(F.col("x"), F.col("y"), edits) <= edits)).select("a", "b")


def near_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All lines with their class (``doc_id``, ``number``, ``md5``, NULL if blank), and the links between classes.

    Links are ``md5`` and ``other``, each in both directions.
    """
    every = lines_of(docs)
    where = every.select("doc_id", "number", F.when(F.col("line") != "", F.unhex(F.md5("line"))).alias("md5"), F.xxhash64("line").alias("id"), F.length("line").alias("n"))
    where = kept(where, "lines")
    long = F.length("line") >= least
    total = where.count()
    frequent = where.where(F.col("n") >= least).groupBy("id").agg(F.count("*").alias("times")).where(F.col("times") * FREQUENT > total)
    # Classes with more than one part in FREQUENT of all lines: fewer than FREQUENT rows of one number, so a broadcast.
    frequent = kept(frequent.select("id"), "frequent")
    read = computed_once(every.where(long).select("line", F.xxhash64("line").alias("id"), F.length("line").alias("n")))
    often = read.join(F.broadcast(frequent), "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"), F.min("n").alias("n"))
    rare = read.join(F.broadcast(frequent), "id", "left_anti")
    ids = kept(met(rare.unionByName(often), edits), "met")
    found = verified(among(read, ids).distinct(), edits)
    near = kept(found.select(F.unhex(F.md5("a")).alias("md5"), F.unhex(F.md5("b")).alias("other")), "links")
    return where.drop("id", "n"), near.union(near.select("other", "md5"))


def judged(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row per line: ``doc_id``, ``number``, ``class_doc`` and ``class_number`` (the first line of its class), ``copies``,
    ``links`` (other classes within ``edits``), ``near_doc`` and ``near_number`` (the first line of the earliest of
    these, where it is earlier than its own class) and ``kept``."""
    where, links = near_lines(docs, edits, least)
    firsts = kept(where.where("md5 is not null").groupBy("md5").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("copies")), "firsts")
    other = firsts.select(F.col("md5").alias("other"), F.col("first").alias("other_first"))
    met = links.join(other, "other").groupBy("md5").agg(F.count("*").alias("links"), F.min("other_first").alias("near"))
    classes = kept(firsts.join(met, "md5", "left").select("md5", "first", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.when(F.col("near") < F.col("first"), F.col("near")).alias("near")), "classes")
    found = where.join(classes, "md5", "left")
    own = F.struct("doc_id", "number").eqNullSafe(F.col("first"))
    return found.select(
        "doc_id", "number", F.col("first.doc_id").alias("class_doc"), F.col("first.number").alias("class_number"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.col("near.doc_id").alias("near_doc"), F.col("near.number").alias("near_number"),
        (F.col("first").isNull() | (own & F.col("near").isNull())).alias("kept"),
    )


def cleaned(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``doc_id`` and ``text`` of every document with its kept lines; a document that loses all lines has an empty text.

    Rows that repeat a ``doc_id`` are one document here: their lines are merged in order.
    """
    kept_lines = judged(docs, edits, least).where("kept").select("doc_id", "number").distinct()
    read = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "raw"))
    met = read.alias("r").join(kept_lines.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.number") == F.col("k.number")), "left")
    own = F.when(F.col("k.number").isNotNull(), F.struct(F.col("r.number").alias("number"), "raw"))
    return met.groupBy("r.doc_id").agg(F.array_join(F.sort_array(F.collect_list(own))["raw"], "\n").alias("text"))
