"""Personal data by bootstrapped contextual extraction.

Fixed formats (e-mail, IP address, payment card, phone) are the seeds. Every text is also cut into mentions, stretches
that could be an identifier: something with an at sign, or digits with the usual separators. A mention stands in lexical
patterns: the two words before it, the word before and the word after, and the two words after. Patterns and the values
that stand in them form a graph. In each round a pattern is scored by the share of its values that count as its kind, a
value by its trusted patterns (noisy or), and values above the threshold count as seeds of the next round; other formats
count against a pattern. A mention is taken where its value and one of its own patterns are trusted, in a form its kind
could have, and only where no fixed-format span is. Fixed-format spans always stay.

Scores are sums over the whole table, combined before they move. Nothing but mentions leaves the scan of the texts.

Defined cases: a NULL text is empty; the empty text has no spans; rows repeated in ``doc_id`` and text each have their own
result; a NULL ``doc_id`` is passed on; without seeds nothing is learned; an empty table gives no rows; further columns
are ignored. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.llm.common import kept

KINDS = ("email", "ip", "card", "phone")
#: The fixed formats, in forms that find the same leftmost stretches without backtracking through long runs.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stretches that could be an identifier.
MENTION = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*+|[+(]{0,2}[0-9](?:[\x20().:-]{0,3}+[0-9])++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a mention must look like to become a span of its kind by its context.
FORMS = {
    "email": r"^[^@]+@[^@]{2,}$",
    "ip": r"^[0-9]{1,3}(?:[.:][0-9]{1,3}){3}$",
    "card": r"^(?:[^0-9]*[0-9]){13,19}[^0-9]*$",
    "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$",
}
#: Share that a pattern and a value must reach, different seed values that a pattern needs, and rounds.
TRUST, SUPPORT, ROUNDS = 0.8, 3, 2
#: Characters around a mention that its context is read from.
CONTEXT = 80
SPACE = r"\x20\x09-\x0D"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))
        .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(False)
    )


def stretches(docs: DataFrame) -> DataFrame:
    """``uid``, ``doc_id``, ``kind``, ``start``, ``end``, ``hit``, and the text ``before`` and ``after``, of all formats and mentions.

    A text is split by each format; the pieces between the hits give the positions as running sums. Each document keeps
    a row without a hit, so that documents without any are not lost.
    """
    text = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def found(kind: str, pattern: str, possible: Column) -> Column:
        p = F.lit(pattern)
        zipped = F.arrays_zip(F.split("text", pattern, -1).alias("piece"), F.regexp_extract_all("text", p, F.lit(0)).alias("hit"))
        return F.struct(F.lit(kind).alias("kind"), F.when(possible, zipped).alias("parts"))

    at, digit = F.contains("text", F.lit("@")), F.col("text").rlike("[0-9]")
    lists = [found(k, FORMATS[k], at if k == "email" else digit) for k in KINDS] + [found("mention", MENTION, at | digit)]
    kinds = text.select("uid", "doc_id", F.explode(F.array(*lists)).alias("k")).select("uid", "doc_id", "k.kind", F.posexplode_outer("k.parts").alias("pos", "part"))
    rows = kinds.select("uid", "doc_id", "kind", F.coalesce("pos", F.lit(0)).alias("pos"), "part.piece", "part.hit").where("hit is not null or (kind = 'mention')")
    rows = rows.select(
        "uid", "doc_id", "kind", "pos", "hit", F.coalesce(F.length("piece"), F.lit(0)).alias("gap"),
        F.when(F.col("kind") == "mention", F.right("piece", F.lit(CONTEXT))).alias("before"),
        F.when(F.col("kind") == "mention", F.left("piece", F.lit(CONTEXT))).alias("head"),
    )
    order = Window.partitionBy("uid", "kind").orderBy("pos")
    lagged = rows.withColumn("step", F.col("gap") + F.coalesce(F.length(F.lag("hit").over(order)), F.lit(0))).withColumn("after", F.lead("head").over(order))
    placed = lagged.withColumn("start", F.sum("step").over(order))
    return placed.select("uid", "doc_id", "kind", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("hit")).cast("long").alias("end"), "hit", "before", "after")


def _normal(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]", "9")


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a mention; a place at the text's or the last mention's edge gives no pattern there."""
    two = _normal(F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}]*$", 0))
    one = _normal(F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]*$", 1))
    then = _normal(F.regexp_extract(after, rf"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+)", 1))
    then2 = _normal(F.regexp_extract(after, rf"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+[{SPACE}]+[^{SPACE}]+)", 1))
    tidy = lambda c: F.regexp_replace(F.trim(c), rf"[{SPACE}]+", " ")
    return F.array_compact(
        F.array(
            F.when(two != "", F.concat(F.lit("L "), tidy(two))),
            F.when((one != "") & (then != ""), F.concat(F.lit("M "), one, F.lit(" _ "), then)),
            F.when(then2 != "", F.concat(F.lit("R "), tidy(then2))),
        )
    )


def learn(mentions: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (``kind``, ``pattern``) and trusted values (``kind``, ``value``) of the pattern-value graph.

    ``mentions`` has ``value``, ``patterns`` and ``seed``, the kind of the fixed format that it is, or NULL.
    """
    edges = mentions.select("value", "seed", F.explode("patterns").alias("pattern"))
    edges = kept(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    values = kept(edges.groupBy("value").agg(F.max("seed").alias("kind")).where("kind is not null"), "seeds")
    patterns = None
    for _ in range(rounds):
        told = edges.join(values, "value", "left")
        sums = told.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        each = sums.select("pattern", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in KINDS])).alias("s"))
        patterns = kept(each.select("pattern", "s.kind", (F.col("s.hits") / F.col("n")).alias("share"), "s.hits").where((F.col("share") >= trust) & (F.col("hits") >= support)), "patterns")
        votes = edges.where("seed is null").join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))).alias("score"))
        won = votes.where(F.col("score") >= trust).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        seeds = edges.groupBy("value").agg(F.max("seed").alias("kind")).where("kind is not null")
        values = kept(seeds.unionByName(won), "values")
    return patterns.select("kind", "pattern"), values.select("kind", "value")


def find(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end) in order of kind and start."""
    every = kept(stretches(docs), "stretches")
    kind_number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    base = every.where("hit is not null and kind <> 'mention'").where(_valid(F.col("kind"), F.col("hit"))).withColumn("rank", kind_number.cast("int"))
    base = kept(base.select("uid", "rank", "kind", "start", "end"), "base")
    mentions = every.where("kind = 'mention' and hit is not null").select(
        "uid", "start", "end", "hit", F.lower(F.regexp_replace("hit", r"[\x20().:-]", "")).alias("value"), _patterns(F.col("before"), F.coalesce("after", F.lit(""))).alias("patterns")
    )
    spans = base.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "kind")).alias("found"))
    touching = F.filter(F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    met = mentions.join(spans, "uid", "left").select("uid", "start", "end", "hit", "value", "patterns", touching.alias("touching"))
    met = kept(met.select("uid", "start", "end", "hit", "value", "patterns", (F.size("touching") > 0).alias("taken"), F.array_min(F.transform("touching", lambda s: s["kind"])).alias("seed")), "mentions")
    patterns, values = learn(met, rounds, trust, support)
    free = met.where(~F.col("taken")).select("uid", "start", "end", "hit", "value", F.explode("patterns").alias("pattern"))
    form = F.lit(False)
    for k in KINDS:
        form = form | ((F.col("kind") == k) & F.col("hit").rlike(FORMS[k]))
    new = free.join(patterns, "pattern").join(values, ["kind", "value"], "left_semi").where(form).withColumn("rank", kind_number.cast("int"))
    # A mention trusted as several kinds is given out as the first of them.
    new = new.groupBy("uid", "start", "end").agg(F.min(F.struct("rank", "kind")).alias("k")).select("uid", "k.rank", "k.kind", "start", "end")
    found = base.withColumn("fixed", F.lit(True)).unionByName(new.withColumn("fixed", F.lit(False)))
    listed = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "kind", "fixed"))).alias("all"))
    ids = every.where("kind = 'mention'").groupBy("uid").agg(F.first("doc_id").alias("doc_id"))
    shape = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return ids.join(listed, "uid", "left").select(
        "doc_id",
        F.coalesce(F.transform(F.filter("all", lambda s: s["fixed"]), shape), none).alias("base"),
        F.coalesce(F.transform("all", shape), none).alias("spans"),
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
