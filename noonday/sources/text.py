"""Records and settings out of text files: charsets, key-value lines, tables, free text, JSON, XML, fixed CSV.

A file's text is one value of a row and is taken apart inside that row wherever possible, so a listing with contents is
not shuffled until something is grouped per file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noonday.functions.dates import parse_datetime, parse_utc_offset, wall_clock
from noonday.functions.modes import mode_from_profile
from noonday.functions.numbers import leading_number, norm_pressure, pressure, safe_number, trimmed
from noonday.functions.plan import computed_once
from noonday.functions.settings import compact_key, is_setting_header, joined_range, ramp_rule, with_day_settings
from noonday.operators.cleaning import FIELD_RANGES, ranged
from noonday.operators.rollup import none_if_zero


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


# Line ends other than \n and \r: Java's ``$`` also stands before one that ends a text.
_OTHER_ENDS = "\x85\u2028\u2029"
_BLANK_ENDS = re.compile(rf"^\s+|\s+(?=[{_OTHER_ENDS}]?\Z)", re.ASCII)


def _stripped(text: str) -> str:
    """``strip`` for readers of whole texts in Python."""
    return _BLANK_ENDS.sub("", text) if text.endswith(tuple(_OTHER_ENDS)) else text.strip(" \t\n\v\f\r")


# --- charsets --------------------------------------------------------------------------------------------------

HEADER_BYTES = 4
# Printable ASCII, tabs and line ends stay, every other byte becomes a line break.
_PLAIN = bytes(b if 0x20 <= b <= 0x7E or b in b"\t\n\r" else 0x0A for b in range(256))
#: Files whose readings are Python texts at a time.
FILES_AT_ONCE = 64


def _readings_of(data: bytes | None) -> list[str]:
    if data is None:
        return []
    latin, plain = data.decode("latin-1"), data.translate(_PLAIN).decode("ascii")
    if data.isascii():
        utf8, utf8_tail = latin, latin[HEADER_BYTES:]
    else:
        utf8, utf8_tail = data.decode("utf-8", "replace"), data[HEADER_BYTES:].decode("utf-8", "replace")
    # the built-in decoder of Spark stops at damaged pairs
    wide = [data.decode("utf-16-le", "replace"), data.decode("utf-16-be", "replace")] if b"\0" in data else []
    every = dict.fromkeys((utf8, utf8_tail, latin, *wide, plain, plain[HEADER_BYTES:]))
    return [t for t in dict.fromkeys(_stripped(t.replace("\0", "\n")) for t in every) if t]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _readings(content: pa.Array) -> pa.Array:
    """Readings of each file, in one pass over its bytes."""
    parts, ends = [pa.array([], pa.string())], [0]
    for at in range(0, len(content), FILES_AT_ONCE):
        texts = []
        for data in content.slice(at, FILES_AT_ONCE).to_pylist():
            found = _readings_of(data)
            texts += found
            ends.append(ends[-1] + len(found))
        parts.append(pa.array(texts, pa.string()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))


def decode_variants(files: DataFrame, content: str = "content") -> DataFrame:
    """Distinct readings of each file, in order of preference: NUL becomes a line break, blank readings drop out.

    UTF-8 without and with a skipped header, Latin-1, UTF-16 LE and BE where there are NUL bytes, and printable ASCII
    without and with a skipped header.  Equal readings are dropped inside the row, keeping the first.
    """
    other = [c for c in files.columns if c != content]
    return files.select(*other, F.posexplode(_readings(F.col(content))).alias("variant", "text"))


def best_variant(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reading of each file with the most records; the first wins a tie."""
    best = F.min(F.struct((-F.col("n_records")).alias("neg"), "variant"))
    return counts.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.variant").alias("variant"), (-F.col("b.neg")).alias("n_records")
    )


# --- key-value text --------------------------------------------------------------------------------------------

# Fixed value: a key and value inside a line.
INLINE_PAIR = r"([A-Za-z][A-Za-z0-9_]{1,40})\s*[:=]\s*([^\r\n,;]+)"


def clean_text(text: Column | str) -> Column:
    """NUL to line break, everything else that is not printable ASCII, tab or line break taken out."""
    return F.regexp_replace(F.translate(_c(text), "\0", "\n"), r"[^\x09\x0A\x0D\x20-\x7E]", "")


def key_values(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Key-value rows of each file: lines first, then inline pairs; the last occurrence of a key wins.

    ``place`` is where the key first occurred, for reads that take the first key of a kind.
    """
    cleaned = files.select(*keys, clean_text(text).alias("__t"))
    lines = F.transform(F.split("__t", r"\r?\n"), strip)

    def split_line(line: Column) -> Column:
        key = strip(F.regexp_extract(line, r"^([^=:]*)[=:]", 1))
        value = strip(F.regexp_extract(line, r"(?s)^[^=:]*[=:](.*)$", 1))
        return F.when(line.rlike("[=:]") & (key != ""), F.struct(F.lit(0).alias("pass"), key.alias("key"), value.alias("value")))

    inline = F.arrays_zip(
        F.regexp_extract_all("__t", F.lit(INLINE_PAIR), 1).alias("key"),
        F.regexp_extract_all("__t", F.lit(INLINE_PAIR), 2).alias("value"),
    )
    second = F.transform(
        inline, lambda p: F.struct(F.lit(1).alias("pass"), strip(p["key"]).alias("key"), strip(p["value"]).alias("value"))
    )
    pairs = F.concat(F.array_compact(F.transform(lines, split_line)), F.filter(second, lambda p: p["value"] != ""))
    rows = cleaned.select(*keys, F.posexplode(pairs).alias("place", "p")).select(
        *keys, "place", F.col("p.key").alias("key"), F.col("p.value").alias("value")
    )
    return rows.groupBy(*keys, "key").agg(F.max_by("value", "place").alias("value"), F.min("place").alias("place"))


def value_maps(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-value rows of a file as maps: by exact key, by lower-case key, by squeezed key, and in file order.

    A value carries its number, so that no number is parsed again for every alias that might name it.
    """
    shapes = {"exact": "key", "lower": "lower", "compact": "compact"}
    read = pairs.withColumns({"number": safe_number("value"), "lower": F.lower("key"), "compact": compact_key(F.col("key"))})
    listed = read.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", "key", "value", "number", "lower", "compact"))).alias("entries")
    )
    values = F.arrays_zip("entries.value", "entries.number").cast("array<struct<value:string,number:double>>")

    def last_of_each(shape: str) -> Column:
        ordered = F.sort_array(
            F.transform("entries", lambda e: F.struct(e[shape].alias("k"), e["place"].alias("i"), F.struct(e["value"], e["number"]).alias("v")))
        )

        def as_map(pairs: Column) -> Column:
            # Equal keys stand next to each other in file order; the last of them stays.
            last = F.filter(pairs, lambda e, i: F.coalesce(F.get(pairs, i + 1)["k"] != e["k"], F.lit(True)))
            return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))

        return F.get(F.transform(F.array(ordered), as_map), F.lit(0))

    def by_key(shape: str) -> Column:
        # few files repeat a key in this shape; the others need no sort and no lambda, which Spark interprets
        names = F.col(f"entries.{shape}")
        return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, "__values")).otherwise(last_of_each(shape))

    valued = computed_once(listed.withColumn("__values", values))
    return valued.withColumns({name: by_key(shape) for name, shape in shapes.items()}).drop("__values")


def read_number(alias: str) -> Column:
    """Number under a key, by its exact spelling first and without case second."""
    hit = F.coalesce(F.try_element_at("exact", F.lit(alias)), F.try_element_at("lower", F.lit(alias.lower())))
    return hit["number"]


def first_match(pattern: str, value, avoid: str | None = None, entries: str = "entries") -> Column:
    """First usable number, in file order, among the keys that match a pattern."""

    def fits(e: Column) -> Column:
        hit = e["lower"].rlike(pattern)
        return hit if avoid is None else hit & ~e["lower"].rlike(avoid)

    values = F.transform(F.filter(entries, fits), lambda e: value(e["number"]))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def matched_entries(maps: DataFrame, pattern: str) -> DataFrame:
    """Maps with ``matched``, the entries whose key fits a pattern: what narrower patterns look through."""
    return computed_once(maps.withColumn("matched", F.filter("entries", lambda e: e["lower"].rlike(pattern))))


# Keys of daily records in order of preference, and patterns of measured pressures; each of these and every
# pattern of a leak names one of the measured quantities.
MEASURED = "leak|press|[ie]pap"
USAGE_KEYS = (
    "usagehours", "therapyhours", "hours", "hour", "timeused", "runtime", "secUsed", "secondsused", "minutesused",
)
AHI_KEYS = ("ahi", "avgahi", "residualahi", "ahi95")
RESIDUAL_KEYS = ("residualApneas", "residual_apneas", "residualAI", "residual_ahi", "apneaIndex", "AI", "cntAI")
CENTRAL_KEYS = ("centralApneas", "central_apneas", "centralAI", "CAI", "cntCAI")
RERA_KEYS = ("rera", "reraindex", "rera_index", "rerai", "cntRERA", "cnt_rera")
LEAK_KEYS = ("medleak", "medianleak", "avgleak", "averageleak", "meanleak")
PRESSURE_PATTERNS = {
    "pressure_avg": r"(?:avg|average|mean).*press|press.*(?:avg|average|mean)",
    "pressure_95": r"(?:95|p95).*press|press.*(?:95|p95)",
    "ipap_avg": r"(?:med|median|avg|average|mean).*ipap|ipap.*(?:med|median|avg|average|mean)",
    "ipap_95": r"(?:95|p95).*ipap|ipap.*(?:95|p95)",
    "epap_avg": r"(?:med|median|avg|average|mean).*epap|epap.*(?:med|median|avg|average|mean)",
    "epap_95": r"(?:95|p95).*epap|epap.*(?:95|p95)",
}


def _usage_hours() -> Column:
    tries = []
    for key in USAGE_KEYS:
        n = read_number(key)
        tries.append(n / 3600 if "sec" in key.lower() else n / 60 if "min" in key.lower() else n)
    return F.coalesce(*tries)


def _rate(aliases: Sequence[str], hours: Column) -> Column:
    """First number among the aliases; a counter becomes a rate when the hours are known."""
    tries = []
    for key in aliases:
        n = read_number(key)
        tries.append(F.when(hours > 0, n / hours).otherwise(n) if key.lower().startswith("cnt") else n)
    return F.coalesce(*tries)


def daily_records(maps: DataFrame) -> DataFrame:
    """Daily metrics and settings of each file out of its key-value maps; out-of-range values become NULL."""
    hours = F.col("usage_hours")
    oa, ca, h, ai = (read_number(k) for k in ("cntOAI", "cntCAI", "cntHI", "cntAI"))
    some = oa.isNotNull() | ca.isNotNull() | h.isNotNull()
    zero = F.lit(0.0)
    events = F.when(ai.isNotNull() & h.isNotNull(), ai + h).when(
        some, F.coalesce(oa, zero) + F.coalesce(ca, zero) + F.coalesce(h, zero)
    )
    named_ahi = F.coalesce(*[read_number(k) for k in AHI_KEYS])
    maximum = F.filter("matched", lambda e: e["lower"].rlike("leak") & e["lower"].rlike("max") & e["number"].isNotNull())
    out = matched_entries(maps, MEASURED).withColumn("usage_hours", _usage_hours()).withColumns(
        {
            "ahi": F.coalesce(named_ahi, F.when(hours > 0, events / hours)),
            "residual_apneas": _rate(RESIDUAL_KEYS, hours),
            "central_apneas": _rate(CENTRAL_KEYS, hours),
            "rera_index": _rate(RERA_KEYS, hours),
            "leak": first_match("leak", lambda v: v, avoid="max", entries="matched"),
            "leak_max": F.try_element_at(maximum, F.lit(-1))["number"],
            **{k: first_match(p, norm_pressure, entries="matched") for k, p in PRESSURE_PATTERNS.items()},
        }
    )
    fields = ["usage_hours", "ahi", "residual_apneas", "central_apneas", "rera_index", "leak", "leak_max", *PRESSURE_PATTERNS]
    return _day_rows(out, fields)


def _day_rows(out: DataFrame, fields: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """Metrics with the settings of their maps, which are left behind once they are read."""
    kept = [c for c in out.columns if c not in MAPS]
    return _with_settings(keep_signal(with_day_settings(out, "__settings", kept), fields, [*more, "__settings"]))


def _with_settings(records: DataFrame) -> DataFrame:
    """The snapshot as the record's settings columns: signature, label and machine."""
    named = {f"settings_{c}": F.col(f"__settings.{c}") for c in ("signature", "label", "machine")}
    return records.withColumns(named).drop("__settings")


def _leak_or_null(value: Column) -> Column:
    return ranged(value, (0, True, 500, True))


def counter_records(maps: DataFrame) -> DataFrame:
    """Daily metrics and settings of counter files: seconds used and event counters; nothing is made up from missing parts."""
    seconds = read_number("secUsed")
    start = read_number("secStart")
    hours = F.when(seconds.between(0, 24 * 3600), seconds / 3600)
    count = {k: read_number(k) for k in ("cntAHI", "cntOAI", "cntCAI", "cntAI", "cntHI", "cntRERA")}
    events = F.coalesce(
        count["cntAI"] + count["cntHI"], count["cntAHI"], count["cntOAI"] + count["cntCAI"] + count["cntHI"]
    )

    def per_hour(n: Column) -> Column:
        return F.when(F.col("usage_hours") > 0, n / F.col("usage_hours"))

    leak_ok = F.coalesce(*[F.when(n.between(0, 500), n) for n in (read_number(k) for k in LEAK_KEYS)])
    any_leak = first_match("leak", _leak_or_null, avoid="95|max", entries="matched")
    leak_95 = first_match("leak.*95|95.*leak", _leak_or_null, entries="matched")
    leak_max = first_match("leak.*max|max.*leak", _leak_or_null, entries="matched")
    out = matched_entries(maps, "leak").withColumn("usage_hours", hours).withColumns(
        {
            "session_start": F.when(start > 0, F.timestamp_seconds(F.floor(start))),
            "session_end": F.when((start > 0) & (seconds > 0), F.timestamp_seconds(F.floor(start + seconds))),
            "ahi": per_hour(events),
            "residual_apneas": per_hour(count["cntAI"]),
            "central_apneas": per_hour(count["cntCAI"]),
            "rera_index": per_hour(count["cntRERA"]),
            "leak": F.coalesce(leak_ok, any_leak),
            "leak_95": leak_95,
            "leak_max": leak_max,
        }
    )
    fields = ["usage_hours", "ahi", "residual_apneas", "central_apneas", "rera_index", "leak", "leak_95", "leak_max"]
    return _day_rows(out, fields, ["session_start", "session_end"])


# The columns of value_maps, and what matched_entries adds.
MAPS = ("entries", "exact", "lower", "compact", "matched")


def keep_signal(df: DataFrame, fields: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """File keys and metrics, out-of-range ones as NULL; rows without any metric drop out."""
    keys = [c for c in df.columns if c not in (*MAPS, *fields, *more)]
    once = computed_once(df.select(*keys, *more, *fields))
    return once.withColumns({f: ranged(f, FIELD_RANGES[f]) for f in fields}).where(
        F.coalesce(*[F.col(f) for f in fields]).isNotNull()
    )


def utc_offset_of(entries: str = "entries") -> Column:
    """UTC offset in minutes under any of the known key names, first in file order."""
    names = ("timezoneoffset", "utcoffset", "gmtoffset", "timezone")
    fits = F.filter(entries, lambda e: F.regexp_replace(F.lower(e["key"]), "[^a-z]", "").isin(*names))
    offsets = F.transform(fits, lambda e: parse_utc_offset(e["value"]))
    return F.try_element_at(F.filter(offsets, lambda o: o.isNotNull()), F.lit(1))


# Where the UTC offset of a card is looked for.
OFFSET_JSON_FAMILY = "resmed"
OFFSET_JSON_PATH = r"(?i)(?:^|/)settings/currentsettings\.json$"
OFFSET_TEXT_EXTENSION = r"(?i)\.(?:txt|csv|json|xml|log|cfg|ini|tgt)$"
OFFSET_TEXT_PATH = r"(?i)(?:^|/)(?:settings?|config|profile|profiles|identification)(?:/|$|[._-])"


def offset_candidates(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``card_id``, ``source``, ``priority``, ``file_id``, ``offset`` of every file that may tell a card's UTC offset.

    ``files``: card_id, family_id, file_id, path, size, text.  The settings JSON of its family comes first, then key-value
    texts on settings-like paths, empty ones and those over ``max_bytes`` left out.  Texts of other files are not parsed.
    """
    json = files.where((F.col("family_id") == OFFSET_JSON_FAMILY) & F.col("path").rlike(OFFSET_JSON_PATH))
    texts = files.where(F.col("path").rlike(OFFSET_TEXT_EXTENSION) & F.col("path").rlike(OFFSET_TEXT_PATH) & (F.col("size") > 0))
    if max_bytes is not None:
        texts = texts.where(F.col("size") <= max_bytes)
    keys = ["card_id", "file_id"]
    by_json = json_settings(json.select(*keys, "text"), keys).select(*keys, F.col("offset_minutes").alias("offset"))
    maps = value_maps(key_values(texts.select(*keys, "text"), keys), keys)
    by_text = maps.select(*keys, utc_offset_of().alias("offset"))
    found = [
        rows.select("card_id", F.lit(source).alias("source"), F.lit(n).alias("priority"), "file_id", "offset")
        for n, (source, rows) in enumerate((("json", by_json), ("text", by_text)), 1)
    ]
    return found[0].unionByName(found[1]).where("offset IS NOT NULL")


def source_offset(cards: DataFrame, candidates: DataFrame, default: Column | None = None) -> DataFrame:
    """UTC offset per card and the source that told it: the first by priority and file, else the caller's value.

    ``default`` is a column of ``cards`` (one row per card) or a constant.
    """
    best = candidates.groupBy("card_id").agg(F.min_by(F.struct("source", "offset"), F.struct("priority", "file_id")).alias("best"))
    own = default if default is not None else F.lit(None).cast("bigint")
    told = cards.withColumn("__own", own).join(best, "card_id", "left")
    return told.select(
        "card_id", F.coalesce("best.offset", "__own").alias("offset_minutes"),
        F.coalesce("best.source", F.when(F.col("__own").isNotNull(), "caller")).alias("source"),
    )


# --- tables and free text --------------------------------------------------------------------------------------

# Header patterns of the columns of a daily table; the first header that matches is used.
TABLE_ROLES = {
    "date": ("date|day", None),
    "usage_hours": ("usage|hours|therapy", None),
    "ahi": ("ahi", None),
    "residual_apneas": (r"residual|apnea\s*index|(?:^|[^a-z])ai(?:[^a-z]|$)", "cai|oai|uai|ahi"),
    "central_apneas": (r"central|(?:^|[^a-z])cai(?:[^a-z]|$)", None),
    "rera_index": (r"(?:^|[^a-z])rera(?:[^a-z]|$)|rera\s*index", None),
    "leak": ("leak", None),
    "leak_max": ("max.*leak|leak.*max", None),
    **{k: (p, None) for k, p in PRESSURE_PATTERNS.items()},
}


def table_records(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rows of tab- or comma-separated daily tables; column roles come from the header, rows without a date drop out.

    Settings columns are gathered into a map.  The header stays in the row while its lines are exploded: no join.
    """
    headed = _headed(files.select(*keys, _table_lines(text).alias("lines")).where(F.size("lines") >= 2)).where(F.col("__date") > 0)
    body = headed.withColumn("line", F.explode(F.slice("lines", 2, F.size("lines")))).withColumn(
        "cells", F.split("line", F.col("delimiter"))
    )
    read = F.transform("__settings", lambda e: F.struct(e["key"].alias("key"), strip(F.try_element_at("cells", e["at"])).alias("value")))
    return (
        computed_once(
            body.select(
                *keys, parse_datetime(F.coalesce(_cell("date"), F.lit(""))).alias("date"), *[c.alias(n) for n, c in _table_metrics().items()],
                F.filter(read, lambda e: F.coalesce(e["value"], F.lit("")) != "").alias("settings"),
            )
        ).where("date IS NOT NULL")
    )


def _table_lines(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)


def _headed(files: DataFrame) -> DataFrame:
    """Files with ``lines`` and what their first line tells: delimiter, place of each role, settings columns."""
    first = F.try_element_at("lines", F.lit(1))
    delimiter = F.when(F.contains(first, F.lit("\t")), "\t").otherwise(",")
    with_header = files.withColumn("delimiter", delimiter).withColumn(
        "header", F.transform(F.split(first, F.col("delimiter")), lambda h: F.lower(strip(h)))
    )

    def place(pattern: str, avoid: str | None) -> Column:
        def fits(h: Column) -> Column:
            return h.rlike(pattern) if avoid is None else h.rlike(pattern) & ~h.rlike(avoid)

        return F.array_position(F.transform("header", fits), F.lit(True)).cast("int")

    # what depends on the header alone is worked out once per file
    headed = F.filter(
        F.transform("header", lambda h, i: F.struct((i + 1).alias("at"), h.alias("key"))), lambda e: (e["key"] != "") & is_setting_header(e["key"])
    )
    return computed_once(
        with_header.withColumns({**{f"__{role}": place(*rule) for role, rule in TABLE_ROLES.items()}, "__settings": headed})
    )


def _cell(role: str) -> Column:
    at = F.col(f"__{role}")
    return F.when(at > 0, F.try_element_at("cells", F.greatest(at, F.lit(1))))


def _table_metrics() -> dict[str, Column]:
    """Number in each role's cell of a line, by role."""
    numbers = {role: safe_number(_cell(role)) for role in TABLE_ROLES if role != "date"}
    return {role: norm_pressure(n) if role in PRESSURE_PATTERNS else n for role, n in numbers.items()}


# Metric patterns of free-text lines, and the number behind a name.
_NUM = r"\D*(-?\d+(?:\.\d+)?)"
LINE_METRICS = {
    "usage_hours": r"(?i)(?:usage|therapy\s*hours|hours)" + _NUM,
    "ahi": r"(?i)ahi" + _NUM,
    "residual_apneas": r"(?i)(?:residual\s*apnea(?:s)?|residual\s*ahi|apnea\s*index|(?:^|[^a-z])ai(?:[^a-z]|$))" + _NUM,
    "central_apneas": r"(?i)(?:central\s*apnea(?:s)?|central\s*index|(?:^|[^a-z])cai(?:[^a-z]|$))" + _NUM,
    "rera_index": r"(?i)(?:rera(?:\s*index)?)(?:\s*[:=]|\D)*(-?\d+(?:\.\d+)?)",
    "leak": r"(?i)leak(?:age)?" + _NUM,
    "leak_max": r"(?i)(?:max(?:imum)?\s*leak(?:age)?|leak(?:age)?\s*max)" + _NUM,
    "pressure_avg": r"(?i)(?:avg|average|mean)\s*(?:mask\s*)?pressure" + _NUM,
    "pressure_95": r"(?i)(?:95(?:th|%)|p95)\s*(?:mask\s*)?pressure" + _NUM,
    "ipap_avg": r"(?i)(?:avg|average|mean|median|med)\s*ipap" + _NUM,
    "ipap_95": r"(?i)(?:95(?:th|%)|p95)\s*ipap" + _NUM,
    "epap_avg": r"(?i)(?:avg|average|mean|median|med)\s*epap" + _NUM,
    "epap_95": r"(?i)(?:95(?:th|%)|p95)\s*epap" + _NUM,
}


def line_records(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One record per line that carries a date; metrics by pattern."""
    lines = files.select(*keys, F.explode(F.split(_c(text), r"\r?\n")).alias("line")).withColumn("line", strip("line"))
    return (
        computed_once(lines.where("line <> ''").withColumn("date", parse_datetime("line")))
        .where("date IS NOT NULL")
        .select(*keys, "date", *[c.alias(m) for m, c in _line_metrics().items()])
    )


def _line_metrics() -> dict[str, Column]:
    """Number behind each metric's name in a line, by metric."""
    numbers = {m: F.regexp_extract("line", pattern, 1).try_cast("double") for m, pattern in LINE_METRICS.items()}
    return {m: norm_pressure(n) if m in PRESSURE_PATTERNS else n for m, n in numbers.items()}


# Fixed value: what every date of parse_datetime has, a sign between two digits.
DATE_SIGN = r"\d[-/]\d"


_DATE_SIGN = re.compile(DATE_SIGN, re.ASCII)
# Java's dot stops at more line ends than Python's.
_ROLES = {
    role: tuple(p and re.compile(p.replace(".*", rf"[^\n\r{_OTHER_ENDS}]*"), re.ASCII) for p in rule) for role, rule in TABLE_ROLES.items()
}
_WORDS = tuple((re.compile(pattern, re.ASCII), m in PRESSURE_PATTERNS) for m, pattern in LINE_METRICS.items())


def _header_places(first: str) -> tuple[str, int, tuple[tuple[int, int, bool], ...]]:
    """What a header line tells: delimiter, place of the date (-1 for none), and of each metric that it has: the metric's place
    in a record, its place in a line, and whether it is a pressure.
    """
    delimiter = "\t" if "\t" in first else ","
    header = [_stripped(h).lower() for h in first.split(delimiter)]
    places = {
        role: next((i for i, h in enumerate(header) if fits.search(h) and not (avoid and avoid.search(h))), -1)
        for role, (fits, avoid) in _ROLES.items()
    }
    return delimiter, places["date"], tuple((n, places[m], m in PRESSURE_PATTERNS) for n, m in enumerate(LINE_METRICS, 1) if places[m] >= 0)


def _short_kept(read, chars: int, texts: int):
    """``read`` that keeps what the latest short texts gave: headers, days and numbers come again from file to file."""
    kept = lru_cache(texts)(read)
    return lambda text: kept(text) if len(text) <= chars else read(text)


_places_of, _clock_of, _number_of = _short_kept(_header_places, 4_096, 1_024), _short_kept(wall_clock, 32, 16_384), _short_kept(leading_number, 32, 16_384)


def _text_records(text: str) -> list[list]:
    """Time and metrics of each record of a text: of its table if a line of that has a date, else of its lines."""
    lines = text.replace("\r\n", "\n").split("\n")
    filled = [x for x in lines if x.strip(" ")]
    delimiter, date, places = _places_of(filled[0]) if filled else ("", -1, ())
    rows = []
    for line in filled[1:] if date >= 0 else ():
        cells = line.split(delimiter)
        clock = _clock_of(cells[date]) if date < len(cells) else None
        if clock:
            row = [clock] + [None] * len(LINE_METRICS)
            for n, at, is_pressure in places:
                if at < len(cells):
                    row[n] = pressure(_number_of(cells[at])) if is_pressure else _number_of(cells[at])
            rows.append(row)
    if rows:
        return rows
    for line in map(_stripped, filter(_DATE_SIGN.search, lines)):
        clock = wall_clock(line)
        if clock:
            numbers = [(found and float(found[1]), is_pressure) for found, is_pressure in ((p.search(line), x) for p, x in _WORDS)]
            rows.append([clock, *[pressure(n) if is_pressure else n for n, is_pressure in numbers]])
    return rows


_RECORD = pa.struct([("clock", pa.string()), *[(m, pa.float64()) for m in LINE_METRICS]])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("clock", T.StringType()), *[T.StructField(m, T.DoubleType()) for m in LINE_METRICS]])))
def _records(texts: pa.Array) -> pa.Array:
    rows, ends = [], [0]
    for text in texts.to_pylist():
        rows += _text_records(text or "")
        ends.append(len(rows))
    columns = zip(*rows, strict=True) if rows else [()] * _RECORD.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], fields=list(_RECORD))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def any_records(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Table rows as ``table_records`` reads them, or records of ``line_records`` for the files that are no table.

    A file is a table where a line below its header has a date in the date's column.  A text is taken apart in one pass in
    Python, and what a header tells is kept for the next file with the same one.  Keys stay plain columns, so files that are
    dealt by key stay so and no later group of that key moves rows again.
    """
    # a reading in the wrong charset may have a line for each character: only texts that can hold a date are taken apart
    dateable = files.where(F.col(text).rlike(DATE_SIGN))
    rows = dateable.select(*keys, F.explode(_records(F.make_valid_utf8(F.col(text)))).alias("__r"))
    return rows.select(*keys, F.col("__r.clock").cast("timestamp").alias("date"), *[F.col(f"__r.{m}").alias(m) for m in LINE_METRICS])


# --- JSON settings ---------------------------------------------------------------------------------------------

# Names of the numbers of a therapy profile, each with its aliases in order of preference.
PROFILE_NUMBERS = {
    "set_pressure": ("SetPressure",),
    "min_pressure": ("MinPressure",),
    "max_pressure": ("MaxPressure",),
    "epap": ("EPAP", "Epap"),
    "ipap": ("IPAP", "Ipap"),
    "min_epap": ("MinEPAP", "MinEpap"),
    "max_epap": ("MaxEPAP", "MaxEpap"),
    "min_ipap": ("MinIPAP", "MinIpap"),
    "max_ipap": ("MaxIPAP", "MaxIpap"),
    "support": ("PressureSupport", "PS", "Ps"),
    "min_support": ("MinPressureSupport", "MinPS"),
    "max_support": ("MaxPressureSupport", "MaxPS"),
    "rate": ("BackupRate", "RespiratoryRate", "RR"),
    "volume": (
        "TargetVt", "TargetVT", "TgtVt", "TgtVT", "SetVt", "SetVT", "TidalVolume", "TargetTidalVolume", "TidalVolumeTarget",
    ),
    "ramp_enable": ("RampEnable", "RampEnabled"),
    "ramp_time": ("RampTime", "RampTimeMinutes"),
    "ramp_pressure": ("RampPressure", "StartPressure", "RampStartPressure", "StartPress"),
}
# A profile is read as it stands, so names that differ in case only stay apart.
SETTINGS_JSON = (
    "FlowGenerator STRUCT<SettingProfiles STRUCT<ActiveProfiles STRUCT<TherapyProfile STRING>, "
    "TherapyProfiles MAP<STRING, MAP<STRING, STRING>>, "
    "FeatureProfiles STRUCT<TimeZoneFeature STRUCT<TimeZoneOffset STRING>, "
    "AutoRampFeature STRUCT<RampEnable STRING, RampTime DOUBLE>, "
    "EprFeature STRUCT<EprEnable STRING, EprPressure DOUBLE, EprType STRING>>>>"
)


def json_settings(files: DataFrame, keys: Sequence[str], text: str = "text", device: Column | None = None) -> DataFrame:
    """Machine settings from nested JSON: the active profile, else the first one that names a mode."""
    root = F.from_json(_c(text), SETTINGS_JSON)
    # Each text is parsed once: the tests below would otherwise be pushed beneath the parsing, with copies of it.
    parsed = computed_once(files.select(*keys, root["FlowGenerator"]["SettingProfiles"].alias("s")))
    profiles = parsed.where("s IS NOT NULL AND s.TherapyProfiles IS NOT NULL")
    active = F.col("s.ActiveProfiles.TherapyProfile")
    first = F.try_element_at(
        F.filter(F.map_entries("s.TherapyProfiles"), lambda e: F.try_element_at(e["value"], F.lit("TherapyMode")).isNotNull()), F.lit(1)
    )
    own = F.try_element_at("s.TherapyProfiles", active)
    chosen = computed_once(
        profiles.select(
            *keys, "s",
            F.when(own.isNotNull(), active).otherwise(first["key"]).alias("profile_name"),
            F.coalesce(own, first["value"]).alias("p"),
        )
    ).where("p IS NOT NULL")
    field = lambda name: F.try_element_at("p", F.lit(name))
    chosen = chosen.withColumns(
        {
            "therapy_mode": field("TherapyMode"),
            **{name: F.coalesce(*[field(x).try_cast("double") for x in aliases]) for name, aliases in PROFILE_NUMBERS.items()},
        }
    )
    device_text = device if device is not None else F.lit(None).cast("string")
    moded = chosen.withColumn("base_mode", mode_from_profile("therapy_mode", "profile_name", device_text))

    def cm(value: Column) -> Column:
        return F.when(value.between(0, 80), F.concat(trimmed(value, 2), F.lit(" cmH2O")))

    labelled = F.concat_ws(" ", "profile_name", "therapy_mode", device_text).rlike(r"(?i)\bvauto\b")
    bilevel, auto, fixed = (F.col("base_mode") == m for m in ("BiPAP", "APAP", "CPAP"))
    vauto = bilevel & labelled
    e_lo, e_hi, i_lo, i_hi = cm(F.col("min_epap")), cm(F.col("max_epap")), cm(F.col("min_ipap")), cm(F.col("max_ipap"))
    auto_bilevel = bilevel & (vauto | e_lo.isNotNull() | i_hi.isNotNull())
    support = F.concat(F.lit("PS: "), F.coalesce(cm(F.col("support")),
                                                 joined_range(cm(F.col("min_support")), cm(F.col("max_support")))))
    ramp = F.col("s.FeatureProfiles.AutoRampFeature")
    toggle = F.when(F.lower(ramp["RampEnable"]) == "on", 1).when(F.lower(ramp["RampEnable"]) == "off", 0).otherwise(
        F.coalesce(ramp["RampEnable"].try_cast("int"), F.when(ramp["RampEnable"].isNull(), F.col("ramp_enable").cast("int")))
    )
    ramp_time, ramp_pressure = ramp_rule(toggle, F.coalesce(ramp["RampTime"], F.col("ramp_time")), F.col("ramp_pressure"))
    epr = F.col("s.FeatureProfiles.EprFeature")
    epr_level = F.when(epr["EprPressure"] > 0, F.concat(F.lit(" "), trimmed(epr["EprPressure"], 2))).otherwise("")
    epr_type = F.when(F.lower(epr["EprType"]) == "fulltime", " (full time)").when(
        F.lower(epr["EprType"]) == "ramponly", " (ramp only)"
    ).otherwise("")
    epr_text = F.when(F.lower(epr["EprEnable"]) == "off", "EPR: Off").when(
        F.lower(epr["EprEnable"]) == "on", F.concat(F.lit("EPR: On"), epr_level, epr_type)
    )
    rate, volume = F.col("rate"), F.col("volume")
    ml = F.when(volume <= 5, volume * 1000).otherwise(volume)
    return moded.select(
        *keys,
        F.when(vauto, "VAuto").otherwise(F.col("base_mode")).alias("mode"),
        F.when(fixed, F.concat(F.lit("Fixed "), cm(F.col("set_pressure")))).alias("pressure"),
        F.when(auto, cm(F.col("min_pressure"))).when(auto_bilevel, F.coalesce(e_lo, i_lo)).alias("pressure_min"),
        F.when(auto, cm(F.col("max_pressure"))).when(auto_bilevel, F.coalesce(i_hi, e_hi)).alias("pressure_max"),
        (auto | auto_bilevel).alias("pressure_auto"),
        F.when(bilevel, F.coalesce(cm(F.col("epap")), joined_range(e_lo, e_hi))).alias("epap"),
        F.when(
            bilevel,
            F.coalesce(
                cm(F.col("ipap")), F.concat(i_lo, F.lit("-"), i_hi),
                F.when(e_lo.isNotNull() & F.col("support").isNotNull(), i_hi), i_lo, i_hi,
            ),
        ).alias("ipap"),
        F.when(bilevel & (rate >= 0), F.concat(trimmed(rate, 2), F.lit(" bpm"))).alias("respiratory_rate"),
        F.when(bilevel & ml.between(20, 5000), F.concat(trimmed(ml, 1), F.lit(" mL"))).alias("tidal_volume"),
        F.when(bilevel, support).otherwise(epr_text).alias("pressure_relief"),
        ramp_time.alias("ramp_time"),
        ramp_pressure.alias("ramp_pressure"),
        parse_utc_offset("s.FeatureProfiles.TimeZoneFeature.TimeZoneOffset").alias("offset_minutes"),
    )


# --- XML events ------------------------------------------------------------------------------------------------

# Respiratory event codes.
XML_EVENT_CODES = {
    101: "obstructive_apneas", 102: "central_apneas", 111: "obstructive_hypopneas", 112: "central_hypopneas", 121: "reras",
}


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, wherever it stands in the tag."""
    return F.regexp_extract(tag, rf'(?i)\b{name}="([^"]*)"', 1)


def _times(codes: str, code: int) -> Column:
    return F.size(F.filter(codes, lambda c: c == code)).cast("bigint")


def xml_event_counts(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Event tags counted by code."""
    tags = F.regexp_extract_all(_c(text), F.lit(r"(?i)<RespEvent\b[^>]*/?>"), 0)
    codes = F.transform(tags, lambda t: attribute(t, "RespEventID").try_cast("int"))
    counted = files.select(*keys, codes.alias("codes"))
    return counted.select(
        *keys,
        *[_times("codes", code).alias(name) for code, name in XML_EVENT_CODES.items()],
    )


def xml_parameters(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Last value of each parameter in the settings events of a file."""
    tags = files.select(*keys, F.posexplode(F.regexp_extract_all(_c(text), F.lit(r"(?i)<DeviceEvent\b[^>]*>"), 0)).alias("i", "tag"))
    number = lambda name: attribute(F.col("tag"), name).try_cast("bigint")
    rows = tags.select(
        *keys, "i", number("DeviceEventID").alias("event"), number("ParameterID").alias("parameter"), number("NewValue").alias("value")
    ).where("event = 0 AND parameter IS NOT NULL AND value IS NOT NULL")
    return rows.groupBy(*keys, "parameter").agg(F.max_by("value", "i").alias("value"))


def event_codes(files: DataFrame, keys: Sequence[str], codes: Sequence[int], text: str = "text") -> DataFrame:
    """Number of ``ID=n`` events with one of the codes; NULL for none."""
    ids = F.regexp_extract_all(_c(text), F.lit(r"(?i)ID\s*=\s*(\d+)"), 1)
    hits = F.size(F.filter(ids, lambda i: i.try_cast("int").isin(*codes)))
    return files.select(*keys, none_if_zero(hits).alias("n_events"))


# --- fixed-position CSV ----------------------------------------------------------------------------------------

CSV_FIELDS = 13


def positional_sessions(files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Sessions from comma-separated lines without a header; the mode by code, else by the spread of the pressures."""
    lines = files.select(*keys, F.explode(F.split(_c(text), r"\r?\n")).alias("line")).withColumn("f", F.split(strip("line"), ","))

    def number(i: int) -> Column:
        return F.try_element_at("f", F.lit(i + 1)).try_cast("double")

    start, end, high, low, code = (number(i) for i in (1, 2, 3, 4, 12))
    ident = strip(F.col("f")[0])
    mode = F.when(code == 1, "CPAP").when(code.isin(2, 3, 4), "APAP").when(F.abs(high - low) > 0.05, "APAP").otherwise("CPAP")
    return (
        lines.where(F.size("f") >= CSV_FIELDS)
        .withColumns({"start_ms": start, "end_ms": end, "max_pressure": high, "min_pressure": low, "mode": mode, "ident": ident})
        .where((F.col("start_ms") > 0) & (F.col("end_ms") > F.col("start_ms")))
        .select(
            *keys,
            F.when(F.col("ident") != "", F.col("ident")).otherwise(F.col("start_ms").cast("bigint").cast("string")).alias("session_id"),
            F.timestamp_millis(F.col("start_ms").cast("bigint")).alias("start_ts"),
            F.timestamp_millis(F.col("end_ms").cast("bigint")).alias("end_ts"),
            "max_pressure", "min_pressure", "mode",
        )
    )


# --- content sniffing ------------------------------------------------------------------------------------------


def sniff_family(name: Column | str, size: Column | str, head: Column | str) -> Column:
    """Family told by the first bytes of a small file: header words, a record layout that adds up, a product name."""
    ext = F.lower(F.regexp_extract(_c(name), r"\.([^./]*)$", 1))
    hexed = F.hex(F.substring(_c(head), 1, 12))

    def byte(i: int) -> Column:
        return F.conv(F.substring(hexed, i * 2 + 1, 2), 16, 10).cast("int")

    records = byte(2) * 256 + byte(1)
    plausible = (
        (records > 0) & (records * 11 + 3 <= _c(size)) & byte(7).between(1, 12) & byte(8).between(1, 31)
        & (byte(9) <= 23) & (byte(10) <= 59) & (byte(11) <= 59)
    )
    text = F.lower(F.decode(_c(head), "ISO-8859-1"))
    first_line = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    upper = F.upper(text)
    return (
        F.when((ext == "dat") & (F.length(hexed) >= 24) & (_c(size) >= 14) & plausible, "md300w1")
        .when(
            (ext == "csv") & first_line.contains("timestamp")
            & (first_line.contains("inclination") | first_line.contains("orientation") | first_line.contains("movement")),
            "somnopose",
        )
        .when((ext == "fph") & upper.contains("SLEEPSTYLE"), "sleepstyle")
        .when((ext == "fph") & upper.rlike(r"\bICON\b"), "icon")
    )
