"""Queries: file catalogue, device families, recent windows and candidate selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from noonday.functions import family_rules as fr
from noonday.functions.numbers import bytes_label
from noonday.operators import catalogue as c
from noonday.plans import adapters as a
from noonday.plans.adapters import FILES, with_views
from noonday.plans.registry import query


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _date(path: str, pattern: str, order: tuple[int, int, int] = (1, 2, 3)) -> str:
    y, m, d = (f"regexp_extract({path}, {_text(pattern)}, {i})" for i in order)
    return f"CAST(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d') AS DATE)"


_P = "path"
CAT = f"""
raw_cat AS (
  SELECT file_id, card_id, replace(path, '\\', '/') AS path, size, modified_at,
    regexp_matches(replace(path, '\\', '/'), {_text(fr.IGNORED_SEGMENT)}) AS ignored FROM files),
cat AS (
  SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base_name, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext,
    CASE WHEN regexp_matches(path, {_text(c.RECORD_PATH)}) THEN {_date(_P, c.RECORD_PATH)}
      ELSE coalesce({_date(_P, c.SEPARATED_PATH)}, {_date(_P, c.COMPACT_PATH)}) END AS window_date,
    coalesce({_date(_P, c.RECORD_PATH)}, {_date(_P, c.COMPACT_PATH)}, {_date(_P, c.SEPARATED_PATH)},
      {_date("replace(path, '_', '/')", c.ANY_DATE)}, {_date("replace(path, '_', '/')", c.ANY_US_DATE, (3, 1, 2))}) AS record_date
  FROM raw_cat)
"""

RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_text(f)}, {_text('(?i)' + p)}, {w})" for i, f, p, w in fr.scoring_rules()
) + ") AS t(rule_id, family_id, pattern, weight))"
FAMILY_TABLE = "families AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_text(f.id)}, {_text(f.label)}, {str(f.supported).lower()}, {_text(fr.any_of(f.signature))}, "
    f"{_text(fr.any_of(f.signature + f.priority))})"
    for f in fr.FAMILIES
) + ") AS t(family_id, label, supported, signature, candidate))"

SCORES = """
hits AS (
  SELECT DISTINCT f.card_id, r.rule_id, r.family_id, r.weight FROM src f JOIN rules r ON regexp_matches(f.path, r.pattern)),
stems AS (
  SELECT card_id, regexp_extract(lower(path), '^(.*)\\.([^./]+)$', 1) AS stem,
    bool_or(ends_with(lower(path), '.usr')) AS u, bool_or(ends_with(lower(path), '.idx')) AS i, bool_or(ends_with(lower(path), '.000')) AS z
  FROM src WHERE regexp_matches(lower(path), '\\.(?:usr|idx|[0-9]{3})$') GROUP BY ALL),
flags AS (
  SELECT card_id, bool_or(u AND i AND z) AS has_bundle, bool_or(u) AS has_usr, bool_or(i) AND NOT bool_or(u) AS index_only
  FROM stems GROUP BY card_id),
scores AS (
  SELECT h.card_id, h.family_id, CAST(sum(weight) + CASE WHEN h.family_id = 'bmc' AND any_value(has_bundle) THEN 10
      WHEN h.family_id = 'bmc' AND any_value(has_usr) THEN 4 WHEN h.family_id = 'bmcg3x' THEN 8 ELSE 0 END AS BIGINT) AS score
  FROM hits h LEFT JOIN flags USING (card_id) WHERE h.family_id <> 'bmcg3x' OR coalesce(index_only, false)
  GROUP BY h.card_id, h.family_id),
ranked AS (
  SELECT s.*, label, supported, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, label) AS rank
  FROM scores s JOIN families USING (family_id))
"""
ALL_FILES = "src AS (SELECT * FROM cat)"
KEPT_FILES = "src AS (SELECT * FROM cat WHERE NOT ignored)"


def cat(spark, sf):
    return c.catalogue(a.files(spark, sf))


@query(
    "scan_files",
    with_views(FILES, CAT, body="""
SELECT card_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, max(modified_at) AS newest, min(path) AS first_path
FROM cat GROUP BY card_id"""),
    times="newest",
)
def scan_files(spark, sf):
    """Listing of every card from metadata alone (the content column is never read)."""
    return cat(spark, sf).groupBy("card_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.max("modified_at").alias("newest"),
        F.min("path").alias("first_path"),
    )


@query(
    "ignore_paths",
    with_views(FILES, CAT, body="SELECT file_id, path, ignored FROM cat"),
)
def ignore_paths(spark, sf):
    return a.files(spark, sf).select("file_id", c.slashes("path").alias("path"), c.is_ignored("path").alias("ignored"))


@query("path_parts", with_views(FILES, CAT, body="SELECT file_id, path, base_name, ext FROM cat"))
def path_parts(spark, sf):
    return cat(spark, sf).select("file_id", "path", "base_name", "ext")


@query(
    "path_date",
    with_views(FILES, CAT, body="SELECT file_id, record_date, window_date FROM cat"),
    days="record_date window_date",
)
def path_date(spark, sf):
    return a.files(spark, sf).select(
        "file_id", c.record_date("path").alias("record_date"), c.window_date("path").alias("window_date")
    )


@query(
    "dated_leaf_dir",
    with_views(FILES, CAT, f"""
dirs AS (SELECT file_id, regexp_replace(path, '/+[^/]*$', '') AS dir FROM cat)""", body=f"""
SELECT file_id, CASE WHEN regexp_matches(dir, {_text(c.RECORD_LEAF)}) THEN {_date("dir", c.RECORD_LEAF)}
  ELSE coalesce({_date("dir", c.SEPARATED_LEAF)}, {_date("dir", c.COMPACT_LEAF)}) END AS leaf_date FROM dirs"""),
    days="leaf_date",
)
def dated_leaf_dir(spark, sf):
    folder = F.regexp_replace(c.slashes("path"), "/+[^/]*$", "")
    return a.files(spark, sf).select("file_id", c.leaf_date(folder).alias("leaf_date"))


_KEEP_FAMILY = " ".join(
    f"WHEN {_text(name)} THEN regexp_matches(lower(path), {_text(fr.any_of(p))})" for name, p in fr.KEEP_BY_FAMILY.items()
)
KEEP_SQL = f"""
(coalesce(CASE likely_family {_KEEP_FAMILY} END, false)
  OR {" OR ".join(f"regexp_matches(lower(path), {_text(p)})" for p in fr.KEEP_ALWAYS)}
  OR (regexp_matches(lower(path), {_text(fr.KEEP_DATA_EXTENSION)})
      AND regexp_matches(lower(path), {_text(fr.KEEP_DATA_WORD)}))
  OR regexp_matches(lower(path), {_text(fr.KEEP_INFO_NAME)}))"""

LIKELY = """
likely AS (
  SELECT c.card_id, CASE WHEN coalesce(has_bundle, false) THEN 'bmc' WHEN c.folders THEN 'resvent' ELSE r.family_id END AS likely_family
  FROM (SELECT card_id, bool_or(regexp_matches(path, '(?i)(?:^|/)(?:therapy/)?(?:record|config)/')) AS folders
        FROM src GROUP BY card_id) c
  LEFT JOIN flags USING (card_id) LEFT JOIN (SELECT card_id, family_id FROM ranked WHERE rank = 1) r USING (card_id))"""

WINDOWED = f"""
facts AS (
  SELECT card_id, max(window_date) FILTER (NOT ignored) AS latest, count(window_date) FILTER (NOT ignored) AS n_dated,
    count(*) FILTER (NOT ignored) AS n_rel FROM cat GROUP BY card_id),
marked AS (
  SELECT cat.*, f.latest, f.n_dated, f.n_rel, likely_family, f.latest - 90 AS w0,
    coalesce(NOT ignored AND CASE WHEN window_date IS NOT NULL THEN window_date >= f.latest - 90 AND window_date <= f.latest
      ELSE {KEEP_SQL} END, false) AS first_choice
  FROM cat JOIN facts f USING (card_id) LEFT JOIN likely USING (card_id)),
flagged AS (
  SELECT *, CASE WHEN likely_family IS NULL AND n_dated > 0 AND n_dated / greatest(1, n_rel) < 0.1 THEN true
    WHEN n_dated = 0 OR NOT bool_or(first_choice) OVER (PARTITION BY card_id) THEN NOT ignored ELSE first_choice END AS kept
  FROM marked)"""
WINDOW_VIEWS = (FILES, CAT, RULES, FAMILY_TABLE, KEPT_FILES, SCORES, LIKELY, WINDOWED)


@query(
    "recent_window_files",
    with_views(*WINDOW_VIEWS, body="SELECT file_id, kept FROM flagged"),
)
def recent_window_files(spark, sf):
    return c.recent_files(a.files(spark, sf)).select("file_id", "kept")


@query(
    "recent_window_summary",
    with_views(*WINDOW_VIEWS, body="""
SELECT card_id, count(*) AS original_count, count(*) FILTER (NOT kept) AS dropped_count,
  CAST(coalesce(sum(size) FILTER (NOT kept), 0) AS BIGINT) AS dropped_bytes, max(latest) AS latest_date,
  coalesce(bool_or(NOT ignored AND window_date < w0), false) AS has_older FROM flagged GROUP BY card_id"""),
    days="latest_date",
)
def recent_window_summary(spark, sf):
    return c.window_summary(c.recent_files(a.files(spark, sf)))


@query(
    "keep_undated",
    with_views(FILES, CAT, RULES, FAMILY_TABLE, KEPT_FILES, SCORES, LIKELY, body=f"""
SELECT file_id, likely_family, {KEEP_SQL} AS keep FROM cat LEFT JOIN likely USING (card_id)
WHERE window_date IS NULL AND NOT ignored"""),
)
def keep_undated(spark, sf):
    files = cat(spark, sf).where(~c.is_ignored("path"))
    guess = c.likely_family(files)
    undated = files.where(c.window_date("path").isNull()).join(guess, "card_id", "left")
    return undated.select(
        "file_id", "likely_family",
        c.keeps_undated(F.col("path"), F.col("size"), F.col("likely_family")).alias("keep"),
    )


@query(
    "dated_targets_window",
    with_views(FILES, CAT, body="""
, dirs AS (SELECT DISTINCT card_id, window_date AS folder_date FROM cat WHERE window_date IS NOT NULL),
m AS (SELECT card_id, max(folder_date) AS latest_date FROM dirs GROUP BY card_id)
SELECT d.card_id, d.folder_date, m.latest_date, d.folder_date < DATE '1999-01-01' - 181 OR d.folder_date >= DATE '1999-01-01' AS outside_now
FROM dirs d JOIN m USING (card_id) WHERE d.folder_date > m.latest_date - 181"""),
    days="folder_date latest_date",
)
def dated_targets_window(spark, sf):
    folders = (
        cat(spark, sf).select("card_id", c.window_date("path").alias("folder_date"))
        .where("folder_date IS NOT NULL").distinct()
    )
    path = F.concat(F.lit("DATALOG/"), F.date_format("folder_date", "yyyyMMdd"))
    return c.recent_folders(folders, 181).withColumn(
        "outside_now", c.is_outside_now(path, 181, F.lit("1999-01-01").cast("date"))
    )


_POINTS = f"""
(coalesce(CASE WHEN record_date >= latest + 1 - 91 AND record_date < latest + 1 THEN 120
   WHEN abs(date_diff('day', record_date, latest + 1)) <= 365
   THEN greatest(0, 45 - abs(date_diff('day', record_date, latest + 1)) // 10) ELSE 0 END, 0)
 + CASE WHEN regexp_matches(base_name, '(?i)^stat\\d{{0,4}}(?:\\..*)?$') THEN 95 ELSE 0 END
 + CASE WHEN regexp_matches(base_name, '(?i)^ev\\d{{0,4}}(?:\\..*)?$') THEN 70 ELSE 0 END
 + CASE WHEN regexp_matches(base_name, '(?i)^p\\d{{2}}_\\d+(?:\\..*)?$') THEN 55 ELSE 0 END
 + CASE WHEN regexp_matches(base_name, '(?i)(?:summary|detail|session|usage|compliance|result)') THEN 35 ELSE 0 END
 + CASE WHEN regexp_matches(path, '(?i)(?:record|therapy|datalog|p-series)') THEN 25 ELSE 0 END
 + CASE WHEN family_id IS NULL THEN 0 ELSE
   {" + ".join(f"35 * CAST(regexp_matches(path, {_text('(?i)' + p)}) AS INTEGER)" for p in fr.BASE_PRIORITY)}
   + CASE family_id {" ".join(
       f"WHEN {_text(f.id)} THEN " + " + ".join(
           f"35 * CAST(regexp_matches(path, {_text('(?i)' + p)}) AS INTEGER)" for p in f.priority)
       for f in fr.FAMILIES)} ELSE 0 END END
 + CASE WHEN ext IN {c.TEXT_EXTENSIONS} THEN 20 WHEN ext IN {c.BINARY_EXTENSIONS} THEN 14 WHEN ext = '' THEN 6 ELSE 0 END
 + CASE WHEN size > 0 AND size <= 512000 THEN 18 WHEN size <= 2000000 THEN 12 WHEN size <= 8000000 THEN 6 ELSE 0 END)"""


@query(
    "candidate_score_topk",
    with_views(FILES, CAT, RULES, FAMILY_TABLE, ALL_FILES, SCORES, body=f"""
, best AS (SELECT card_id, family_id FROM ranked WHERE rank = 1),
latest AS (SELECT card_id, max(record_date) AS latest FROM cat GROUP BY card_id),
scored AS (
  SELECT cat.*, {_POINTS} AS score, coalesce(family_id = 'resmed' AND regexp_matches(path, {_text(fr.any_of(c.PINNED))}), false) AS pin
  FROM cat JOIN latest USING (card_id) LEFT JOIN best USING (card_id)),
candidates AS (SELECT *, greatest(coalesce(size, 0), 0) AS bytes FROM scored WHERE pin OR score > 0),
placed AS (
  SELECT *, CASE WHEN pin AND row_number() OVER w <= {c.MAX_FILES} AND sum(bytes) OVER w <= {c.MAX_BYTES} THEN 0 WHEN score > 0 THEN 1 ELSE 2 END AS turn
  FROM candidates WINDOW w AS (PARTITION BY card_id, pin ORDER BY path, file_id NULLS FIRST, size NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT card_id, file_id, path, size, CAST(score AS BIGINT) AS score, pin AS pinned,
  turn = 0 OR (turn = 1 AND row_number() OVER w <= {c.MAX_FILES} AND sum(bytes) OVER w <= {c.MAX_BYTES}) AS chosen,
  count(*) OVER (PARTITION BY card_id) AS card_files, CAST(sum(size) OVER (PARTITION BY card_id) AS BIGINT) AS card_bytes
FROM placed WINDOW w AS (
  PARTITION BY card_id ORDER BY turn, score DESC, record_date DESC NULLS LAST, bytes, file_id NULLS FIRST, path NULLS FIRST ROWS UNBOUNDED PRECEDING)"""),
)
def candidate_score_topk(spark, sf):
    """Every candidate with its score, and whether it is among the first of its card that fit the method's limits."""
    files = a.files(spark, sf)
    family = c.ranked_families(cat(spark, sf)).where("rank = 1").select("card_id", "family_id")
    return c.best_candidates(files, family, max_files=c.MAX_FILES, max_bytes=c.MAX_BYTES)


@query(
    "day_budget_greedy",
    with_views(FILES, body="""
, d AS (SELECT card_id, CAST(modified_at AS DATE) AS day, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ALL),
o AS (SELECT card_id, list({'day': day, 'bytes': bytes} ORDER BY day DESC) AS l FROM d GROUP BY card_id),
f AS (
  SELECT card_id, list_reduce(
    list_transform(l, lambda x: {'used': CAST(0 AS BIGINT), 'day': x.day, 'bytes': x.bytes, 'kept': CAST([] AS DATE[])}),
    lambda acc, x: CASE WHEN acc.used <= 0 OR acc.used + x.bytes <= 40000000
      THEN {'used': acc.used + x.bytes, 'day': x.day, 'bytes': x.bytes, 'kept': list_append(acc.kept, x.day)} ELSE acc END,
    {'used': CAST(0 AS BIGINT), 'day': CAST(NULL AS DATE), 'bytes': CAST(0 AS BIGINT), 'kept': CAST([] AS DATE[])}).kept AS kept FROM o)
SELECT d.card_id, d.day, d.bytes, k.day IS NOT NULL AS kept
FROM d LEFT JOIN (SELECT card_id, unnest(kept) AS day FROM f) k ON d.card_id = k.card_id AND d.day = k.day"""),
    days="day",
)
def day_budget_greedy(spark, sf):
    files = a.files(spark, sf).withColumn("day", F.to_date("modified_at"))
    return c.day_budget(files, "day", 40_000_000)


@query(
    "type_size_gate",
    with_views(FILES, CAT, body=f"""
SELECT file_id, ext IN {c.TEXT_EXTENSIONS} OR ext IN {c.BINARY_EXTENSIONS}
  OR (ext IN ('', 'dat') AND regexp_matches(base_name, {_text(c.NAME_HINT)})) AS passes,
  (ext IN {c.TEXT_EXTENSIONS} AND size <= 8000000) OR (ext IN {c.BINARY_EXTENSIONS} AND size <= 1500000)
  OR (ext IN ('', 'dat') AND regexp_matches(base_name, {_text(c.NAME_HINT)}) AND size <= 8000000) AS passes_limits FROM cat"""),
)
def type_size_gate(spark, sf):
    facts = (F.col("base_name"), F.col("ext"), F.col("size"))
    return cat(spark, sf).select(
        "file_id", c.type_gate(*facts).alias("passes"),
        c.type_gate(*facts, c.MAX_FILE_BYTES, c.MAX_BINARY_BYTES).alias("passes_limits"),
    )


@query(
    "source_summary",
    with_views(FILES, CAT, body="""
SELECT card_id, rn AS position, path, size, n_files, total_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY file_id) AS rn, count(*) OVER (PARTITION BY card_id) AS n_files,
    CAST(sum(size) OVER (PARTITION BY card_id) AS BIGINT) AS total_bytes FROM cat) WHERE rn <= 25"""),
)
def source_summary(spark, sf):
    return c.source_summary(cat(spark, sf))


@query(
    "file_role",
    with_views(FILES, CAT, body="""
SELECT file_id, CASE WHEN file_id % 20 = 9 THEN 'config' WHEN regexp_matches(base_name, '(?i)^stat(?:\\..*)?$') THEN 'daily_summary'
  WHEN regexp_matches(base_name, '(?i)^stat[0-9]{2}(?:\\..*)?$') THEN 'session_summary'
  WHEN regexp_matches(base_name, '(?i)^ev[0-9]{2}(?:\\..*)?$') THEN 'event'
  WHEN regexp_matches(base_name, '(?i)^p[0-9]{2}_[0-9]+(?:\\..*)?$') THEN 'waveform'
  WHEN ext IN ('000', '001', 'b01') THEN 'session_summary' WHEN ext IN ('002', 'b02') THEN 'event'
  WHEN lower(base_name) = 'last.txt' THEN 'pointer'
  WHEN ext IN ('csv', 'txt', 'tsv', 'json', 'xml', 'edf', 'log') THEN 'text' ELSE 'other' END AS role,
  nullif(regexp_extract(base_name, '(?i)^(?:stat|ev|p)([0-9]{2})(?:_[0-9]+)?(?:\\..*)?$', 1), '') AS suffix,
  CASE WHEN path LIKE 'P-SERIES/%' AND ext IN ('000', '001', '002') THEN file_id END AS hint,
  CASE WHEN path LIKE 'P-SERIES/%' THEN upper(split_part(path, '/', 2)) END AS root
FROM cat"""),
    nullable="hint",
)
def file_role(spark, sf):
    # every second note lies in a configuration folder
    path = F.when(F.col("file_id") % 20 == 9, F.concat(F.lit("Therapy/Config/"), "base_name")).otherwise(F.col("path"))
    return cat(spark, sf).select(
        "file_id", c.file_role("base_name", "ext", path).alias("role"), c.usage_suffix("base_name").alias("suffix"),
        c.session_hint("path").alias("hint"), c.root_id("path").alias("root"),
    )


@query(
    "light_family",
    with_views(FILES, CAT, RULES, FAMILY_TABLE, KEPT_FILES, SCORES, LIKELY, body="""
, l AS (SELECT DISTINCT card_id, label FROM src JOIN families ON regexp_matches(path, signature))
SELECT card_id, likely_family, string_agg(label, '; ' ORDER BY label) AS labels, any_value(has_usr) AS bmc_hit
FROM likely JOIN l USING (card_id) LEFT JOIN flags USING (card_id) GROUP BY card_id, likely_family"""),
)
def light_family(spark, sf):
    files = cat(spark, sf).where(~c.is_ignored("path"))
    labels = c.signature_labels(files).groupBy("card_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels")
    )
    hit = c.has_signature(files, "bmc").withColumnRenamed("hit", "bmc_hit")
    return c.likely_family(files).join(labels, "card_id").join(hit, "card_id", "left")


SELECTED = """
recency AS (
  SELECT r.card_id, r.family_id, r.label, r.score, count(s.file_id) AS candidates, count(s.record_date) AS dated,
    max(s.record_date) AS latest_date, arg_min(s.path, (-date_diff('day', DATE '1970-01-01', s.record_date), s.file_id))
      FILTER (s.record_date IS NOT NULL) AS latest_path
  FROM ranked r JOIN families f USING (family_id) LEFT JOIN src s ON s.card_id = r.card_id AND regexp_matches(s.path, f.candidate)
  WHERE r.supported GROUP BY r.card_id, r.family_id, r.label, r.score),
newest AS (
  SELECT *, count(*) OVER (PARTITION BY card_id) AS n,
    row_number() OVER (PARTITION BY card_id ORDER BY latest_date DESC NULLS LAST, score DESC, label) AS rn FROM recency),
selected AS (
  SELECT a.card_id, CASE WHEN coalesce(w.n >= 2 AND w.family_id <> a.family_id AND w.latest_date > own.latest_date, false)
      THEN w.family_id ELSE a.family_id END AS family_id,
    coalesce(w.n >= 2 AND w.family_id <> a.family_id AND w.latest_date > own.latest_date, false) AS by_date
  FROM (SELECT * FROM ranked WHERE rank = 1) a
  LEFT JOIN recency own ON own.card_id = a.card_id AND own.family_id = a.family_id
  LEFT JOIN (SELECT * FROM newest WHERE rn = 1) w ON w.card_id = a.card_id)"""
SELECT_VIEWS = (FILES, CAT, RULES, FAMILY_TABLE, ALL_FILES, SCORES, SELECTED)


@query(
    "family_rank",
    with_views(FILES, CAT, RULES, FAMILY_TABLE, ALL_FILES, SCORES,
               body="SELECT card_id, family_id, label, supported, score, rank FROM ranked"),
)
def family_rank(spark, sf):
    return c.ranked_families(cat(spark, sf))


@query(
    "rule_match",
    with_views(FILES, CAT, RULES, ALL_FILES, body="""
SELECT DISTINCT f.card_id, CAST(r.rule_id AS BIGINT) AS rule_id FROM src f JOIN rules r ON regexp_matches(f.path, r.pattern)"""),
)
def rule_match(spark, sf):
    return c.rule_hits(cat(spark, sf))


@query(
    "family_recency",
    with_views(*SELECT_VIEWS, body="SELECT * FROM recency"),
    days="latest_date",
)
def family_recency(spark, sf):
    files = cat(spark, sf)
    return c.family_recency(files, c.ranked_families(files))


@query("family_select", with_views(*SELECT_VIEWS, body="SELECT card_id, family_id, by_date FROM selected"))
def family_select(spark, sf):
    return c.select_family(cat(spark, sf))


@query(
    "top_mixed_families",
    with_views(*SELECT_VIEWS, body="""
, t AS (
  SELECT card_id, any_value(n) AS n, string_agg(label || ': ' || coalesce(strftime(latest_date, '%Y-%m-%d'), 'no dated folder evidence'), '; ' ORDER BY rn)
 AS txt, bool_and(family_id IN ('sleepstyle', 'icon')) AS alike FROM newest GROUP BY card_id)
SELECT t.card_id, CASE WHEN by_date THEN 'Mixed device data detected. Selected ' || r.label || ' because it has the newest dated folder data ('
    || coalesce(strftime(r.latest_date, '%Y-%m-%d'), 'no dated folder evidence') || '). Detected layouts: ' || txt || '.'
  ELSE 'Multiple device layouts detected. Selected ' || r.label || '. Dated folder comparison: ' || txt || '.' END AS warning
FROM t JOIN selected s USING (card_id) LEFT JOIN recency r ON r.card_id = t.card_id AND r.family_id = s.family_id
WHERE n >= 2 AND NOT alike"""),
)
def top_mixed_families(spark, sf):
    files = cat(spark, sf)
    return c.mixed_warning(c.family_recency(files, c.ranked_families(files)), c.select_family(files))


@query(
    "bundle_complete",
    with_views(FILES, CAT, RULES, FAMILY_TABLE, ALL_FILES, SCORES,
               body="SELECT card_id, has_bundle, has_usr, index_only FROM flags"),
)
def bundle_complete(spark, sf):
    return c.structure_flags(cat(spark, sf))


@query(
    "candidate_semi",
    with_views(*SELECT_VIEWS, body="""
SELECT s.file_id, s.path FROM src s JOIN selected t USING (card_id) JOIN families f ON f.family_id = t.family_id
WHERE regexp_matches(s.path, f.candidate)"""),
)
def candidate_semi(spark, sf):
    files = cat(spark, sf)
    chosen = c.select_family(files).select("card_id", "family_id")
    return files.join(chosen, "card_id").where(c.is_candidate("path", "family_id")).select("file_id", "path")


@query(
    "family_dispatch",
    with_views(*SELECT_VIEWS, body=f"""
, routed AS (SELECT s.*, t.family_id IN {c.DEDICATED} AS dedicated FROM src s JOIN selected t USING (card_id)),
binary_rows AS (SELECT card_id, file_id, 'dedicated' AS route FROM routed WHERE dedicated AND ext IN ('edf', '000', 'idx', 'usr')),
text_rows AS (SELECT card_id, file_id, 'text' AS route FROM routed WHERE ext IN ('txt', 'csv', 'json')
  AND (NOT dedicated OR card_id NOT IN (SELECT card_id FROM binary_rows)))
SELECT * FROM binary_rows UNION ALL SELECT * FROM text_rows"""),
)
def family_dispatch(spark, sf):
    """Dedicated extraction first; the text path serves the other cards and those it gave nothing for."""
    from noonday.operators.cleaning import union_records

    files = cat(spark, sf)
    routed = c.dispatch(files, c.select_family(files), c.DEDICATED)
    dedicated = routed.where((F.col("route") == "dedicated") & F.col("ext").isin("edf", "000", "idx", "usr"))
    text = routed.where(F.col("ext").isin("txt", "csv", "json"))
    served = dedicated.select("card_id").distinct()
    rest = text.where("route = 'text'").unionByName(
        text.where("route = 'dedicated'").join(served, "card_id", "left_anti")
    ).withColumn("route", F.lit("text"))
    return union_records(dedicated, rest).select("card_id", "file_id", "route")


@query(
    "bytes_label",
    with_views(FILES, body="""
SELECT file_id, CASE WHEN size > 1048576 THEN printf('%.2f MB', round(size / 1048576.0::DOUBLE, 2))
  WHEN size > 1024 THEN printf('%.1f KB', round(size / 1024.0::DOUBLE, 1)) ELSE size || ' B' END AS label FROM files"""),
)
def size_label(spark, sf):
    return a.files(spark, sf).select("file_id", bytes_label("size").alias("label"))
