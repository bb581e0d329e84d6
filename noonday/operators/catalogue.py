"""File catalogue: path parts, dates, recognition of device families, recent windows and candidate selection.

Patterns are compiled into the plan as constants, one regular expression per rule; a pattern column joined to the files
would have to be compiled again for every pair of file and rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noonday.functions import family_rules as fr
from noonday.sources.sinks import keep

# Import windows and extension sets.
IMPORT_DAYS, OLDER_IMPORT_DAYS = 91, 181
# Limits that a caller can ask for; no default uses one. Sizes also earn points.
MAX_FILES, MAX_BYTES = 2_500, 220_000_000
MAX_FILE_BYTES, MAX_BINARY_BYTES, MAX_WAVEFORM_BYTES = 8_000_000, 1_500_000, 96_000_000
MIN_DATED_SHARE = 0.1
TEXT_EXTENSIONS = ("csv", "txt", "tsv", "json", "xml", "edf", "log")
BINARY_EXTENSIONS = ("dat", "pdat", "cfg", "ini", "edf", "000", "idx")
NAME_HINT = (
    r"(?i)(?:^|[_\-.])(stat\d{0,2}|ev\d{0,2}|summary|session|record|therapy|usage|result|detail|event|config|setting)"
    r"(?:[_\-.]|$)"
)
PINNED = (
    r"(?:^|/)str\.edf(?:\.gz)?$", r"(?:^|/)identification\.(?:tgt|json)$",
    r"(?:^|/)settings/[^/]+\.(?:tgt|json|txt|xml|log)$",
)
RECORD_PATH = r"(?i)(?:^|/)(?:therapy/)?record/(\d{4})(\d{2})/(\d{2})(?:/|$)"
SEPARATED_PATH = r"(?:^|/)((?:19|20)\d{2})[/_-](\d{2})[/_-](\d{2})(?:/|$)"
COMPACT_PATH = r"(?:^|[^\d])((?:19|20)\d{2})(\d{2})(\d{2})(?:[^\d]|$)"
RECORD_LEAF = r"(?i)(?:^|/)(?:therapy/)?record/(\d{4})(\d{2})/(\d{2})$"
SEPARATED_LEAF = r"(?:^|/)((?:19|20)\d{2})[/_-](\d{2})[/_-](\d{2})$"
COMPACT_LEAF = r"(?:^|/)((?:19|20)\d{2})(\d{2})(\d{2})$"
ANY_DATE = r"(\d{4})-(\d{2})-(\d{2})"
ANY_US_DATE = r"(\d{2})/(\d{2})/(\d{4})"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- paths -----------------------------------------------------------------------------------------------------


def slashes(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def is_ignored(path: Column | str) -> Column:
    return slashes(path).rlike(fr.IGNORED_SEGMENT)


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(slashes(path), r"\.([^./]*)$", 1))


# The same shapes as one group of digits and separators, so a date costs one regular expression and one parse.
_YEAR = r"(?:19\d{2}|20\d{2}|2100)"
_RECORD_ONE = rf"(?i)(?:^|/)(?:therapy/)?record/({_YEAR}\d{{2}}/\d{{2}})(?:/|$)"
_SEPARATED_ONE = r"(?:^|/)((?:19|20)\d{2}[/_-]\d{2}[/_-]\d{2})(?:/|$)"
_COMPACT_ONE = r"(?:^|[^\d])((?:19|20)\d{6})(?:[^\d]|$)"
_RECORD_LEAF_ONE = rf"(?i)(?:^|/)(?:therapy/)?record/({_YEAR}\d{{2}}/\d{{2}})$"
_SEPARATED_LEAF_ONE = r"(?:^|/)((?:19|20)\d{2}[/_-]\d{2}[/_-]\d{2})$"
_COMPACT_LEAF_ONE = r"(?:^|/)((?:19|20)\d{6})$"
_ANY_ONE = r"(\d{4}-\d{2}-\d{2})"
_ANY_US_ONE = r"(\d{2}/\d{2}/\d{4})"


def _dated(path: Column, pattern: str, shape: str = "yyyyMMdd") -> Column:
    """Date of the first match; NULL without a match (no parse is tried) or for a day that does not exist."""
    digits = F.translate(F.regexp_extract(path, pattern, 1), "/_-", "")
    return F.try_to_date(F.nullif(digits, F.lit("")), shape)


def window_date(path: Column | str) -> Column:
    """Date a file is filtered by: record folder, else separated, else compact; impossible dates are skipped."""
    p = slashes(path)
    return F.when(p.rlike(RECORD_PATH), _dated(p, _RECORD_ONE)).otherwise(
        F.coalesce(_dated(p, _SEPARATED_ONE), _dated(p, _COMPACT_ONE))
    )


def record_date(path: Column | str) -> Column:
    """Date a file's records belong to: record folder, compact, separated, then a date text anywhere."""
    p = slashes(path)
    loose = F.translate(p, "_", "/")
    return F.coalesce(
        _dated(p, _RECORD_ONE), _dated(p, _COMPACT_ONE), _dated(p, _SEPARATED_ONE),
        _dated(loose, _ANY_ONE), _dated(loose, _ANY_US_ONE, "MMddyyyy"),
    )


def leaf_date(path: Column | str) -> Column:
    """Date if the last directory is a day folder."""
    p = F.regexp_replace(slashes(path), "/+$", "")
    return F.when(p.rlike(RECORD_LEAF), _dated(p, _RECORD_LEAF_ONE)).otherwise(
        F.coalesce(_dated(p, _SEPARATED_LEAF_ONE), _dated(p, _COMPACT_LEAF_ONE))
    )


def catalogue(files: DataFrame) -> DataFrame:
    """Listing with normalised path, base name, extension and record date."""
    return files.withColumns(
        {
            "path": slashes("path"), "base_name": base_name("path"), "ext": extension("path"),
            "record_date": record_date("path"),
        }
    )


# --- roles -----------------------------------------------------------------------------------------------------


# Fixed value: where configuration files lie; a file right inside such a folder is one, whatever its name.
CONFIG_PATH = r"(?i)(?:^|/)(?:therapy/)?config/[^/]+$"


def file_role(base: Column | str, ext: Column | str, path: Column | str | None = None) -> Column:
    """Role of a file by its name and extension; with its path also that of a configuration file."""
    b, e = _c(base), _c(ext)
    config = F.lit(False) if path is None else _c(path).rlike(CONFIG_PATH)
    return (
        F.when(config, "config")
        .when(b.rlike(r"(?i)^stat(?:\..*)?$"), "daily_summary")
        .when(b.rlike(r"(?i)^stat\d{2}(?:\..*)?$"), "session_summary")
        .when(b.rlike(r"(?i)^ev\d{2}(?:\..*)?$"), "event")
        .when(b.rlike(r"(?i)^p\d{2}_\d+(?:\..*)?$"), "waveform")
        .when(e.isin("000", "001", "b01"), "session_summary")
        .when(e.isin("002", "b02"), "event")
        .when(b.rlike(r"(?i)^last\.txt$"), "pointer")
        .when(b.rlike(r"(?i)^(?:prop(?:erties)?\.txt|prop\.bin|log\.seq)$"), "metadata")
        .when(e.isin(*TEXT_EXTENSIONS), "text")
        .otherwise("other")
    )


def usage_suffix(base: Column | str) -> Column:
    """Two-digit usage number of a session, event or waveform file."""
    text = F.regexp_extract(_c(base), r"(?i)^(?:(?:stat|ev)(\d{2})(?:\..*)?|p(\d{2})_\d+(?:\..*)?)$", 1)
    wave = F.regexp_extract(_c(base), r"(?i)^(?:(?:stat|ev)(\d{2})(?:\..*)?|p(\d{2})_\d+(?:\..*)?)$", 2)
    return F.when(text != "", text).when(wave != "", wave)


def session_hint(path: Column | str) -> Column:
    """Session id from a hexadecimal file name."""
    digits = F.regexp_extract(slashes(path), r"(?i)(?:^|/)p\d+/([0-9a-f]{8})\.(?:000|001|002|b01|b02)$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def root_id(path: Column | str) -> Column:
    """Machine folder under the series folder."""
    name = F.upper(F.trim(F.regexp_extract(slashes(path), r"(?i)(?:^|/)p-series/([^/]+)/", 1)))
    return F.when(name != "", name)


def root_stats(files: DataFrame) -> DataFrame:
    """Counts per machine folder that say how likely it is the active one."""
    path, ext = slashes("path"), extension("path")
    binary = ext.isin("000", "001", "002") | (ext.isin("b01", "b02") & path.rlike(r"(?i)(?:^|/)p\d+/"))
    data = path.rlike(r"(?i)(?:^|/)p-series/[^/]+/(?:d|e|u|p\d+)/")
    meta = path.rlike(r"(?i)(?:^|/)p-series/[^/]+/(?:prop(?:erties)?\.txt|prop\.bin|log\.seq)$")
    return (
        files.withColumn("root", root_id("path"))
        .where("root IS NOT NULL")
        .groupBy("card_id", "root")
        .agg(
            F.count(F.lit(1)).alias("files"), F.count_if(binary).alias("binaries"),
            F.count_if(data).alias("data_files"), F.count_if(meta).alias("metadata"),
            F.min("file_id").alias("first_seen"),
        )
    )


def at_most(size: Column, limit: int | None) -> Column:
    return F.lit(True) if limit is None else size <= limit


def type_gate(
    base: Column, ext: Column, size: Column, max_bytes: int | None = None, max_binary_bytes: int | None = None
) -> Column:
    """Extension sets, and a name hint for files without a telling extension; size limits only where they are asked for."""
    hinted = ext.isin("", "dat") & base.rlike(NAME_HINT) & at_most(size, max_bytes)
    return (
        (ext.isin(*TEXT_EXTENSIONS) & at_most(size, max_bytes))
        | (ext.isin(*BINARY_EXTENSIONS) & at_most(size, max_binary_bytes))
        | hinted
    )


# --- families --------------------------------------------------------------------------------------------------


def fits(path: Column | str, patterns: tuple[str, ...]) -> Column:
    """Whether a path matches any of the patterns, ignoring case.

    A pattern is tried only on paths that hold the text it can't match without: looking for a text costs a fraction of a match.
    """
    p, tests, others = _c(path), [], []
    low = F.lower(p)
    for pattern in dict.fromkeys(patterns):
        texts = fr.needed_texts(pattern)
        if texts:
            held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in texts])
            tests.append(held & p.rlike("(?i)" + pattern))
        else:
            others.append(pattern)
    if others:
        tests.append(p.rlike(fr.any_of(tuple(others))))
    return reduce(lambda a, b: a | b, tests)


#: Patterns whose hits share one number, as bits.
BITS = 60


def rule_hits(files: DataFrame) -> DataFrame:
    """Distinct (card, rule) pairs; each rule counts once per card however many files match it.

    A file's hits are bits of a few numbers, which are or-ed per card before they move: one row per card is shuffled.
    """
    by_pattern: dict[str, list[int]] = {}
    for i, _, pattern, _ in fr.scoring_rules():
        by_pattern.setdefault(pattern, []).append(i)
    words = [list(by_pattern.items())[at : at + BITS] for at in range(0, len(by_pattern), BITS)]

    def bits(patterns: list[tuple[str, list[int]]]) -> Column:
        one = lambda j, p: F.when(fits("path", (p,)), F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return reduce(lambda x, y: x.bitwiseOR(y), [one(j, p) for j, (p, _) in enumerate(patterns)])

    cards = files.select("card_id", *[bits(w).alias(f"m{k}") for k, w in enumerate(words)]).groupBy("card_id").agg(
        *[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(len(words))]
    )
    hits = [
        F.when(F.col(f"m{k}").bitwiseAND(F.lit(1 << j).cast("bigint")) != 0, F.array(*map(F.lit, ids)))
        for k, w in enumerate(words) for j, (_, ids) in enumerate(w)
    ]
    return cards.select("card_id", F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("rule_id"))


def structure_flags(files: DataFrame) -> DataFrame:
    """Per card: a stem with usr, idx and 000; any usr file; any idx file."""
    path = F.lower(F.col("path"))
    stem = F.regexp_extract(path, r"^(.*)\.([^./]+)$", 1)
    ext = F.regexp_extract(path, r"^(.*)\.([^./]+)$", 2)
    stems = (
        files.select("card_id", stem.alias("stem"), ext.alias("ext"))
        .where(F.col("ext").rlike(r"^(?:usr|idx|\d{3})$"))
        .groupBy("card_id", "stem")
        .agg(*[F.bool_or(F.col("ext") == e).alias(f"has_{e}") for e in ("usr", "idx", "000")])
    )
    return stems.groupBy("card_id").agg(
        F.bool_or(F.col("has_usr") & F.col("has_idx") & F.col("has_000")).alias("has_bundle"),
        F.bool_or("has_usr").alias("has_usr"),
        (F.bool_or("has_idx") & ~F.bool_or("has_usr")).alias("index_only"),
    )


def _rules(df: DataFrame) -> DataFrame:
    rows = [(i, f, w) for i, f, _, w in fr.scoring_rules()]
    return df.sparkSession.createDataFrame(rows, "rule_id int, family_id string, weight int")


def _families(df: DataFrame) -> DataFrame:
    rows = [(f.id, f.label, f.supported) for f in fr.FAMILIES]
    return df.sparkSession.createDataFrame(rows, "family_id string, label string, supported boolean")


def family_scores(files: DataFrame) -> DataFrame:
    """Score per (card, family): matched rules plus file-structure evidence; zero scores are left out."""
    by_rule = (
        rule_hits(files)
        .join(F.broadcast(_rules(files)), "rule_id")
        .groupBy("card_id", "family_id")
        .agg(F.sum("weight").alias("points"))
    )
    flags = structure_flags(files)
    scored = by_rule.join(flags, "card_id", "left")
    is_bundle = F.col("family_id") == "bmc"
    is_index = F.col("family_id") == "bmcg3x"
    extra = (
        F.when(is_bundle & F.coalesce("has_bundle", F.lit(False)), fr.BUNDLE_SCORE)
        .when(is_bundle & F.coalesce("has_usr", F.lit(False)), fr.LONE_USR_SCORE)
        .when(is_index, fr.INDEX_ONLY_SCORE)
        .otherwise(0)
    )
    return (
        scored.where(~is_index | F.coalesce("index_only", F.lit(False)))
        .select("card_id", "family_id", (F.col("points") + extra).alias("score"))
        .join(F.broadcast(_families(files)), "family_id")
    )


def ranked_families(files: DataFrame) -> DataFrame:
    """Families of a card by score, then label; a card has at most twenty."""
    order = Window.partitionBy("card_id").orderBy(F.desc("score"), "label")
    return family_scores(files).withColumn("rank", F.row_number().over(order).cast("bigint"))


def signature_labels(files: DataFrame) -> DataFrame:
    """Every (card, family) with a signature hit, from paths alone."""
    hit = F.array_compact(
        F.array(*[F.when(fits("path", f.signature), F.lit(f.label)) for f in fr.FAMILIES])
    )
    return files.select("card_id", F.explode(hit).alias("label")).distinct()


def has_signature(files: DataFrame, family_id: str) -> DataFrame:
    """Whether a card shows the signature of one family."""
    if family_id == "bmc":
        return structure_flags(files).select("card_id", (F.col("has_bundle") | F.col("has_usr")).alias("hit"))
    if family_id == "bmcg3x":
        return structure_flags(files).select("card_id", F.col("index_only").alias("hit"))
    family = next(f for f in fr.FAMILIES if f.id == family_id)
    return files.groupBy("card_id").agg(F.bool_or(fits("path", family.signature)).alias("hit"))


def likely_family(files: DataFrame) -> DataFrame:
    """Cheap guess per card before content is read: bundle, then record or config folders, then the best score."""
    flags = structure_flags(files).select("card_id", "has_bundle")
    folders = files.groupBy("card_id").agg(
        F.bool_or(F.col("path").rlike(r"(?i)(?:^|/)(?:therapy/)?(?:record|config)/")).alias("has_folders")
    )
    best = ranked_families(files).where("rank = 1").select("card_id", F.col("family_id").alias("best"))
    return (
        folders.join(flags, "card_id", "left")
        .join(best, "card_id", "left")
        .select(
            "card_id",
            F.when(F.coalesce("has_bundle", F.lit(False)), "bmc").when(F.col("has_folders"), "resvent")
            .otherwise(F.col("best")).alias("likely_family"),
        )
    )


def is_candidate(path: Column | str, family_id: Column | str) -> Column:
    """Whether a file matches a signature or priority pattern of the card's family."""
    p, chosen = _c(path), _c(family_id)
    test = None
    for f in fr.FAMILIES:
        hit = fits(p, f.signature + f.priority)
        test = F.when(chosen == f.id, hit) if test is None else test.when(chosen == f.id, hit)
    return F.coalesce(test, F.lit(False))


def family_recency(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Per supported family of a card: candidate files, dated ones, latest date and the first path with it."""
    supported = [f for f in fr.FAMILIES if f.supported]
    hit = F.array_compact(
        F.array(*[
            F.when(fits("path", f.signature + f.priority), F.lit(f.id)) for f in supported
        ])
    )
    counts = (
        files.select("card_id", "file_id", "path", "record_date", F.explode(hit).alias("family_id"))
        .groupBy("card_id", "family_id")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.count("record_date").alias("dated"),
            F.max("record_date").alias("latest_date"),
            F.min(
                F.when(
                    F.col("record_date").isNotNull(),
                    F.struct((-F.unix_date("record_date")).alias("neg"), "file_id", "path"),
                )
            ).alias("newest"),
        )
    )
    return (
        scores.where("supported")
        .join(counts, ["card_id", "family_id"], "left")
        .select(
            "card_id", "family_id", "label", "score",
            F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("dated", F.lit(0)).alias("dated"),
            "latest_date", F.col("newest.path").alias("latest_path"),
        )
    )


def select_family(files: DataFrame) -> DataFrame:
    """Best family by score, unless it is dated and another supported one has a strictly newer date."""
    scores = ranked_families(files)
    recency = family_recency(files, scores)
    newest = Window.partitionBy("card_id").orderBy(
        F.col("latest_date").desc_nulls_last(), F.desc("score"), "label"
    )
    top = (
        recency.withColumn("rn", F.row_number().over(newest))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("card_id")))
        .where("rn = 1")
        .select("card_id", "n", F.col("family_id").alias("new_family"), F.col("latest_date").alias("new_date"))
    )
    first = scores.where("rank = 1").select("card_id", F.col("family_id").alias("first_family"))
    own = recency.select("card_id", F.col("family_id").alias("first_family"), F.col("latest_date").alias("first_date"))
    joined = first.join(own, ["card_id", "first_family"], "left").join(top, "card_id", "left")
    moves = F.coalesce(
        (F.col("n") >= 2) & (F.col("new_family") != F.col("first_family")) & (F.col("new_date") > F.col("first_date")),
        F.lit(False),
    )
    return joined.select(
        "card_id",
        F.when(moves, F.col("new_family")).otherwise(F.col("first_family")).alias("family_id"),
        moves.alias("by_date"),
    )


def mixed_warning(recency: DataFrame, selected: DataFrame, shown: int | None = None) -> DataFrame:
    """Text for cards with several supported layouts, newest first; silent if only the two look-alikes are there.

    With ``shown`` the text names so many layouts and says how many more there are.
    """
    order = Window.partitionBy("card_id").orderBy(F.col("latest_date").desc_nulls_last(), F.desc("score"), "label")
    dated = F.coalesce(F.date_format("latest_date", "yyyy-MM-dd"), F.lit("no dated folder evidence"))
    ranked = recency.withColumn("rn", F.row_number().over(order))
    lists = ranked.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("family_id").isin("sleepstyle", "icon")).alias("only_alike"),
        F.array_sort(
            F.collect_list(
                F.when(at_most(F.col("rn"), shown), F.struct("rn", F.concat("label", F.lit(": "), dated).alias("t")))
            )
        ).alias("items"),
    )
    labels = recency.select("card_id", "family_id", F.col("label").alias("chosen"), dated.alias("chosen_date"))
    text = F.array_join(F.transform("items", lambda i: i["t"]), "; ")
    if shown is not None:
        more = F.concat(F.lit("; ... "), (F.col("n") - shown).cast("string"), F.lit(" more"))
        text = F.concat(text, F.when(F.col("n") > shown, more).otherwise(""))
    joined = lists.where("n >= 2 AND NOT only_alike").join(selected, "card_id").join(
        labels, ["card_id", "family_id"], "left"
    )
    newest = F.concat(
        F.lit("Mixed device data detected. Selected "), "chosen",
        F.lit(" because it has the newest dated folder data ("), "chosen_date",
        F.lit("). Detected layouts: "), text, F.lit("."),
    )
    best = F.concat(
        F.lit("Multiple device layouts detected. Selected "), "chosen",
        F.lit(". Dated folder comparison: "), text, F.lit("."),
    )
    return joined.select("card_id", F.when(F.col("by_date"), newest).otherwise(best).alias("warning"))


def loader_warning(ranked: DataFrame, selected: DataFrame, shown: int = 4) -> DataFrame:
    """Text that names the selected family of a card and the best scores."""
    best = ranked.where(F.col("rank") <= shown).groupBy("card_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat("label", F.lit(" ("), F.col("score").cast("string"), F.lit(")")).alias("t")))).alias("items")
    )
    named = selected.join(ranked.select("card_id", "family_id", "label"), ["card_id", "family_id"]).join(best, "card_id")
    text = F.concat(F.lit("Selected loader: "), "label", F.lit(". Candidate scores: "), F.array_join(F.col("items.t"), ", "), F.lit("."))
    return named.select("card_id", text.alias("warning"))


def support_state(family: Column, supported: Column) -> Column:
    """State of a card: rejected cards are set aside with a reason, they never fail the job."""
    return F.when(family.isNull(), "unrecognised").when(~supported, "unsupported").otherwise("ok")


# --- recent window ---------------------------------------------------------------------------------------------


def keeps_undated(
    path: Column, size: Column, family: Column, max_data_bytes: int | None = None, max_info_bytes: int | None = None
) -> Column:
    """Undated files worth keeping: by family, by name, or data-like and information-like files.

    The last two are limited in size only where that is asked for.
    """
    low = F.lower(slashes(path))
    by_family = None
    for name, patterns in fr.KEEP_BY_FAMILY.items():
        hit = fits(low, patterns)
        by_family = F.when(family == name, hit) if by_family is None else by_family.when(family == name, hit)
    always = fits(low, fr.KEEP_ALWAYS)
    data = at_most(size, max_data_bytes) & low.rlike(fr.KEEP_DATA_EXTENSION) & low.rlike(fr.KEEP_DATA_WORD)
    info = at_most(size, max_info_bytes) & low.rlike(fr.KEEP_INFO_NAME)
    return F.coalesce(by_family, F.lit(False)) | always | data | info


def _window_cards(files: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Files with date and relevance, and one row of window facts per card."""
    placed = files.withColumns({"relevant": ~is_ignored("path"), "path_date": window_date("path")}).withColumn(
        "path_date", F.when(F.col("relevant"), F.col("path_date"))
    )
    normal = placed.withColumn("path", slashes("path")).where("relevant")
    cards = placed.groupBy("card_id").agg(
        F.max("path_date").alias("latest_date"),
        F.count("path_date").alias("n_dated"),
        F.count_if("relevant").alias("n_relevant"),
    ).join(likely_family(normal), "card_id", "left")
    share = F.col("n_dated") / F.greatest(F.lit(1), F.col("n_relevant"))
    return placed, cards.withColumns(
        {
            "window_start": F.date_sub("latest_date", days - 1),
            "keep_everything": F.col("likely_family").isNull() & (F.col("n_dated") > 0) & (share < MIN_DATED_SHARE),
        }
    )


def recent_files(
    files: DataFrame, days: int = IMPORT_DAYS, max_data_bytes: int | None = None, max_info_bytes: int | None = None
) -> DataFrame:
    """Files with a ``kept`` flag: dated ones inside the latest ``days`` of the card, undated ones by rule.

    Cards without any date keep all relevant files; all others keep their latest dated file at least.  Cards without a
    family and with hardly any date keep everything.  What is left out stays in the result, with ``kept`` false.
    """
    placed, cards = _window_cards(files, days)
    dated_in = (F.col("path_date") >= F.col("window_start")) & (F.col("path_date") <= F.col("latest_date"))
    undated_in = keeps_undated(F.col("path"), F.col("size"), F.col("likely_family"), max_data_bytes, max_info_bytes)
    first = F.col("relevant") & F.when(F.col("path_date").isNotNull(), dated_in).otherwise(undated_in)
    marked = placed.join(cards, "card_id").withColumn("first_choice", F.coalesce(first, F.lit(False)))
    kept = (
        F.when(F.col("keep_everything"), F.lit(True))
        .when(F.col("n_dated") == 0, F.col("relevant"))
        .otherwise(F.col("first_choice"))
    )
    return marked.withColumn("kept", kept).select(
        "card_id", "file_id", "path", "size", "path_date", "window_start", "latest_date", "kept"
    )


def window_summary(marked: DataFrame) -> DataFrame:
    """Counts and bytes dropped per card, the latest date, and whether older dated files exist."""
    return marked.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if(~F.col("kept")).alias("dropped_count"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("size"))), F.lit(0)).alias("dropped_bytes"),
        F.max("latest_date").alias("latest_date"),
        F.coalesce(F.bool_or(F.col("path_date") < F.col("window_start")), F.lit(False)).alias("has_older"),
    )


def recent_folders(folders: DataFrame, days: int) -> DataFrame:
    """Dated folders inside the latest ``days`` of their card."""
    latest = folders.groupBy("card_id").agg(F.max("folder_date").alias("latest_date"))
    return folders.join(latest, "card_id").where(F.col("folder_date") > F.date_sub("latest_date", days))


def is_outside_now(path: Column | str, days: int, today: Column) -> Column:
    """Dated path outside [today - days, today); undated paths are never outside."""
    d = window_date(path)
    return F.coalesce((d < F.date_sub(today, days)) | (d >= today), F.lit(False))


# --- candidates ------------------------------------------------------------------------------------------------


def candidate_score(
    path: Column, base: Column, ext: Column, size: Column, record_day: Column, latest: Column, family: Column, days: int
) -> Column:
    """Points of a file: date, name, path, priority patterns, type and size."""
    end = F.date_add(latest, 1)
    inside = (record_day >= F.date_sub(end, days)) & (record_day < end)
    apart = F.abs(F.datediff(record_day, end))
    dated = F.when(inside, 120).when(apart <= 365, F.greatest(F.lit(0), 45 - F.floor(apart / 10))).otherwise(0)

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    def matches(patterns: tuple[str, ...]) -> Column:
        return sum((points(fits(path, (p,)), 35) for p in patterns), F.lit(0))

    own = None
    for f in fr.FAMILIES:
        m = matches(f.priority)
        own = F.when(family == f.id, m) if own is None else own.when(family == f.id, m)
    priority = F.when(family.isNotNull(), matches(fr.BASE_PRIORITY) + F.coalesce(own, F.lit(0))).otherwise(0)
    return (
        F.coalesce(dated, F.lit(0))
        + points(base.rlike(r"(?i)^stat\d{0,4}(?:\..*)?$"), 95)
        + points(base.rlike(r"(?i)^ev\d{0,4}(?:\..*)?$"), 70)
        + points(base.rlike(r"(?i)^p\d{2}_\d+(?:\..*)?$"), 55)
        + points(base.rlike(r"(?i)(?:summary|detail|session|usage|compliance|result)"), 35)
        + points(path.rlike(r"(?i)(?:record|therapy|datalog|p-series)"), 25)
        + priority
        + F.when(ext.isin(*TEXT_EXTENSIONS), 20).when(ext.isin(*BINARY_EXTENSIONS), 14).when(ext == "", 6).otherwise(0)
        + F.when((size > 0) & (size <= 512_000), 18).when(size <= 2_000_000, 12)
        .when(size <= MAX_FILE_BYTES, 6).otherwise(0)
    ).cast("bigint")


def best_candidates(
    files: DataFrame, family: DataFrame, days: int = IMPORT_DAYS, max_files: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Candidates of a card with their score, the count and bytes of all its candidates, and whether each is ``chosen``.

    Without limits all are chosen.  With ``max_files`` or ``max_bytes`` the choice goes by score, newest date and smallest
    size until a limit is reached, pinned files first and by path; the others stay in the result as not chosen.
    """
    parts = catalogue(files).join(family, "card_id", "left")
    latest = parts.groupBy("card_id").agg(F.max("record_date").alias("latest"))
    scored = parts.join(latest, "card_id", "left").withColumns(
        {
            "score": candidate_score(
                F.col("path"), F.col("base_name"), F.col("ext"), F.col("size"), F.col("record_date"),
                F.col("latest"), F.col("family_id"), days,
            ),
            "pinned": F.coalesce((F.col("family_id") == "resmed") & fits("path", PINNED), F.lit(False)),
        }
    ).where(F.col("pinned") | (F.col("score") > 0))
    if max_files is None and max_bytes is None:
        totals = scored.groupBy("card_id").agg(F.count(F.lit(1)).alias("card_files"), F.sum("size").alias("card_bytes"))
        marked = scored.withColumn("chosen", F.lit(True)).join(totals, "card_id")
    else:
        # scored once: the choice reads the candidates several times
        marked = _limited(keep(scored.select("card_id", "file_id", "path", "size", "record_date", "score", "pinned"), "candidates"), max_files, max_bytes)
    return marked.select("card_id", "file_id", "path", "size", "score", "pinned", "card_files", "card_bytes", "chosen")


#: Bytes of a path that chunk the pinned files; the day number of files without a date, before all others.
HEAD_BYTES, NO_DAY = 8, -(2**31)


def _limited(scored: DataFrame, max_files: int | None, max_bytes: int | None) -> DataFrame:
    """Candidates with ``chosen``, and the count and bytes of all of their card's.  A file without a size takes no bytes.

    Files are summed up by chunks of the order: the heads of the paths of pinned files, then (score, record date).  Running
    counts and bytes are made over the chunks of a card and go on inside each chunk, never over a whole card's files.  The
    keys of a chunk are never NULL, so its files are joined with its start and numbered in one shuffle.
    """

    def walk(df: DataFrame, keys: list[str], order: list[Column], inner: list[str]) -> DataFrame:
        sums = df.groupBy("card_id", *keys).agg(F.count(F.lit(1)).alias("__k"), F.sum("__bytes").alias("__b"), F.sum("size").alias("__s"))
        card = Window.partitionBy("card_id")
        before = card.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(
            F.col("card_id").alias("__card"), *[F.col(k).alias(f"__at{k}") for k in keys],
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__k", "__b")],
            F.sum("__k").over(card).alias("card_files"), F.sum("__s").over(card).alias("card_bytes"),
        )
        same = [F.col("card_id") == F.col("__card"), *[F.col(k) == F.col(f"__at{k}") for k in keys]]
        own = Window.partitionBy("card_id", *keys).orderBy(*inner)
        n = F.col("__k0") + F.row_number().over(own)
        size = F.col("__b0") + F.sum("__bytes").over(own.rowsBetween(Window.unboundedPreceding, 0))
        placed = df.join(starts, same).withColumn("__fits", at_most(n, max_files) & at_most(size, max_bytes))
        return placed.drop(*[c for c in starts.columns if c.startswith("__")])

    sized = scored.withColumn("__bytes", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)))
    pinned = sized.where("pinned").withColumn("__head", F.hex(F.substring(F.encode("path", "UTF-8"), 1, HEAD_BYTES)))
    first = walk(pinned, ["__head"], [F.col("__head")], ["path", "file_id", "size"]).drop("__head", "card_files", "card_bytes")
    rest = sized.where("NOT pinned").withColumn("__fits", F.lit(False))
    # pinned files that fit come before all others, those that don't are tried again by their score
    turn = F.when(F.col("__fits"), 0).when(F.col("score") > 0, 1).otherwise(2)
    day = F.coalesce(F.unix_date("record_date"), F.lit(NO_DAY))
    turned = first.unionByName(rest).withColumns({"__turn": turn, "__day": day}).drop("__fits", "record_date")
    placed = walk(turned, ["__turn", "score", "__day"], [F.col("__turn"), F.desc("score"), F.desc("__day")], ["__bytes", "file_id", "path"])
    return placed.withColumn("chosen", (F.col("__turn") == 0) | ((F.col("__turn") == 1) & F.col("__fits")))


def day_budget(files: DataFrame, day: str = "day", budget: int | None = None) -> DataFrame:
    """Days with their bytes and whether they are ``kept``: all without a budget.

    With one, whole days are kept, newest first, while their bytes fit; an oversize day is skipped and older ones tried,
    and the first day is always kept.  The walk runs over one row per day of a card, not over files.
    """
    days = files.groupBy("card_id", day).agg(F.sum("size").alias("bytes"))
    if budget is None:
        return days.withColumn("kept", F.lit(True))
    lists = days.groupBy("card_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(day).alias("day"), "bytes")), asc=False).alias("days")
    )
    start = F.expr(
        "struct(cast(0 as bigint) as used, cast(array() as array<struct<day:date,bytes:bigint,kept:boolean>>) as seen)"
    )

    def step(acc: Column, d: Column) -> Column:
        fits = (acc["used"] <= 0) | (acc["used"] + d["bytes"] <= budget)
        seen = F.struct(d["day"].alias("day"), d["bytes"].alias("bytes"), fits.alias("kept"))
        return F.struct((acc["used"] + F.when(fits, d["bytes"]).otherwise(0)).alias("used"), F.array_append(acc["seen"], seen).alias("seen"))

    walked = lists.select("card_id", F.explode(F.aggregate("days", start, step)["seen"]).alias("d"))
    return walked.select("card_id", F.col("d.day").alias(day), F.col("d.bytes").alias("bytes"), F.col("d.kept").alias("kept"))


def source_summary(files: DataFrame, shown: int = 25) -> DataFrame:
    """First files of a card with its file count and total bytes."""
    totals = files.groupBy("card_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))
    share = Window.partitionBy("card_id", F.pmod(F.xxhash64("file_id"), F.lit(64))).orderBy("file_id")
    whole = Window.partitionBy("card_id").orderBy("file_id")
    first = (
        files.withColumn("rn", F.row_number().over(share)).where(F.col("rn") <= shown)
        .withColumn("rn", F.row_number().over(whole)).where(F.col("rn") <= shown)
    )
    return first.select("card_id", F.col("rn").alias("position"), "path", "size").join(totals, "card_id")


def dispatch(files: DataFrame, family: DataFrame, dedicated: tuple[str, ...]) -> DataFrame:
    """Files of every card with the extraction path of its family: dedicated or text."""
    route = F.when(F.col("family_id").isin(*dedicated), "dedicated").otherwise("text")
    return files.join(family, "card_id").withColumn("route", route)


# Families with an extraction path of their own.
DEDICATED = (
    "resmed", "prs1", "prisma", "weinmann", "bmc", "bmcg3x", "sleepstyle", "icon", "intellipap", "mseries", "vrem",
    "yuwell",
)
