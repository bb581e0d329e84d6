"""Device-family path rules: the fixed patterns and weights by which a card's file tree is recognised."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Family:
    id: str
    label: str
    supported: bool
    signature: tuple[str, ...]
    confidence: tuple[tuple[str, int], ...]
    priority: tuple[str, ...]


_ICON = r"(?:^|/)(?:fphcare/)?icon/[^/]+/"
_RECORD_DAY = r"(?:^|/)(?:therapy/)?record/\d{6}/\d{2}/"

# Fixed values, in the order in which families are listed.  All patterns ignore case.
FAMILIES = (
    Family(
        "resvent", "Resvent / Hoffrichter", True,
        (r"(?:^|/)(?:therapy/)?record/", r"(?:^|/)(?:therapy/)?config/"),
        (
            (_RECORD_DAY + r"stat(?:\d{1,4})?(?:\..*)?$", 4),
            (_RECORD_DAY + r"(?:ev\d{2}|p\d{2}_\d+|w\d{2}_\d+)(?:\..*)?$", 3),
            (r"(?:^|/)(?:therapy/)?config/", 2),
        ),
        (_RECORD_DAY + r"(?:stat\d{0,4}|ev\d{2}|p\d{2}_\d+|w\d{2}_\d+)(?:\..*)?$", r"(?:^|/)(?:therapy/)?config/"),
    ),
    Family(
        "resmed", "ResMed", True,
        (
            r"(?:^|/)datalog/", r"(?:^|/)str\.edf(?:\.gz)?$", r"(?:^|/)eve\.edf(?:\.gz)?$",
            r"(?:^|/)identification\.(?:tgt|json)$",
        ),
        (
            (r"(?:^|/)datalog/.*/str\.edf(?:\.gz)?$", 4),
            (r"(?:^|/)datalog/.*/(?:eve|pld|brp|sad|crc)\.edf(?:\.gz)?$", 2),
            (r"(?:^|/)identification\.(?:tgt|json)$", 2),
        ),
        (
            r"(?:^|/)datalog/.*/(?:str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?$",
            r"(?:^|/)(?:str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?$",
            r"(?:^|/)identification\.(?:tgt|json)$",
            r"(?:^|/)settings/[^/]+\.(?:tgt|json|txt|xml|log)$",
            r"(?:^|/)(?:settings|summary)\.edf(?:\.gz)?$",
        ),
    ),
    Family(
        "sleepstyle", "Fisher & Paykel SleepStyle", True,
        (_ICON + r"sum.*\.fph$", _ICON + r"his.*\.fph$"),
        ((_ICON + r"his.*\.fph$", 4), (_ICON + r"realtime/hrd.*\.edf$", 4), (_ICON + r"det.*\.fph$", 2)),
        (_ICON + r"(?:sum|det|his).*\.fph$", _ICON + r"realtime/hrd.*\.edf$"),
    ),
    Family(
        "prisma", "Loewenstein / Prisma", True,
        (r"(?:^|/)config\.pscfg$", r"(?:^|/)config\.pcfg$", r"(?:^|/)therapy\.pdat$"),
        ((r"(?:^|/)config\.pscfg$", 4), (r"(?:^|/)config\.pcfg$", 4), (r"(?:^|/)therapy\.pdat$", 2)),
        (r"(?:^|/)(?:config\.pscfg|config\.pcfg|therapy\.pdat)$", r"(?:^|/)(?:event_|signal_).*\.(?:xml|wmedf)$"),
    ),
    Family(
        "weinmann", "Weinmann / Loewenstein", True,
        (r"(?:^|/)wm_data\.tdf$",), ((r"(?:^|/)wm_data\.tdf$", 4),), (r"(?:^|/)wm_data\.tdf$",),
    ),
    Family(
        "prs1", "Philips Respironics System One / DreamStation", True,
        (r"(?:^|/)p-series/", r"(?:^|/)p[0-9]{5}\.[0-9]{3}$"),
        (
            (r"(?:^|/)p-series/[^/]+/(?:prop\.(?:txt|bin)|last\.txt|log\.seq)$", 4),
            (r"(?:^|/)p-series/[^/]+/(?:p[0-7]|d|e)/", 3),
            (r"(?:^|/)p-series/p\d{5}\.\d{3}$", 4),
        ),
        (
            r"(?:^|/)p-series/p\d{5}\.\d{3}$", r"(?:^|/)p\d{5}\.\d{3}$",
            r"(?:^|/)p-series/[^/]+/(?:prop\.(?:txt|bin)|last\.txt|log\.seq)$",
            r"(?:^|/)(?:summary|compliance)\.(?:txt|csv|xml)$",
        ),
    ),
    Family(
        "mseries", "Philips Respironics M-Series", True,
        (r"(?:^|/)m-series/", r"(?:^|/)therapy\.dat$"),
        ((r"(?:^|/)m-series/", 4),),
        (r"(?:^|/)m-series/", r"(?:^|/)therapy\.dat$", r"(?:^|/)(?:summary|compliance)\.(?:txt|csv|xml)$"),
    ),
    Family(
        "bmc", "Apex / BMC / Luna", True,
        (r"(?:^|/)[^/]+\.usr$",), ((r"(?:^|/)[^/]+\.usr$", 4),), (r"(?:^|/)[^/]+\.(?:usr|idx|\d{3})$",),
    ),
    Family(
        "bmcg3x", "ReactHealth / BMC G3 / G3X", True,
        (r"(?:^|/)[^/]+\.idx$", r"(?:^|/)[^/]+\.000$"),
        ((r"(?:^|/)[^/]+\.idx$", 3), (r"(?:^|/)[^/]+\.evt$", 2), (r"(?:^|/)[^/]+\.000$", 3)),
        (r"(?:^|/)[^/]+\.(?:idx|evt|log|\d{3})$",),
    ),
    Family(
        "intellipap", "DeVilbiss IntelliPAP", True,
        (r"(?:^|/)(?:sl/)?set1$", r"(?:^|/)(?:dv6/)?set\.bin$"),
        ((r"(?:^|/)(?:sl/)?set1$", 4), (r"(?:^|/)(?:dv6/)?set\.bin$", 4), (r"(?:^|/)(?:dv6/)?s\.bin$", 3)),
        (r"(?:^|/)(?:(?:sl/)?(?:set1|u|l)|(?:dv6/)?(?:set\.bin|ver\.bin|s\.bin))$",),
    ),
    Family(
        "icon", "Fisher & Paykel ICON", True,
        (_ICON + r"sum.*\.fph$", _ICON + r"flw.*\.fph$"),
        ((_ICON + r"flw.*\.fph$", 4), (_ICON + r"det.*\.fph$", 2)),
        (_ICON + r"(?:sum|det|flw).*\.fph$",),
    ),
    Family(
        "yuwell", "Yuwell", True,
        (r"(?:^|/)yhsd-new\.bys$", r"(?:^|/)runlog\.bys$", r"(?:^|/)sn\.bys$", r"(?:^|/)yh[^/]+/.*\.bys$"),
        (
            (r"(?:^|/)yhsd-new\.bys$", 8), (r"(?:^|/)runlog\.bys$", 4), (r"(?:^|/)sn\.bys$", 4),
            (r"(?:^|/)yh[^/]+/.*\.bys$", 4),
        ),
        (r"(?:^|/).*\.bys$",),
    ),
    Family(
        "dreem", "Dreem", False,
        (r"(?:^|/)dreem/", r"(?:^|/)dreem.*\.(?:csv|json)$"), ((r"(?:^|/)dreem/", 4),), (r"(?:^|/)dreem",),
    ),
    Family(
        "viatom", "Viatom", False,
        (r"(?:^|/)viatom", r"(?:^|/)oximeter"), ((r"(?:^|/)viatom", 4),), (r"(?:^|/)(?:viatom|oximeter)",),
    ),
    Family(
        "vrem", "VREM", True,
        (r"(?:^|/)(?:vrem[^/]*/)?pi\.txt$", r"(?:^|/)(?:vrem[^/]*/)?di\.txt$"),
        (
            (r"(?:^|/)(?:vrem[^/]*/)?pi\.txt$", 4), (r"(?:^|/)(?:vrem[^/]*/)?di\.txt$", 3),
            (r"(?:^|/)(?:vrem[^/]*/)?od[^/]+/", 2),
        ),
        (r"(?:^|/)(?:vrem[^/]*/)?(?:pi\.txt|di\.txt)$", r"(?:^|/)(?:vrem[^/]*/)?od[^/]+/"),
    ),
    Family(
        "cms50", "CMS50", False,
        (r"(?:^|/)spo2\.(?:dat|csv)$", r"(?:^|/)cms50"), ((r"(?:^|/)cms50", 4),),
        (r"(?:^|/)(?:spo2\.(?:dat|csv)|cms50)",),
    ),
    Family(
        "cms50f37", "Contec CMS50F3.7", False,
        (r"(?:^|/)[^/]+\.(?:spo2|spo|spor)$", r"(?:^|/)cms50f(?:3\.7|37|d\+|i|h)?"),
        ((r"(?:^|/)[^/]+\.(?:spo2|spo|spor)$", 4), (r"(?:^|/)cms50f(?:3\.7|37|d\+|i|h)?", 3)),
        (r"(?:^|/)(?:cms50f.*|[^/]+\.(?:spo2|spo|spor))$",),
    ),
    Family(
        "md300w1", "ChoiceMMed MD300W1", False,
        (r"(?:^|/).*md300.*\.dat$", r"(?:^|/).*medview.*\.dat$"),
        ((r"(?:^|/).*md300.*\.dat$", 4), (r"(?:^|/).*medview.*\.dat$", 3)),
        (r"(?:^|/).*\.(?:dat)$",),
    ),
    Family(
        "somnopose", "Somnopose", False,
        (r"(?:^|/).*somnopose.*\.csv$",), ((r"(?:^|/).*somnopose.*\.csv$", 4),), (r"(?:^|/).*\.(?:csv)$",),
    ),
    Family(
        "zeo", "Zeo", False,
        (r"(?:^|/)zeo", r"(?:^|/)zeosleep"), ((r"(?:^|/)zeo", 4),), (r"(?:^|/)(?:zeo|zeosleep)",),
    ),
)

# Patterns every family gives priority to.
BASE_PRIORITY = (
    r"(?:^|/)(?:therapy|record|datalog|summary|detail|session|usage|result|events?)/",
    r"(?:^|/)(?:stat\d{0,4}|ev\d{0,4}|summary|detail|session|usage|result|report|compliance)(?:\..*)?$",
    r"(?:^|/)(?:str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?$",
)

# Weights of the file-structure evidence that is not a single pattern.
BUNDLE_SCORE, LONE_USR_SCORE, INDEX_ONLY_SCORE = 10, 4, 8


def scoring_rules() -> list[tuple[int, str, str, int]]:
    """(rule id, family id, pattern, weight) of every rule that adds to a family's score."""
    rules = []
    for family in FAMILIES:
        rules += [(family.id, p, 1) for p in family.signature]
        rules += [(family.id, p, w) for p, w in family.confidence]
    return [(i, *rule) for i, rule in enumerate(rules)]


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


def needed_text(pattern: str) -> str:
    """Longest lower-case text that every match of a pattern of this file holds; empty where there is none.

    Texts inside of groups, classes and repeats do not count, nor does a pattern that is a choice as a whole.
    """
    gap = "\0"
    bare = re.sub(r"\\[A-Za-z]|\[[^\]]*\]", gap, pattern).replace(r"\.", "\1").replace(".", gap)
    while (inner := re.sub(r"\((?:\?:)?[^()]*\)", gap, bare)) != bare:
        bare = inner
    if "|" in bare or "\\" in bare:
        return ""
    bare = re.sub(r".(?:[?*+]|\{[^}]*\})|[\^$]", gap, bare, flags=re.S)
    return max(bare.replace("\1", ".").lower().split(gap), key=len)


def needed_texts(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of a pattern holds one; empty where none are known.  Choices of plain texts are taken apart."""
    text = needed_text(pattern)
    if len(text) > 1:
        return (text,)
    group = re.search(r"\(\?:((?:[a-z0-9_/|-]|\\\.)+)\)(?![?*{])", pattern)
    if not group:
        return ()
    found = [needed_texts(pattern[: group.start()] + choice + pattern[group.end() :]) for choice in group[1].split("|")]
    return tuple(dict.fromkeys(t for texts in found for t in texts)) if all(found) else ()


# Undated files that are kept, by family.
KEEP_BY_FAMILY = {
    "resvent": (r"(?:^|/)(?:therapy/)?(?:config|record)/",),
    "resmed": (
        r"(?:^|/)datalog/.*/(?:str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?$",
        r"(?:^|/)(?:str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?$",
        r"(?:^|/)identification\.(?:tgt|json)$",
    ),
    "prs1": (
        r"(?:^|/)(?:p-series/|p\d{5}\.\d{3}$|prop[^/]*\.(?:txt|bin)$|summary\.(?:txt|csv|xml)$"
        r"|compliance\.(?:txt|csv|xml)$)",
    ),
    "prisma": (r"(?:^|/)(?:config\.pscfg|config\.pcfg|therapy\.pdat)$",),
    "bmc": (r"(?:^|/)[^/]+\.(?:usr|idx|\d{3})$",),
    "bmcg3x": (r"(?:^|/)[^/]+\.(?:idx|evt|log|\d{3})$",),
    "yuwell": (r"(?:^|/).*\.bys$",),
    "intellipap": (r"(?:^|/)(?:(?:sl/)?(?:set1|u|l)|(?:dv6/)?(?:set\.bin|ver\.bin|s\.bin))$",),
    "sleepstyle": (_ICON + r"(?:sum|det|his|flw).*\.fph$", _ICON + r"realtime/hrd.*\.edf$"),
    "icon": (_ICON + r"(?:sum|det|his|flw).*\.fph$", _ICON + r"realtime/hrd.*\.edf$"),
    "weinmann": (r"(?:^|/)wm_data\.tdf$",),
    "mseries": (r"(?:^|/)(?:m-series/|therapy\.dat$)",),
    "vrem": (r"(?:^|/)(?:vrem[^/]*/)?(?:pi\.txt|di\.txt)$", r"(?:^|/)(?:vrem[^/]*/)?od[^/]+/"),
}

# Undated files that are kept for every card.
KEEP_ALWAYS = (
    r"(?:^|/)(?:therapy/config|config|settings?|profile|profiles)(?:/|$|[._-])",
    r"(?:^|/)wm_profiles\.xml(?:/|$|[._-])",
    r"(?:^|/)(?:summary|detail|str|eve|pld|sad|brp|crc)\.edf(?:\.gz)?(?:/|$|[._-])",
    r"(?:^|/)identification\.(?:tgt|json)(?:/|$|[._-])",
    r"(?:^|/)p-series/",
    r"(?:^|/)p\d{5}\.\d{3}$",
    r"(?:^|/)prop[^/]*\.(?:txt|bin)$",
    r"(?:^|/)p\d{4}\.(?:idx|000)$",
    r"(?:^|/)therapy\.p?dat$",
    r"(?:^|/)(?:sl/)?set1$",
    r"(?:^|/)(?:sl/)?[ul]$",
    r"(?:^|/)(?:dv6/)?(?:set|ver|s)\.bin$",
    r"(?:^|/)wm_data\.tdf$",
    r"(?:^|/)yhsd-(?:new|old)\.bys$",
    r"(?:^|/)(?:runlog|sn)\.bys$",
    r"(?:^|/)[^/]+\.(?:usr|idx|evt|\d{3})$",
    r"(?:^|/)(?:viatom|cms50|zeo|dreem|yuwell|vrem)(?:/|$)",
)
KEEP_DATA_MAX_BYTES = 2_000_000
KEEP_DATA_EXTENSION = r"\.(?:csv|txt|json|xml|dat|edf|usr|idx|000|bin|pscfg|pcfg|pdat)$"
KEEP_DATA_WORD = (
    r"(?:therapy|record|usage|session|event|summary|detail|compliance|result|config|setting|profile|datalog)"
)
KEEP_INFO_MAX_BYTES = 256 * 1024
KEEP_INFO_NAME = (
    r"(?:^|/)(?:readme|info|version|manifest|meta|about|catalog|machine(?:[_-]info)?|device(?:[_-]info)?)(?:[._-]|$)"
)

# Operating-system path segments that are never read.
IGNORED_SEGMENT = (
    r"(?i)(?:^|/)(?:\.spotlight-v100|\.fseventsd|system volume information|\.trashes|__macosx"
    r"|\.ds_store|thumbs\.db|desktop\.ini|\._[^/]*)(?:/|$)"
)
