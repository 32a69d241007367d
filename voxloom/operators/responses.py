"""Model answers to requirement rows, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import WHITESPACE, squeeze, strip

# The answer formats that are recognised.
FR_BOLD = r"(?is)^\*\*FR(\d+):\*\* (.+?) \(Based on comments: ([^)]+)\)"
FR_PLAIN = r"(?is)^(?:\*\*)?FR(\d+):\s*(.+?)\s*\(Based on comments:\s*([^)]+)\)"
NFR_BOLD = r"(?is)^\*\*NFR(\d+) \(([^)]+)\):\*\* (.+?) \(Based on comments: ([^)]+)\)"
NFR_PLAIN = r"(?is)^(?:\*\*)?NFR(\d+)\s*(?:\(([^)]+)\))?:\s*(.+?)\s*\(Based on comments:\s*([^)]+)\)"
CLAUSE = r"(?i)\(Based on comments?:\s*([^)]+)\)"
BOLD_PREFIX = r"^\*\*[^:]*:\*\*\s*"
ID_PREFIX = r"^[A-Z]+\d+\s*[:(]\s*[^)]*\)?\s*:?\s*"

# Words that mark a line of a free-form answer.
FR_WORDS = ["fr", "functional", "system shall", "the system"]
NFR_WORDS = ["nfr", "performance", "usability", "reliability"]

# Quality types by keyword, first match wins.
LINE_KEYWORDS = {
    "Performance": ["load", "speed", "time", "fast", "slow", "seconds", "response", "latency"],
    "Usability": ["user", "interface", "navigation", "ease", "intuitive", "accessible", "friendly"],
    "Reliability": ["crash", "error", "failure", "stability", "available", "uptime", "robust"],
    "Security": ["secure", "authentication", "authorization", "password", "encrypt", "protected"],
    "Scalability": ["scale", "concurrent", "users", "capacity", "volume", "growth"],
    "Maintainability": ["maintain", "update", "modify", "extend", "documentation", "readable"],
}
DESCRIPTION_KEYWORDS = {
    "Performance": ["load", "speed", "time", "fast", "slow", "seconds", "response"],
    "Usability": ["user", "interface", "navigation", "ease", "intuitive", "accessible"],
    "Reliability": ["crash", "error", "failure", "stability", "available", "uptime"],
    "Security": ["secure", "authentication", "authorization", "password", "encrypt"],
    "Scalability": ["scale", "concurrent", "users", "capacity", "volume"],
    "Maintainability": ["maintain", "update", "modify", "extend", "documentation"],
}
DEFAULT_TYPE = "Quality"

_CUT = "\x01"
_START = r"(?i)(^|[^A-Za-z0-9_])((?:\*\*)?N?FR\d+\s*(?:\([^)]*\))?\s*:)"
_NFR_FIRST = 1 << 24


def clean_response(col: Column) -> Column:
    """One line, single spaces, without code fences and heading marks."""
    text = squeeze(col)
    for mark in ("```", "###", "##"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(text)


def clean_comment_list(col: Column) -> Column:
    """``1,3  2`` to ``1, 2, 3``; a list without any number keeps its text."""
    text = F.regexp_replace(strip(col), f"(?:,|{WHITESPACE})+", ", ")
    text = F.regexp_replace(F.regexp_replace(text, "^, *", ""), ", *$", "")
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    digits = F.filter(items, lambda x: x.rlike("^[0-9]+$"))
    numbers = F.transform(digits, lambda x: x.try_cast("decimal(38,0)"))
    in_order = F.transform(F.sort_array(numbers), lambda x: x.cast("string"))
    usable = (F.size(digits) > 0) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(usable, F.array_join(in_order, ", ")).otherwise(text)


def comment_ids(col: Column) -> Column:
    """The numbers of a cleaned comment list as an array."""
    items = F.transform(F.split(col, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.filter(items, lambda x: x.isNotNull())


def type_by_keyword(col: Column, keywords: dict[str, list[str]]) -> Column:
    lowered = F.lower(col)
    out = None
    for name, words in keywords.items():
        hit = lowered.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_TYPE)


def type_of_line(col: Column) -> Column:
    """Quality type of a line: named in its first parentheses, else by keyword."""
    inside = F.lower(F.regexp_extract(col, r"\(([^)]+)\)", 1))
    named = None
    for name in LINE_KEYWORDS:
        hit = F.contains(inside, F.lit(name.lower()))
        named = F.when(hit, name) if named is None else named.when(hit, name)
    return F.coalesce(named, type_by_keyword(col, LINE_KEYWORDS))


def type_of_description(col: Column) -> Column:
    return type_by_keyword(col, DESCRIPTION_KEYWORDS)


def _padded(prefix: Column, number: Column) -> Column:
    zeros = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(prefix, zeros)


def _pieces(response: Column) -> Column:
    """The answer cut before every requirement mark, each piece with its tests."""
    cut = F.split(F.regexp_replace(clean_response(response), _START, f"$1{_CUT}$2"), _CUT)
    return F.transform(
        cut,
        lambda p, i: F.struct(
            i.alias("position"),
            p.alias("text"),
            p.rlike(FR_BOLD).alias("fr_bold"),
            p.rlike(FR_PLAIN).alias("fr_plain"),
            p.rlike(NFR_BOLD).alias("nfr_bold"),
            p.rlike(NFR_PLAIN).alias("nfr_plain"),
        ),
    )


def _item(position: Column, text: Column, kind: Column, bold: Column, number: Column) -> Column:
    return F.struct(
        position.cast("int").alias("position"), text.alias("text"), kind.alias("kind"),
        bold.alias("bold"), number.cast("int").alias("number"),
    )


def _marked_items(pieces: str, kind: str) -> Column:
    """Pieces that are requirements of a kind; bold marks win over plain ones."""
    bold = F.exists(pieces, lambda p: p[f"{kind}_bold"])
    chosen = F.when(bold, F.filter(pieces, lambda p: p[f"{kind}_bold"])).otherwise(
        F.filter(pieces, lambda p: p[f"{kind}_plain"])
    )
    first = _NFR_FIRST if kind == "nfr" else 0
    return F.transform(
        chosen,
        lambda p: _item(p["position"] + first, p["text"], F.lit(kind), p[f"{kind}_bold"], F.lit(None)),
    )


def _line_kind(line: Column) -> Column:
    lowered = F.lower(line)
    return F.when(lowered.rlike("|".join(FR_WORDS)), "fr").when(
        lowered.rlike("|".join(NFR_WORDS)), "nfr"
    )


def _line_description(line: Column) -> Column:
    before = F.regexp_extract(line, rf"(?is)^(.*?){CLAUSE[4:]}", 1)
    text = F.when(line.rlike(CLAUSE), strip(before)).otherwise(line)
    return strip(F.regexp_replace(F.regexp_replace(text, BOLD_PREFIX, ""), ID_PREFIX, ""))


def _line_items(response: Column, kind: str) -> Column:
    """Lines that read like a requirement of a kind, counted from 1."""
    lines = F.transform(
        F.split(response, "\n"),
        lambda raw, i: F.struct(i.alias("position"), clean_response(raw).alias("text")),
    )

    def reads_like_one(line: Column) -> Column:
        text = _line_description(line["text"])
        return (F.length(text) > 10) & F.contains(F.lower(text), F.lit("system"))

    found = F.filter(lines, lambda x: (_line_kind(x["text"]) == kind) & reads_like_one(x))
    return F.transform(
        found, lambda x, i: _item(x["position"], x["text"], F.lit(kind), F.lit(False), i + 1)
    )


def parse_responses(df: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """Requirement rows of every answer: functional ones first, then the others.

    An answer is cut before each requirement mark, so a line without a comments
    clause never runs into the next requirement. Bold marks win over plain ones
    in the same answer. Answers without any mark are read line by line; ``form``
    tells ``mark`` from ``line``. All of it happens inside the row, so the job
    has no shuffle.
    """
    cut = df.select(*keys, F.col(response).alias("_answer"), _pieces(F.col(response)).alias("_pieces"))
    marked = F.exists(
        "_pieces", lambda p: p["fr_bold"] | p["fr_plain"] | p["nfr_bold"] | p["nfr_plain"]
    )
    items = F.when(
        marked, F.concat(_marked_items("_pieces", "fr"), _marked_items("_pieces", "nfr"))
    ).otherwise(F.concat(_line_items(F.col("_answer"), "fr"), _line_items(F.col("_answer"), "nfr")))
    rows = cut.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*")
    text, free = F.col("text"), F.col("number").isNotNull()

    def group(fr: int, nfr: int) -> Column:
        out = None
        for kind, bold, plain, i in (("fr", FR_BOLD, FR_PLAIN, fr), ("nfr", NFR_BOLD, NFR_PLAIN, nfr)):
            for pattern, is_bold in ((bold, True), (plain, False)):
                here = (F.col("kind") == kind) & (F.col("bold") == is_bold)
                value = F.regexp_extract(text, pattern, i)
                out = F.when(here, value) if out is None else out.when(here, value)
        return out

    prefix = F.upper("kind")
    quality = F.col("kind") == "nfr"
    named = F.when(F.col("bold"), strip(F.regexp_extract(text, NFR_BOLD, 2))).otherwise(
        strip(F.regexp_extract(text, NFR_PLAIN, 2))
    )
    clause = F.regexp_extract(text, CLAUSE, 1)
    comments = F.when(free, F.when(clause != "", clause).otherwise("Unknown")).otherwise(group(3, 4))
    return rows.select(
        *keys,
        "position",
        F.when(free, F.format_string("%s%03d", prefix, "number"))
        .otherwise(_padded(prefix, group(1, 1)))
        .alias("requirement_id"),
        F.when(quality, "NON_FUNCTIONAL").otherwise("FUNCTIONAL").alias("type"),
        F.when(free, _line_description(text)).otherwise(strip(group(2, 3))).alias("description"),
        clean_comment_list(comments).alias("based_on_comments"),
        F.when(quality, F.when(~free & (named != ""), named).otherwise(type_of_line(text))).alias(
            "nfr_type"
        ),
        F.when(free, "line").otherwise("mark").alias("form"),
    )


def with_validation(requirements: DataFrame) -> DataFrame:
    """Add ``error``: null for a valid requirement, else the reason."""
    required = ["requirement_id", "type", "description", "based_on_comments"]
    missing = F.concat_ws(
        ", ", *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required]
    )
    error = (
        F.when(missing != "", F.concat(F.lit("Missing fields: "), missing))
        .when(
            ~F.col("type").isin("FUNCTIONAL", "NON_FUNCTIONAL"),
            F.concat(F.lit("Invalid type: "), "type"),
        )
        .when(F.length("description") < 10, "Description too short")
    )
    return requirements.withColumn("error", error)


def valid_requirements(requirements: DataFrame) -> DataFrame:
    return with_validation(requirements).where(F.col("error").isNull()).drop("error")


def rejected_requirements(requirements: DataFrame) -> DataFrame:
    return with_validation(requirements).where(F.col("error").isNotNull())
