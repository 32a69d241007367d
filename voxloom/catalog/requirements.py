"""Prompts, answers, requirement tables, consolidation and traceability."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.catalog import inputs as I
from voxloom.operators import consolidate as C
from voxloom.operators import prompts as P
from voxloom.operators import requirements as Q
from voxloom.operators import responses as R
from voxloom.operators.cleaning import numbered_clusters
from voxloom.session import cut_lineage, spread

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# Answers derived from the parts, one per part, in five formats: bold marks,
# plain marks, free lines, untyped and incomplete lines, and no requirement.
_RESPONSES = """responses AS (SELECT CAST(p_size AS INTEGER) AS cluster, p_partkey AS part,
  CASE p_partkey % 5
  WHEN 0 THEN 'Functional Requirements (FR)' || chr(10) || '**FR' || p_partkey
    || ':** The system shall support a ' || p_name || '. (Based on comments: ' || p_size || ', 3,'
    || p_partkey || ')' || chr(10) || chr(10) || '### **NFR1 (Performance):** The system  shall load '
    || p_name || ' in 2 seconds. (Based on comments: 12 5)'
  WHEN 1 THEN 'FR' || p_partkey || ': The system shall show each ' || lower(p_type)
    || ' item (Based on comments: ' || p_partkey || ' ,1)' || chr(10) || 'NFR' || p_size
    || ' (Usability): The system shall guide the user to ' || p_name || ' (Based on comments: all)'
  WHEN 2 THEN '- The system shall allow ' || p_name || ' export (Based on comments: 9, 1)' || chr(10)
    || 'Usability: every system page names the ' || lower(p_brand) || chr(10) || 'short' || chr(10)
    || '**Note:** the system must keep ' || p_name || chr(9) || 'safe'
  WHEN 3 THEN 'FR7: no clause here FR8: The system shall list ' || p_name
    || ' (Based on comments: 4, x)' || chr(10) || 'NFR9: The system shall stay available for '
    || p_name || ' (Based on comments: ' || p_size || ')'
  ELSE 'Nothing to report on ' || p_name END AS response FROM part)"""


def _responses(spark, folder):
    nl, tab = F.lit("\n"), F.lit("\t")
    name, size, number = F.col("p_name"), F.col("p_size"), F.col("p_partkey")
    t = F.lit
    bold = F.concat(
        t("Functional Requirements (FR)"), nl, t("**FR"), number,
        t(":** The system shall support a "), name, t(". (Based on comments: "), size, t(", 3,"),
        number, t(")"), nl, nl, t("### **NFR1 (Performance):** The system  shall load "), name,
        t(" in 2 seconds. (Based on comments: 12 5)"),
    )
    plain = F.concat(
        t("FR"), number, t(": The system shall show each "), F.lower("p_type"),
        t(" item (Based on comments: "), number, t(" ,1)"), nl, t("NFR"), size,
        t(" (Usability): The system shall guide the user to "), name, t(" (Based on comments: all)"),
    )
    free = F.concat(
        t("- The system shall allow "), name, t(" export (Based on comments: 9, 1)"), nl,
        t("Usability: every system page names the "), F.lower("p_brand"), nl, t("short"), nl,
        t("**Note:** the system must keep "), name, tab, t("safe"),
    )
    partial = F.concat(
        t("FR7: no clause here FR8: The system shall list "), name,
        t(" (Based on comments: 4, x)"), nl, t("NFR9: The system shall stay available for "), name,
        t(" (Based on comments: "), size, t(")"),
    )
    kind = number % 5
    text = (
        F.when(kind == 0, bold).when(kind == 1, plain).when(kind == 2, free).when(kind == 3, partial)
        .otherwise(F.concat(t("Nothing to report on "), name))
    )
    return spread(I.table(spark, folder, "part"), "p_partkey").select(
        size.cast("int").alias("cluster"),
        number.alias("part"),
        text.alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


def _types_sql(col: str, table: dict) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({col}), '{'|'.join(words)}') THEN '{name}'"
        for name, words in table.items()
    )
    return f"CASE {cases} ELSE 'Quality' END"


def _comments_sql(col: str) -> str:
    flat = f"regexp_replace(trim({col}), '[,\\s]+', ', ', 'g')"
    flat = f"regexp_replace(regexp_replace({flat}, '^, *', ''), ', *$', '')"
    digits = (
        f"list_filter(list_transform(string_split({flat}, ','), lambda x: trim(x)),"
        " lambda x: regexp_full_match(x, '[0-9]+'))"
    )
    return (
        f"CASE WHEN len({digits}) > 0 THEN array_to_string(list_sort(list_transform({digits},"
        f" lambda x: CAST(x AS HUGEINT))), ', ') ELSE {flat} END"
    )


_CLEAN = (
    "trim(replace(replace(replace(trim(regexp_replace(response, '\\s+', ' ', 'g')), '```', ''),"
    " '###', ''), '##', ''))"
)
_FR_B = r"(?is)^\*\*FR(\d+):\*\* (.+?) \(Based on comments: ([^)]+)\)"
_FR_P = r"(?is)^(?:\*\*)?FR(\d+):\s*(.+?)\s*\(Based on comments:\s*([^)]+)\)"
_NFR_B = r"(?is)^\*\*NFR(\d+) \(([^)]+)\):\*\* (.+?) \(Based on comments: ([^)]+)\)"
_NFR_P = r"(?is)^(?:\*\*)?NFR(\d+)\s*(?:\(([^)]+)\))?:\s*(.+?)\s*\(Based on comments:\s*([^)]+)\)"
_LINE_CUT = r"(?is)^(.*?)\(Based on comments?:\s*[^)]+\).*$"

_PARSED = f"""pieces AS (SELECT cluster, part, unnest(list_filter(string_split(regexp_replace({_CLEAN},
    '(?i)(^|[^A-Za-z0-9_])((?:\\*\\*)?N?FR\\d+\\s*(?:\\([^)]*\\))?\\s*:)', '\\1' || chr(1) || '\\2', 'g'),
    chr(1)), lambda x: true)) AS piece, generate_subscripts(string_split(regexp_replace({_CLEAN},
    '(?i)(^|[^A-Za-z0-9_])((?:\\*\\*)?N?FR\\d+\\s*(?:\\([^)]*\\))?\\s*:)', '\\1' || chr(1) || '\\2', 'g'),
    chr(1)), 1) - 1 AS pos FROM responses),
  flags AS (SELECT *, regexp_matches(piece, '{_FR_B}') AS fb, regexp_matches(piece, '{_FR_P}') AS fp,
    regexp_matches(piece, '{_NFR_B}') AS nb, regexp_matches(piece, '{_NFR_P}') AS np FROM pieces),
  per AS (SELECT cluster, part, bool_or(fb) AS any_fb, bool_or(nb) AS any_nb,
    bool_or(fb OR fp OR nb OR np) AS any_req FROM flags GROUP BY ALL),
  chosen AS (SELECT f.*, any_fb, any_nb FROM flags f JOIN per USING (cluster, part)),
  fr AS (SELECT cluster, part, pos, regexp_extract(piece, CASE WHEN any_fb THEN '{_FR_B}' ELSE '{_FR_P}' END, 1) AS no,
    'FUNCTIONAL' AS type, regexp_extract(piece, CASE WHEN any_fb THEN '{_FR_B}' ELSE '{_FR_P}' END, 2) AS d,
    regexp_extract(piece, CASE WHEN any_fb THEN '{_FR_B}' ELSE '{_FR_P}' END, 3) AS c, NULL AS t, piece
    FROM chosen WHERE CASE WHEN any_fb THEN fb ELSE fp END),
  nfr AS (SELECT cluster, part, pos + 16777216 AS pos,
    regexp_extract(piece, CASE WHEN any_nb THEN '{_NFR_B}' ELSE '{_NFR_P}' END, 1) AS no,
    'NON_FUNCTIONAL' AS type, regexp_extract(piece, CASE WHEN any_nb THEN '{_NFR_B}' ELSE '{_NFR_P}' END, 3) AS d,
    regexp_extract(piece, CASE WHEN any_nb THEN '{_NFR_B}' ELSE '{_NFR_P}' END, 4) AS c,
    trim(coalesce(regexp_extract(piece, CASE WHEN any_nb THEN '{_NFR_B}' ELSE '{_NFR_P}' END, 2), '')) AS t, piece
    FROM chosen WHERE CASE WHEN any_nb THEN nb ELSE np END),
  marked AS (SELECT cluster, part, pos, CASE type WHEN 'FUNCTIONAL' THEN 'FR' ELSE 'NFR' END
      || CASE WHEN length(no) < 3 THEN lpad(no, 3, '0') ELSE no END AS requirement_id, type,
    trim(d) AS description, {_comments_sql('c')} AS based_on_comments,
    CASE WHEN type = 'FUNCTIONAL' THEN NULL WHEN t <> '' THEN t
      ELSE {_types_sql('piece', R.LINE_KEYWORDS)} END AS nfr_type
    FROM (SELECT * FROM fr UNION ALL SELECT * FROM nfr)),
  lines AS (SELECT r.cluster, r.part, unnest(string_split(response, chr(10))) AS raw,
    generate_subscripts(string_split(response, chr(10)), 1) - 1 AS pos
    FROM responses r JOIN per USING (cluster, part) WHERE NOT any_req),
  squeezed AS (SELECT cluster, part, pos, trim(replace(replace(replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')),
    '```', ''), '###', ''), '##', '')) AS line FROM lines),
  typed AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'fr|functional|system shall|the system')
      THEN 'FUNCTIONAL' WHEN regexp_matches(lower(line), 'nfr|performance|usability|reliability')
      THEN 'NON_FUNCTIONAL' END AS type,
    regexp_matches(line, '(?i)\\(Based on comments?:\\s*([^)]+)\\)') AS has FROM squeezed),
  texts AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN has THEN
      trim(regexp_extract(line, '{_LINE_CUT}', 1)) ELSE line END, '^\\*\\*[^:]*:\\*\\*\\s*', ''),
      '^[A-Z]+\\d+\\s*[:(]\\s*[^)]*\\)?\\s*:?\\s*', '')) AS description,
    CASE WHEN has THEN regexp_extract(line, '(?i)\\(Based on comments?:\\s*([^)]+)\\)', 1)
      ELSE 'Unknown' END AS c FROM typed WHERE type IS NOT NULL),
  free AS (SELECT cluster, part, pos, CASE type WHEN 'FUNCTIONAL' THEN 'FR' ELSE 'NFR' END
      || lpad(CAST(row_number() OVER (PARTITION BY cluster, part, type ORDER BY pos) AS VARCHAR), 3, '0')
      AS requirement_id, type, description, {_comments_sql('c')} AS based_on_comments,
    CASE WHEN type = 'NON_FUNCTIONAL' THEN {_types_sql('line', R.LINE_KEYWORDS)} END AS nfr_type
    FROM texts WHERE length(description) > 10 AND contains(lower(description), 'system')),
  parsed AS (SELECT * FROM marked UNION ALL SELECT * FROM free)"""

_INITIAL = """initial AS (SELECT cluster, CASE type WHEN 'FUNCTIONAL' THEN 'FR' ELSE 'NFR' END
    || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS requirement_id, type,
    description, based_on_comments, nfr_type, n FROM (SELECT *, row_number() OVER (PARTITION BY type
    ORDER BY cluster, part, pos) AS n FROM parsed))"""


def _sql(tail: str, *ctes: str) -> str:
    return f"WITH {', '.join((_RESPONSES, _PARSED) + ctes)} {tail}"


def _parsed(spark, folder):
    return R.parse_responses(_responses(spark, folder), ["cluster", "part"])


def _initial(spark, folder):
    return Q.initial_requirements(_responses(spark, folder))


_NUMBERED = (
    "numbered AS (SELECT row_number() OVER (ORDER BY Cluster, first_id) AS ID, Review, Cluster"
    " FROM (SELECT Cluster, Review, min(review_id) AS first_id FROM clustered GROUP BY ALL))"
)
_BLOCKS = (
    f"{I.CLUSTERED}, {_NUMBERED}, blocks AS (SELECT Cluster AS cluster, CAST(part AS INTEGER) AS part,"
    " string_agg(ID || '. ' || Review, chr(10) ORDER BY ID) AS comments FROM (SELECT *,"
    " (row_number() OVER (PARTITION BY Cluster ORDER BY ID) - 1) // 20 AS part FROM numbered) GROUP BY ALL)"
)


@query("r1_comment_blocks", f"WITH {_BLOCKS} SELECT cluster, part, comments FROM blocks")
def r1(spark, folder):
    return P.comment_blocks(numbered_clusters(I.clustered(spark, folder)), max_comments=20)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "r2_generation_prompts",
    f"WITH {_BLOCKS} SELECT cluster, part, {_quoted(P.GENERATION_HEAD + 'a notes app' + P.GENERATION_MIDDLE)}"
    f" || comments || {_quoted(P.GENERATION_TAIL)} AS prompt FROM blocks",
)
def r2(spark, folder):
    clustered = numbered_clusters(I.clustered(spark, folder))
    return P.generation_prompts(clustered, "a notes app", max_comments=20)


@query("r3_clean_response", f"WITH {_RESPONSES} SELECT cluster, part, {_CLEAN} AS clean FROM responses")
def r3(spark, folder):
    return _responses(spark, folder).select(
        "cluster", "part", R.clean_response(F.col("response")).alias("clean")
    )


@query(
    "r4_functional",
    _sql("SELECT cluster, part, requirement_id, description, based_on_comments FROM marked"
         " WHERE type = 'FUNCTIONAL'"),
)
def r4(spark, folder):
    df = _parsed(spark, folder).where("form = 'mark' AND type = 'FUNCTIONAL'")
    return df.select("cluster", "part", "requirement_id", "description", "based_on_comments")


@query(
    "r5_non_functional",
    _sql("SELECT cluster, part, requirement_id, description, based_on_comments, nfr_type FROM marked"
         " WHERE type = 'NON_FUNCTIONAL'"),
)
def r5(spark, folder):
    df = _parsed(spark, folder).where("form = 'mark' AND type = 'NON_FUNCTIONAL'")
    return df.select(
        "cluster", "part", "requirement_id", "description", "based_on_comments", "nfr_type"
    )


_ALL = "cluster, part, CAST(pos AS INTEGER) AS position, requirement_id, type, description, based_on_comments, nfr_type"


@query(
    "r6_parse_responses",
    _sql(f"SELECT {_ALL}, 'mark' AS form FROM marked UNION ALL SELECT {_ALL}, 'line' FROM free"),
)
def r6(spark, folder):
    return _parsed(spark, folder)


@query("r7_free_form", _sql(f"SELECT {_ALL} FROM free"))
def r7(spark, folder):
    return _parsed(spark, folder).where("form = 'line'").drop("form")


@query(
    "r8_type_of_line",
    f"""WITH {I.REVIEWS}, t AS (SELECT review_id, Review,
  lower(regexp_extract(Review, '\\(([^)]+)\\)', 1)) AS p FROM reviews)
SELECT review_id, CASE {' '.join(f"WHEN contains(p, '{n.lower()}') THEN '{n}'" for n in R.LINE_KEYWORDS)}
  ELSE {_types_sql('Review', R.LINE_KEYWORDS)} END AS nfr_type FROM t""",
)
def r8(spark, folder):
    return I.reviews(spark, folder).select(
        "review_id", R.type_of_line(F.col("Review")).alias("nfr_type")
    )


@query(
    "r9_type_of_description",
    f"WITH {I.REVIEWS} SELECT review_id, {_types_sql('Review', R.DESCRIPTION_KEYWORDS)} AS nfr_type"
    " FROM reviews",
)
def r9(spark, folder):
    return I.reviews(spark, folder).select(
        "review_id", R.type_of_description(F.col("Review")).alias("nfr_type")
    )


_LISTS = (
    "lists AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || ',' || o_orderkey"
    " WHEN 1 THEN ' , ' || o_custkey || '  007 ' || o_orderkey || ', ' WHEN 2 THEN o_orderpriority"
    " ELSE 'see ' || o_custkey || ' , ' || o_custkey END AS raw FROM orders)"
)


@query(
    "r10_comment_list",
    f"WITH {_LISTS} SELECT id, {_comments_sql('raw')} AS cleaned FROM lists",
)
def r10(spark, folder):
    key, customer, t = F.col("o_orderkey"), F.col("o_custkey"), F.lit
    raw = (
        F.when(key % 4 == 0, F.concat(customer, t(","), key))
        .when(key % 4 == 1, F.concat(t(" , "), customer, t("  007 "), key, t(", ")))
        .when(key % 4 == 2, F.col("o_orderpriority"))
        .otherwise(F.concat(t("see "), customer, t(" , "), customer))
    )
    return I.table(spark, folder, "orders").select(
        key.alias("id"), R.clean_comment_list(raw).alias("cleaned")
    )


_RAW_REQS = """raw AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'FR' || p_partkey END
    AS requirement_id, CASE p_size % 3 WHEN 0 THEN 'FUNCTIONAL' WHEN 1 THEN 'NON_FUNCTIONAL'
    ELSE 'OTHER' END AS type, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS description,
    CAST(p_size AS VARCHAR) AS based_on_comments FROM part)"""


@query(
    "r11_validation",
    f"""WITH {_RAW_REQS}, m AS (SELECT *, concat_ws(', ', CASE WHEN requirement_id = '' THEN 'requirement_id'
  END, CASE WHEN description IS NULL THEN 'description' END) AS missing FROM raw)
SELECT id, requirement_id, type, description, based_on_comments, CASE WHEN missing <> ''
  THEN 'Missing fields: ' || missing WHEN type = 'OTHER' THEN 'Invalid type: OTHER'
  WHEN length(description) < 10 THEN 'Description too short' END AS error FROM m""",
)
def r11(spark, folder):
    size = F.col("p_size")
    raw = I.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(size % 7 == 0, "").otherwise(F.concat(F.lit("FR"), "p_partkey")).alias("requirement_id"),
        F.when(size % 3 == 0, "FUNCTIONAL").when(size % 3 == 1, "NON_FUNCTIONAL").otherwise("OTHER")
        .alias("type"),
        F.when(size % 5 != 0, F.col("p_name")).alias("description"),
        size.cast("string").alias("based_on_comments"),
    )
    return R.with_validation(raw)


@query(
    "d4_number_requirements",
    _sql("SELECT cluster, requirement_id, type, description FROM initial", _INITIAL),
)
def d4(spark, folder):
    return _initial(spark, folder).select("cluster", "requirement_id", "type", "description")


@query(
    "r12_initial_requirements",
    _sql("SELECT cluster, requirement_id, type, description, based_on_comments, nfr_type FROM initial",
         _INITIAL),
)
def r12(spark, folder):
    return _initial(spark, folder)


_SECTIONS = f"""req_lines AS (SELECT cluster, type <> 'FUNCTIONAL' AS q, n, '**' || requirement_id || CASE WHEN
    type = 'FUNCTIONAL' THEN '' ELSE ' (' || coalesce(nfr_type,
    {_types_sql('description', R.DESCRIPTION_KEYWORDS)}) || ')' END || ':** ' || description
    || ' (Based on comments: ' || based_on_comments || ')' || chr(10) AS line FROM initial),
  sections AS (SELECT cluster, CAST(part AS INTEGER) AS part, '## CLUSTER ' || cluster || ' ##' || chr(10)
    || string_agg(line, '' ORDER BY r) AS section FROM (SELECT *, row_number() OVER (PARTITION BY
    cluster ORDER BY q, n) AS r, (row_number() OVER (PARTITION BY cluster ORDER BY q, n) - 1) // 30
    AS part FROM req_lines) GROUP BY cluster, part),
  documents2 AS (SELECT CAST(doc AS INTEGER) AS document, string_agg(section, chr(10) ORDER BY cluster, part)
    AS requirements FROM (SELECT *, (row_number() OVER (ORDER BY cluster, part) - 1) // 20 AS doc
    FROM sections) GROUP BY doc)"""


@query(
    "r13_unification_documents",
    _sql("SELECT document, requirements FROM documents2", _INITIAL, _SECTIONS),
)
def r13(spark, folder):
    initial = cut_lineage(_initial(spark, folder))
    return P.unification_documents(initial, max_lines=30, max_sections=20)


@query(
    "r14_unification_prompts",
    _sql(
        f"SELECT document, {_quoted(P.UNIFICATION_HEAD + 'a notes app' + P.UNIFICATION_MIDDLE)}"
        f" || requirements || {_quoted(P.UNIFICATION_TAIL)} AS prompt FROM documents2",
        _INITIAL,
        _SECTIONS,
    ),
)
def r14(spark, folder):
    initial = cut_lineage(_initial(spark, folder))
    return P.unification_prompts(initial, "a notes app", max_lines=30, max_sections=20)


@query(
    "r15_unified_requirements",
    _sql("SELECT part AS document, requirement_id, type, description, based_on_comments, nfr_type"
         " FROM parsed"),
)
def r15(spark, folder):
    answers = _responses(spark, folder).withColumnRenamed("part", "document")
    return Q.unified_requirements(answers).drop("position")


# Requirements to merge: one per part, worded by name, type and size.
_MERGE = """reqs AS (SELECT p_partkey AS requirement_no, CASE WHEN p_partkey % 4 = 0 THEN 'NON_FUNCTIONAL'
    ELSE 'FUNCTIONAL' END AS type, CASE WHEN p_partkey % 4 = 0 THEN 'Usability' END AS nfr_type,
    'The system shall show ' || p_name || ' stock of ' || lower(p_type) || ' kind ' ||
    CASE p_size % 10 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'on demand' WHEN 3 THEN
    'at login' WHEN 4 THEN 'in a chart' WHEN 5 THEN 'by mail' WHEN 6 THEN 'with filters' WHEN 7 THEN
    'as a printable list' WHEN 8 THEN 'for each warehouse' ELSE 'sorted' END
    AS description, CAST(p_size AS VARCHAR) || ', ' || (p_partkey % 100) AS based_on_comments FROM part)"""


def _to_merge(spark, folder):
    quality = F.col("p_partkey") % 4 == 0
    endings = [
        "daily", "weekly", "on demand", "at login", "in a chart", "by mail", "with filters",
        "as a printable list", "for each warehouse", "sorted",
    ]
    ending = F.array(*[F.lit(e) for e in endings])[(F.col("p_size") % 10).cast("int")]
    return I.table(spark, folder, "part").select(
        F.col("p_partkey").alias("requirement_no"),
        F.when(quality, "NON_FUNCTIONAL").otherwise("FUNCTIONAL").alias("type"),
        F.when(quality, "Usability").alias("nfr_type"),
        F.concat(
            F.lit("The system shall show "), "p_name", F.lit(" stock of "), F.lower("p_type"),
            F.lit(" kind "), ending,
        ).alias("description"),
        F.concat(F.col("p_size").cast("string"), F.lit(", "), F.col("p_partkey") % 100).alias(
            "based_on_comments"
        ),
    )


_PAIRS = f"""{_MERGE}, sets AS (SELECT type, s, min(requirement_no) AS node FROM (SELECT *,
    list_sort(list_distinct(string_split(trim(regexp_replace(lower(description), '[^a-z]+', ' ', 'g')), ' ')))
    AS s FROM reqs) GROUP BY type, s),
  pairs AS (SELECT x.node AS a, y.node AS b, len(list_intersect(x.s, y.s))::DOUBLE
    / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS jaccard
    FROM sets x JOIN sets y ON x.type = y.type AND x.node < y.node)"""


@query(
    "r16_similar_pairs",
    f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.8 - 1e-9",
)
def r16_pairs(spark, folder):
    df = C.similar_pairs(_to_merge(spark, folder), within=["type"], threshold=0.8)
    return I.rounded(df, "jaccard")


@query(
    "r16_consolidate",
    f"""WITH RECURSIVE {_PAIRS}, near AS (SELECT a, b FROM pairs WHERE jaccard >= 0.9 - 1e-9
    UNION SELECT b, a FROM pairs WHERE jaccard >= 0.9 - 1e-9),
  reach(node, root) AS (SELECT node, node FROM sets UNION SELECT near.b, reach.root FROM reach
    JOIN near ON near.a = reach.node WHERE near.b > reach.root),
  comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
  member AS (SELECT r.*, c.root FROM (SELECT *, list_sort(list_distinct(string_split(trim(
    regexp_replace(lower(description), '[^a-z]+', ' ', 'g')), ' '))) AS s FROM reqs) r
    JOIN sets USING (type, s) JOIN comp c USING (node)),
  best AS (SELECT root, first(description ORDER BY length(description) DESC, requirement_no) AS description,
    min(type) AS type, min(nfr_type) AS nfr_type, min(requirement_no) AS f, count(*) AS n_merged
    FROM member GROUP BY root),
  ids AS (SELECT root, string_agg(DISTINCT id::VARCHAR, ', ' ORDER BY id::VARCHAR) AS unused,
    array_to_string(list_sort(list_distinct(list(id))), ', ') AS based_on_comments,
    count(DISTINCT id) AS n_comments FROM
    (SELECT root, CAST(unnest(string_split(based_on_comments, ', ')) AS BIGINT) AS id FROM member) GROUP BY root),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY f) AS n FROM best)
SELECT CASE type WHEN 'FUNCTIONAL' THEN 'FR' ELSE 'NFR' END || CASE WHEN n < 1000 THEN
  lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS requirement_id, type, description, based_on_comments,
  nfr_type, n_merged, n_comments FROM numbered JOIN ids USING (root)""",
)
def r16(spark, folder):
    return C.consolidate(_to_merge(spark, folder), threshold=0.9)


def _with_bounds(spark, folder):
    """One requirement a part: its type, with a bound from its size."""
    n = F.col("p_size").cast("bigint")
    quantity, thousands = n.cast("string"), (n * 100).cast("string")
    bounds = [
        F.concat(F.lit("within "), quantity, F.lit(" seconds")),
        F.concat(F.lit("under "), thousands, F.lit(" ms")),
        F.concat(F.lit("at most "), quantity, F.lit(" minutes")),
        F.concat(F.lit("at least "), quantity, F.lit(" GB")),
        F.concat(F.lit("more than "), thousands, F.lit(" MB")),
        F.concat(F.lit("over "), quantity, F.lit(" lists")),
        F.concat(F.lit("in "), (n % 3 + 1).cast("string"), F.lit(" lists")),
    ]
    number = F.col("p_partkey")
    return I.table(spark, folder, "part").select(
        number.alias("requirement_no"),
        F.lit("NON_FUNCTIONAL").alias("type"),
        F.lit("Performance").alias("nfr_type"),
        F.concat(
            F.lit("The shop shall list each "), F.lower("p_type"), F.lit(" part "),
            F.array(*bounds)[(number % len(bounds)).cast("int")], F.lit("."),
        ).alias("description"),
        (number % 100).cast("string").alias("based_on_comments"),
    )


# What each wording states: shape, the order of strictness (small is strict), and words.
_BOUND_ROWS = """lines AS (SELECT p_partkey AS no, lower(p_type) AS kind, p_partkey % 100 AS cited,
    CAST(p_size AS BIGINT) AS q FROM part),
  said AS (SELECT *, CASE no % 7
      WHEN 0 THEN {'shape': 'time', 'rank': q * 1000, 'words': 'within ' || q || ' seconds'}
      WHEN 1 THEN {'shape': 'time', 'rank': q * 100, 'words': 'under ' || q * 100 || ' ms'}
      WHEN 2 THEN {'shape': 'time', 'rank': q * 60000, 'words': 'at most ' || q || ' minutes'}
      WHEN 3 THEN {'shape': 'size', 'rank': -q * 1000000, 'words': 'at least ' || q || ' GB'}
      WHEN 4 THEN {'shape': 'size', 'rank': -q * 100000, 'words': 'more than ' || q * 100 || ' MB'}
      WHEN 5 THEN {'shape': 'many', 'rank': -q, 'words': 'over ' || q || ' lists'}
      ELSE {'shape': 'exact ' || q % 3, 'rank': 0::BIGINT, 'words': 'in ' || q % 3 + 1 || ' lists'} END AS b
    FROM lines)"""


@query(
    "r16_stricter_bounds",
    f"""WITH {_BOUND_ROWS}, united AS (SELECT kind, b.shape AS shape, count(*) AS n_merged, min(no) AS f,
    arg_min(b.words, (b.rank, no)) AS words, count(DISTINCT cited) AS n_comments,
    array_to_string(list_sort(list(DISTINCT cited)), ', ') AS based_on_comments FROM said GROUP BY ALL),
  numbered AS (SELECT *, row_number() OVER (ORDER BY f) AS n FROM united)
SELECT 'NFR' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS requirement_id,
  'NON_FUNCTIONAL' AS type, 'The shop shall list each ' || kind || ' part ' || words || '.' AS description,
  based_on_comments, 'Performance' AS nfr_type, n_merged, n_comments FROM numbered""",
)
def r16_bounds(spark, folder):
    return C.consolidate(_with_bounds(spark, folder), threshold=0.95)


@query(
    "r17_traceability",
    _sql(
        """SELECT requirement_id, c.id AS "ID", Review, n.Cluster FROM (SELECT DISTINCT requirement_id,
  TRY_CAST(unnest(string_split(based_on_comments, ', ')) AS BIGINT) AS id FROM initial) c
  LEFT JOIN numbered n ON n.ID = c.id WHERE c.id IS NOT NULL""",
        _INITIAL,
        I.CLUSTERED,
        _NUMBERED,
    ),
)
def r17(spark, folder):
    clustered = numbered_clusters(I.clustered(spark, folder))
    return Q.traceability(_initial(spark, folder), clustered)


@query(
    "r17_dangling_citations",
    _sql(
        """SELECT requirement_id, id AS "ID" FROM (SELECT DISTINCT requirement_id,
  TRY_CAST(unnest(string_split(based_on_comments, ', ')) AS BIGINT) AS id FROM initial) c
  WHERE id IS NOT NULL AND id NOT IN (SELECT ID FROM numbered)""",
        _INITIAL,
        I.CLUSTERED,
        _NUMBERED,
    ),
)
def r17_dangling(spark, folder):
    clustered = numbered_clusters(I.clustered(spark, folder))
    return Q.dangling_citations(_initial(spark, folder), clustered)
