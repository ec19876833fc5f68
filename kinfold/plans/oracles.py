"""The same results as one DuckDB statement per query, for checking."""

from __future__ import annotations

RELATIONSHIPS = """
SELECT (((l.l_orderkey * 8 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey) * 64
         + CAST(l.l_quantity AS BIGINT) AS row_id,
       CAST(l.l_orderkey AS VARCHAR) AS document_number,
       CASE WHEN l.l_returnflag = 'R' THEN 'Organization'
            WHEN p.p_size % 11 = 0 THEN NULL
            WHEN p.p_size % 13 = 0 THEN 'Organization'
            ELSE 'Innovation' END AS source_type,
       CASE WHEN l.l_returnflag = 'R' THEN concat('C', CAST(o.o_custkey AS VARCHAR))
            ELSE concat('P', CAST(p.p_partkey AS VARCHAR)) END AS source_id,
       CASE WHEN l.l_returnflag = 'R' THEN concat('Customer ', CAST(o.o_custkey AS VARCHAR))
            ELSE concat(p.p_name, ' ', p.p_brand) END AS source_english_id,
       CASE WHEN p.p_size % 7 = 0 THEN NULL
            ELSE concat(p.p_name, ' ', p.p_type, ' size ', CAST(p.p_size AS VARCHAR)) END
         AS source_description,
       CASE l.l_returnflag WHEN 'A' THEN 'DEVELOPED_BY' WHEN 'R' THEN 'COLLABORATION'
            ELSE 'USES' END AS relationship_type,
       concat('line ', CAST(l.l_linenumber AS VARCHAR), ' status ', l.l_linestatus)
         AS relationship_description,
       concat('S', CAST(s.s_suppkey AS VARCHAR)) AS target_id,
       CASE WHEN l.l_linenumber = 7 THEN NULL ELSE s.s_name END AS target_english_id,
       CASE WHEN l.l_quantity > 45 THEN NULL
            ELSE concat('nation ', CAST(s.s_nationkey AS VARCHAR)) END AS target_description,
       l.l_linestatus AS domain
FROM lineitem l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN orders o ON o.o_orderkey = l.l_orderkey
"""

# One labelled pair per document with the first document of the same start, one with its predecessor.
LABELS = """
SELECT abs(f.n_chars - d.n_chars) * 50 <= greatest(f.n_chars, d.n_chars) AS is_match,
       f.doc_id AS k1, d.doc_id AS k2
FROM documents d
JOIN (SELECT left(text, 20) AS start, min(doc_id) AS doc_id FROM documents GROUP BY 1) m
  ON m.start = left(d.text, 20) AND m.doc_id < d.doc_id
JOIN documents f ON f.doc_id = m.doc_id
UNION
SELECT false, a.doc_id, b.doc_id
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND left(a.text, 20) <> left(b.text, 20)
"""

TEXT = r"""SELECT doc_id AS row_id, text AS source_description, source AS document_number,
  source AS source_company, lang AS target_id, n_chars FROM documents"""


def statement(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def cte(name: str, body: str) -> str:
    return f"{name} AS MATERIALIZED (\n{body}\n)"


def _domain(name: str, prefix: str, order: int, extra: str, where: str) -> str:
    return f"""SELECT row_id, '{prefix}' || document_number AS document_number, source_type, source_id,
  source_english_id, source_description, relationship_type, relationship_description, target_id,
  target_english_id, target_description{extra}, {order} AS domain_order
FROM r WHERE domain = '{name}'{where}"""


_COMPARE = """, source_id || ' - ' || coalesce(source_description, '') || ' | Developed by '
  || coalesce(target_english_id, '') AS text_to_compare"""
_DEVELOPED = " AND relationship_type = 'DEVELOPED_BY'"
_COMPARISON = _domain(
    "O", "COMP", 1, _COMPARE, _DEVELOPED + " AND source_type IS DISTINCT FROM 'Organization'"
)

R = [cte("r", RELATIONSHIPS)]
COMBINED = R + [
    cte("combined", _domain("F", "FOC", 0, _COMPARE, _DEVELOPED) + "\nUNION ALL\n" + _COMPARISON)
]
UNFILTERED = [
    cte("unfiltered", _domain("F", "FOC", 0, "", "") + "\nUNION ALL\n" + _domain("O", "COMP", 1, "", ""))
]


def first_rows(name: str, source: str, order: str) -> str:
    return cte(
        name,
        f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY source_description ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1""",
    )


R_FIRST = COMBINED + [first_rows("firsts", "combined", "domain_order, row_id")]
D = [cte("texts", TEXT)]
D_FIRST = D + [first_rows("firsts", "texts", "row_id")]
LABELLED = [cte("labelled", LABELS)]


def bigrams(name: str, source: str, row_id: str = "row_id", text: str = "source_description") -> list[str]:
    """Postings ``<name>_post(row_id, term, k)`` and lengths ``<name>_len(row_id, len)``."""
    return [
        cte(
            f"{name}_words",
            rf"""SELECT {row_id} AS row_id, list_filter(
  regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}""",
        ),
        cte(
            f"{name}_post",
            f"""SELECT row_id, term, count(*) AS k FROM (SELECT row_id, unnest(list_transform(
  range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {name}_words) GROUP BY ALL""",
        ),
        cte(
            f"{name}_len",
            f"SELECT row_id, sqrt(CAST(sum(k * k) AS DOUBLE)) AS len FROM {name}_post GROUP BY row_id",
        ),
    ]


def pairs(name: str, source: str, threshold: float) -> list[str]:
    """``<name>_pairs(i, j, score)`` over all rows of ``source``."""
    return bigrams(name, source) + [
        cte(
            f"{name}_pairs",
            f"""SELECT i, j, score FROM (
  SELECT a.row_id AS i, b.row_id AS j,
         CAST(sum(a.k * b.k) AS DOUBLE) / (any_value(x.len) * any_value(y.len)) AS score
  FROM {name}_post a JOIN {name}_post b ON a.term = b.term AND a.row_id < b.row_id
  JOIN {name}_len x ON x.row_id = a.row_id JOIN {name}_len y ON y.row_id = b.row_id
  GROUP BY a.row_id, b.row_id) WHERE score > {threshold}""",
        )
    ]


def components(name: str, edges: str, left: str = "i", right: str = "j") -> list[str]:
    """``<name>(node, component)`` of an edge table by reachability."""
    return [
        cte(
            f"{name}_both",
            f"SELECT {left} AS a, {right} AS b FROM {edges} UNION SELECT {right}, {left} FROM {edges}",
        ),
        f"""{name}_reach(a, b) AS (SELECT a, a FROM {name}_both
  UNION SELECT c.a, e.b FROM {name}_reach c JOIN {name}_both e ON e.a = c.b)""",
        cte(name, f"SELECT a AS node, min(b) AS component FROM {name}_reach GROUP BY a"),
    ]


R_PAIRS = R_FIRST + pairs("t", "firsts", 0.7)
R_GROUPS = R_PAIRS + components("groups", "t_pairs")
D_PAIRS = D + pairs("t", "texts", 0.6)
D_FIRST_PAIRS = D_FIRST + pairs("t", "firsts", 0.6)
V = [
    cte(
        "v_pairs",
        """SELECT a.vec_id AS i, b.vec_id AS j,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
    )
]


def above(source: str, threshold: float) -> str:
    return cte("edges", f"SELECT i, j, score FROM {source} WHERE score > {threshold}")


V_GROUPS = V + [above("v_pairs", 0.4)] + components("groups", "edges")
D_GROUPS = D_PAIRS + [above("t_pairs", 0.8)] + components("groups", "edges")


def thresholds(low: float, high: float) -> str:
    return cte(
        "thresholds", f"SELECT {low} + k * ({high} - {low}) / 29 AS t FROM (SELECT unnest(range(30)) AS k)"
    )


def sweep_pairs(ctes: list[str], source: str, low: float, high: float) -> str:
    return statement(
        [*ctes, thresholds(f"{low}::DOUBLE", f"{high}::DOUBLE")],
        f"""SELECT round(t, 6) AS threshold, count(score) AS pairs,
  round(coalesce(avg(score), 0.0), 6) AS mean_score
FROM thresholds LEFT JOIN {source} ON score > t GROUP BY t""",
    )


def sweep_groups(ctes: list[str], source: str, low: float, high: float) -> str:
    return statement(
        [
            *ctes,
            thresholds(f"{low}::DOUBLE", f"{high}::DOUBLE"),
            cte("edges", f"SELECT t, i, j FROM thresholds JOIN {source} ON score > t"),
            cte("both_ways", "SELECT t, i AS a, j AS b FROM edges UNION SELECT t, j, i FROM edges"),
            """reach(t, a, b) AS (SELECT t, a, a FROM both_ways
  UNION SELECT c.t, c.a, e.b FROM reach c JOIN both_ways e ON e.t = c.t AND e.a = c.b)""",
            cte("placed", "SELECT t, a, min(b) AS g FROM reach GROUP BY t, a"),
            cte("sizes", "SELECT t, count(DISTINCT g) AS groups, count(*) AS nodes FROM placed GROUP BY t"),
            cte("counts", "SELECT t, count(*) AS pairs FROM edges GROUP BY t"),
        ],
        """SELECT round(t, 6) AS threshold, coalesce(groups, 0) AS groups, coalesce(pairs, 0) AS pairs,
  round(coalesce(nodes / groups, 0.0), 6) AS mean_group_size
FROM thresholds LEFT JOIN sizes USING (t) LEFT JOIN counts USING (t)""",
    )


# Review: members numbered by id, canonical member, members the rule rejects, members kept.
MEMBERS = R_GROUPS + [
    cte(
        "members",
        """SELECT component AS group_id, f.*,
  CAST(row_number() OVER (PARTITION BY component ORDER BY row_id) AS INTEGER) AS ordinal
FROM groups JOIN firsts f ON f.row_id = node""",
    ),
    cte(
        "canonical",
        """SELECT group_id, row_id AS canonical_id, source_english_id AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id
    ORDER BY coalesce(length(source_description), 0) DESC, row_id) AS rn FROM members) WHERE rn = 1""",
    ),
]
KEPT = MEMBERS + [
    cte(
        "wrong",
        """SELECT m.group_id, m.ordinal, m.row_id FROM members m JOIN canonical c USING (group_id)
LEFT JOIN t_pairs p ON p.i = least(m.row_id, c.canonical_id) AND p.j = greatest(m.row_id, c.canonical_id)
WHERE m.row_id <> c.canonical_id AND p.i IS NULL""",
    ),
    cte(
        "kept",
        """SELECT * REPLACE (row_number() OVER (PARTITION BY group_id ORDER BY row_id) AS ordinal)
FROM (SELECT m.*, count(*) OVER (PARTITION BY m.group_id) AS n FROM members m
  ANTI JOIN wrong w ON w.row_id = m.row_id) WHERE n >= 2""",
    ),
]


def documents_of(source: str) -> list[str]:
    return [
        cte(
            "group_docs",
            f"""SELECT DISTINCT group_id, document_number FROM (
  SELECT g.group_id, u.document_number FROM {source} g JOIN unfiltered u
    ON u.source_english_id = g.source_english_id
  UNION ALL
  SELECT g.group_id, u.document_number FROM {source} g JOIN unfiltered u
    ON u.target_english_id = g.source_english_id)""",
        )
    ]


MENTIONS = [
    cte(
        "sides",
        """SELECT domain_order, row_id, document_number, 0 AS side, source_id AS org_id,
  source_english_id AS org_name, target_english_id AS partner
FROM unfiltered WHERE relationship_type = 'COLLABORATION' AND source_id IS NOT NULL
UNION ALL
SELECT domain_order, row_id, document_number, 1, target_id, target_english_id,
  CASE WHEN target_id = source_id THEN target_english_id ELSE source_english_id END
FROM unfiltered WHERE relationship_type = 'COLLABORATION' AND target_id IS NOT NULL""",
    ),
    cte(
        "mentions",
        """SELECT domain_order, row_id, document_number, side, org_id, org_name, false AS dev FROM sides
UNION ALL
SELECT domain_order, row_id, document_number, 0, target_id, target_english_id, true
FROM unfiltered WHERE relationship_type = 'DEVELOPED_BY' AND target_id IS NOT NULL""",
    ),
]
PROFILES = [
    cte(
        "profiles",
        """SELECT group_id, org_id, any_value(first_name) AS name, bool_or(dev) AS developed_by,
  bool_or(NOT dev) AS collaboration, count(*) AS mentions
FROM (SELECT g.group_id, m.*, first_value(org_name) OVER (PARTITION BY g.group_id, m.org_id
        ORDER BY domain_order, row_id, side) AS first_name
      FROM group_docs g JOIN mentions m USING (document_number))
GROUP BY group_id, org_id""",
    )
]
ROLES = [
    cte(
        "roles",
        """SELECT group_id, coalesce(nullif(concat_ws('+', CASE WHEN developed_by THEN 'developer' END,
  CASE WHEN collaboration THEN 'collaborator' END), ''), 'unknown') AS focus_role
FROM (SELECT DISTINCT group_id FROM grouped) LEFT JOIN (SELECT * FROM profiles WHERE org_id = 'S0')
USING (group_id)""",
    )
]
_GROUPED = [
    cte(
        "grouped",
        """SELECT component AS group_id, f.source_english_id FROM groups
JOIN firsts f ON f.row_id = node""",
    )
]
RAW_DOCS = R_GROUPS + UNFILTERED + _GROUPED + documents_of("grouped")
UNIFIED = (
    KEPT
    + UNFILTERED
    + [cte("grouped", "SELECT group_id, row_id, source_english_id FROM kept")]
    + documents_of("grouped")
    + MENTIONS
)
_SUMMARY = """SELECT group_id, CAST(floor((ordinal - 1) / 500) AS INTEGER) AS part,
  string_agg(DISTINCT source_description, ' ' ORDER BY source_description) AS description
FROM kept GROUP BY ALL"""

# Linkage: cleaned records, candidates, clusters.
COMPLETE = COMBINED + [
    cte("innovations", "SELECT * FROM combined WHERE source_type = 'Innovation'"),
    cte(
        "complete",
        r"""SELECT * FROM innovations
WHERE regexp_replace(source_id, '[\s\p{Z}\x{85}]+', '', 'g') <> ''
  AND regexp_replace(source_english_id, '[\s\p{Z}\x{85}]+', '', 'g') <> ''
  AND regexp_replace(source_description, '[\s\p{Z}\x{85}]+', '', 'g') <> ''""",
    ),
]


def clean(column: str) -> str:
    tidy = (
        rf"trim(regexp_replace(regexp_replace(translate({column}, chr(13) || chr(10) || chr(9), '   '),"
        r" '[\x00-\x1f]', '', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g'))"
    )
    return f"CASE WHEN {column} IS NULL THEN '' WHEN {tidy} = '' THEN 'MISSING' ELSE {tidy} END"


_CLEANED = [
    "source_id",
    "source_english_id",
    "source_description",
    "relationship_description",
    "target_id",
    "target_english_id",
]
RECORDS = COMPLETE + [
    cte(
        "records",
        "SELECT row_id AS record_id, "
        + ", ".join(f"{clean(c)} AS {c}" for c in _CLEANED)
        + ", document_number, 'Unknown' AS source_company FROM complete",
    )
]


def candidates(record_table: str, record_id: str, threshold: float) -> list[str]:
    """Near pairs of first records, and each copy with its first record."""
    return (
        [
            cte(
                "leaders",
                f"""SELECT {record_id} AS row_id, source_description,
  min({record_id}) OVER (PARTITION BY source_description) AS leader FROM {record_table}""",
            ),
            cte("lead_rows", "SELECT * FROM leaders WHERE row_id = leader"),
        ]
        + pairs("c", "lead_rows", threshold)
        + [
            cte(
                "candidates",
                """SELECT i, j, score FROM c_pairs
UNION ALL SELECT leader, row_id, 1.0 FROM leaders WHERE row_id <> leader""",
            )
        ]
    )


def blocked(
    fields: list[str], keys: list[tuple[str, ...]], record_table: str = "records", record_id: str = "record_id"
) -> list[str]:
    """``candidates`` and the pairs of records that agree in a key, which holds the description.

    Records equal in all ``fields`` are one class: every two different classes of a key are a pair of their
    smallest records, and each record is paired with the smallest of its class.
    """
    whole = [" AND ".join(f"coalesce({c}, '') NOT IN ('', 'MISSING')" for c in key) for key in keys]
    inside = [
        f"SELECT a.id AS i, b.id AS j FROM classes a JOIN classes b USING ({', '.join(key)}) "
        f"WHERE a.id = a.head AND b.id = b.head AND a.id < b.id AND {test}"
        for key, test in zip(keys, whole, strict=True)
    ]
    return [
        cte(
            "classes",
            f"SELECT {', '.join(fields)}, {record_id} AS id, "
            f"min({record_id}) OVER (PARTITION BY {', '.join(fields)}) AS head FROM {record_table}",
        ),
        cte(
            "same_block",
            "\nUNION ".join(inside)
            + "\nUNION SELECT head, id FROM classes WHERE id <> head AND ("
            + " OR ".join(f"({test})" for test in whole)
            + ")",
        ),
        cte(
            "blocked",
            """SELECT i, j, score FROM candidates
UNION ALL SELECT i, j, 1.0 FROM same_block ANTI JOIN candidates USING (i, j)""",
        ),
    ]


def clusters(record_table: str, record_id: str, threshold: float) -> list[str]:
    return (
        [cte("links", f"SELECT i, j, score FROM blocked WHERE score > {threshold}")]
        + components("linked", "links")
        + [
            cte(
                "confidence",
                """SELECT node, avg(score) AS confidence FROM (SELECT i AS node, score FROM links
UNION ALL SELECT j, score FROM links) GROUP BY node""",
            ),
            cte(
                "clusters",
                f"""SELECT coalesce(component, {record_id}) AS cluster_id, {record_id} AS record_id,
  coalesce(confidence, 1.0) AS confidence_score
FROM {record_table} LEFT JOIN linked ON linked.node = {record_id}
LEFT JOIN confidence ON confidence.node = {record_id}""",
            ),
        ]
    )


_D_FIELDS = ["source_description", "document_number", "source_company", "target_id", "n_chars"]
D_CANDIDATES = (
    D + candidates("texts", "row_id", 0.5) + blocked(_D_FIELDS, [("source_description",)], "texts", "row_id")
)
D_CLUSTERS = (
    D_CANDIDATES
    + clusters("texts", "row_id", 0.9)
    + [
        cte(
            "headers",
            """SELECT cluster_id, count(*) AS records, count(DISTINCT document_number) AS documents,
  count(DISTINCT source_company) AS companies FROM clusters JOIN texts ON row_id = record_id
GROUP BY cluster_id""",
        )
    ]
)


def features(fields: list[tuple[str, str]], record_table: str, pair_table: str) -> tuple[list[str], str]:
    """CTEs and select list of pair features; ``fields`` are ``(name, kind)``."""
    ctes, columns, joins = [], [], []
    for n, (name, kind) in enumerate(fields):
        absent = f"(coalesce(a.{name}, '') IN ('', 'MISSING') OR coalesce(b.{name}, '') IN ('', 'MISSING'))"
        if kind == "text":
            ctes += bigrams(f"f{n}", record_table, "record_id", name)
            ctes.append(
                cte(
                    f"f{n}_dot",
                    f"""SELECT p.i, p.j, CAST(sum(x.k * y.k) AS DOUBLE)
  / (any_value(u.len) * any_value(v.len)) AS near
FROM {pair_table} p JOIN f{n}_post x ON x.row_id = p.i
JOIN f{n}_post y ON y.row_id = p.j AND y.term = x.term
JOIN f{n}_len u ON u.row_id = p.i JOIN f{n}_len v ON v.row_id = p.j GROUP BY p.i, p.j""",
                )
            )
            joins.append(f"LEFT JOIN f{n}_dot ON f{n}_dot.i = p.i AND f{n}_dot.j = p.j")
            near = f"coalesce(f{n}_dot.near, 0.0)"
        else:
            near = (
                f"1 - levenshtein(a.{name}, b.{name}) / greatest(length(a.{name}), length(b.{name}))"
            )
        columns.append(
            f"round(CASE WHEN {absent} THEN 0.0 WHEN a.{name} = b.{name} THEN 1.0 ELSE {near} END, 6)"
            f" AS {name}_similarity, CAST({absent} AS INTEGER) AS {name}_missing"
        )
    select = (
        f"SELECT p.i, p.j, {', '.join(columns)} FROM {pair_table} p "
        f"JOIN {record_table} a ON a.record_id = p.i JOIN {record_table} b ON b.record_id = p.j "
        + " ".join(joins)
    )
    return ctes, select


_R_FIELDS = [(c, "text") for c in _CLEANED] + [("document_number", "string")]
_r_pairs = (
    RECORDS
    + candidates("records", "record_id", 0.7)
    + blocked(
        [*_CLEANED, "document_number", "source_company"],
        [("source_description", "target_id"), ("source_description", "document_number")],
    )
)
_r_features = features(_R_FIELDS, "records", "blocked")
_d_records = D_CANDIDATES + [cte("text_records", "SELECT *, row_id AS record_id FROM texts")]
_d_features = features(
    [("source_description", "text"), ("document_number", "string")], "text_records", "blocked"
)

# Average linkage: one best pair a step, from all scores of the clusters that are left.
_BEST = """SELECT u AS lo, v AS hi, nu + nv AS n FROM step
  WHERE kind = 0 AND w / (nu * nv * 1e9) > {cut} ORDER BY w / (nu * nv * 1e9) DESC, u, v LIMIT 1"""


def average_linkage(cut: float) -> list[str]:
    """``units(node, n)`` of equal texts, and ``placed(node, cluster, n)`` from ``c_pairs`` and ``texts``."""
    best = _BEST.format(cut=cut)
    return [
        cte("units", "SELECT source_description, min(row_id) AS node, count(*) AS n FROM texts GROUP BY ALL"),
        cte(
            "start",
            """SELECT 0 AS k, 0 AS kind, i AS u, j AS v, CAST(round(score * 1e9) * a.n * b.n AS DOUBLE) AS w,
  a.n AS nu, b.n AS nv FROM c_pairs JOIN units a ON a.node = i JOIN units b ON b.node = j
UNION ALL SELECT 0, 1, node, node, 0, 0, 0 FROM units""",
        ),
        f"""step AS (
SELECT * FROM start
UNION ALL
SELECT k + 1, kind, u, v, sum(w), max(nu), max(nv) FROM (
  SELECT k, 0 AS kind, least(a, b) AS u, greatest(a, b) AS v, w,
    CASE WHEN a < b THEN na ELSE nb END AS nu, CASE WHEN a < b THEN nb ELSE na END AS nv
  FROM (
    SELECT s.k, s.w, CASE WHEN s.u = m.hi THEN m.lo ELSE s.u END AS a, CASE WHEN s.v = m.hi THEN m.lo ELSE s.v END AS b,
      CASE WHEN s.u IN (m.lo, m.hi) THEN m.n ELSE s.nu END AS na,
      CASE WHEN s.v IN (m.lo, m.hi) THEN m.n ELSE s.nv END AS nb
    FROM step s, ({best}) m WHERE s.kind = 0)
  WHERE a <> b
  UNION ALL
  SELECT s.k, 1, s.u, CASE WHEN s.v = m.hi THEN m.lo ELSE s.v END, 0, 0, 0 FROM step s, ({best}) m WHERE s.kind = 1)
GROUP BY k, kind, u, v
)""",
        cte(
            "placed",
            """SELECT u AS node, v AS cluster, n, source_description FROM step JOIN units ON node = u
WHERE kind = 1 AND k = (SELECT max(k) FROM step)""",
        ),
        cte(
            "given",
            """SELECT node, sum(s) AS s FROM (
  SELECT i AS node, score * b.n AS s FROM c_pairs JOIN placed a ON a.node = i JOIN placed b ON b.node = j
  WHERE a.cluster = b.cluster
  UNION ALL
  SELECT j, score * a.n FROM c_pairs JOIN placed a ON a.node = i JOIN placed b ON b.node = j
  WHERE a.cluster = b.cluster) GROUP BY node""",
        ),
        cte("totals", "SELECT cluster, sum(n) AS records FROM placed GROUP BY cluster"),
    ]


# Block predicates: keys of the records of ``texts`` in long form.
_WORDS = r"list_filter(regexp_split_to_array(lower(source_description), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
PREDICATES = D + [
    cte("word_list", f"SELECT row_id, {_WORDS} AS w FROM texts WHERE coalesce(source_description, '') NOT IN ('', 'MISSING')"),
    cte("held", "SELECT DISTINCT row_id, unnest(w) AS word FROM word_list"),
    cte("shared", "SELECT word, count(*) AS n FROM held GROUP BY word HAVING count(*) > 1"),
    cte(
        "keys",
        """SELECT row_id, 'whole_source_description' AS predicate, source_description AS key FROM texts
UNION ALL SELECT row_id, 'prefix_source_description_8', left(lower(source_description), 8) FROM texts
UNION ALL SELECT row_id, 'prefix_source_description_20', left(lower(source_description), 20) FROM texts
UNION ALL SELECT row_id, 'first_words_source_description_5', array_to_string(w[1:5], ' ') FROM word_list WHERE len(w) >= 5
UNION ALL (SELECT row_id, 'rare_source_description', word FROM held JOIN shared USING (word)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n, word) = 1)
UNION ALL SELECT row_id, 'whole_document_number', document_number FROM texts""",
    ),
    cte("keyed", "SELECT * FROM keys WHERE key NOT IN ('', 'MISSING')"),
    cte("block_sizes", "SELECT predicate, key, count(*) AS n FROM keyed GROUP BY ALL HAVING count(*) > 1"),
    cte(
        "costs",
        """SELECT predicate, count(*) AS blocks, max(n) AS largest, CAST(sum(n * (n - 1) / 2) AS DOUBLE) AS comparisons
FROM block_sizes GROUP BY predicate""",
    ),
]
_FOUND = LABELLED + [
    cte(
        "hits",
        """SELECT a.predicate, k1, k2 FROM (SELECT DISTINCT k1, k2 FROM labelled WHERE is_match)
JOIN keyed a ON a.row_id = k1 JOIN keyed b ON b.row_id = k2 AND b.predicate = a.predicate AND b.key = a.key""",
    )
]

# Evaluation: clusters from the groups at 0.9, truth from the labelled pairs.
CLUSTERED = D_PAIRS + [above("t_pairs", 0.9)] + components("groups", "edges") + [
    cte("found", "SELECT node AS item_key, component AS cluster_id FROM groups")
]
JUDGED = (
    CLUSTERED
    + LABELLED
    + [
        cte(
            "judged",
            """SELECT is_match, k1, k2, coalesce(a.cluster_id = b.cluster_id AND k1 <> k2, false) AS predicted
FROM labelled LEFT JOIN found a ON a.item_key = k1 LEFT JOIN found b ON b.item_key = k2""",
        )
    ]
)
CONFUSION = JUDGED + [
    cte(
        "confusion",
        """SELECT count(*) FILTER (is_match AND predicted) AS true_positives,
  count(*) FILTER (NOT is_match AND predicted) AS false_positives,
  count(*) FILTER (is_match AND NOT predicted) AS false_negatives,
  count(*) FILTER (NOT is_match AND NOT predicted) AS true_negatives FROM judged""",
    ),
    cte(
        "pairwise",
        """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1_score FROM (SELECT *,
  CASE WHEN true_positives + false_positives > 0
    THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS precision,
  CASE WHEN true_positives + false_negatives > 0
    THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS recall,
  (true_positives + true_negatives) / (true_positives + true_negatives + false_positives
    + false_negatives) AS accuracy FROM confusion)""",
    ),
]
TRUTH = [
    cte("matches", "SELECT k1 AS i, k2 AS j FROM labelled WHERE is_match"),
    *components("truth_groups", "matches"),
    cte("items", "SELECT k1 AS item_key FROM labelled UNION SELECT k2 FROM labelled"),
    cte(
        "truth",
        """SELECT item_key, coalesce(component, item_key) AS cluster_id FROM items
LEFT JOIN truth_groups ON node = item_key""",
    ),
]
CELLS = [
    cte(
        "cells",
        """SELECT t.cluster_id AS truth_id, f.cluster_id AS cluster_id, count(*) AS n
FROM truth t JOIN found f USING (item_key) GROUP BY ALL""",
    )
]
METRICS = [
    cte("total", "SELECT CAST(sum(n) AS DOUBLE) AS n FROM cells"),
    cte("by_truth", "SELECT truth_id, CAST(sum(n) AS DOUBLE) AS a FROM cells GROUP BY truth_id"),
    cte("by_found", "SELECT cluster_id, CAST(sum(n) AS DOUBLE) AS b FROM cells GROUP BY cluster_id"),
    cte(
        "parts",
        """SELECT
 (SELECT sum(c.n / t.n * ln(t.n * c.n / (a * b))) FROM cells c, total t, by_truth x, by_found y
   WHERE x.truth_id = c.truth_id AND y.cluster_id = c.cluster_id) AS mi,
 (SELECT -sum(a / t.n * ln(a / t.n)) FROM by_truth, total t) AS ht,
 (SELECT -sum(b / t.n * ln(b / t.n)) FROM by_found, total t) AS hf,
 (SELECT sum(n * (n - 1) / 2) FROM cells) AS pc,
 (SELECT sum(a * (a - 1) / 2) FROM by_truth) AS pt,
 (SELECT sum(b * (b - 1) / 2) FROM by_found) AS pf,
 (SELECT n * (n - 1) / 2 FROM total) AS pn""",
    ),
    cte(
        "metrics",
        """SELECT (pc - pt * pf / pn) / ((pt + pf) / 2 - pt * pf / pn) AS adjusted_rand_index,
  mi / ((ht + hf) / 2) AS normalized_mutual_info, mi / ht AS homogeneity, mi / hf AS completeness,
  2 * (mi / ht) * (mi / hf) / (mi / ht + mi / hf) AS v_measure FROM parts""",
    ),
]
_METRIC_NAMES = [
    "adjusted_rand_index",
    "normalized_mutual_info",
    "homogeneity",
    "completeness",
    "v_measure",
]
_RATES = ["precision", "recall", "f1_score", "accuracy"]
_COUNTS = "true_positives, false_positives, false_negatives, true_negatives"


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _cut(column: str, width: int = 100) -> str:
    return (
        f"CASE WHEN length({column}) > {width} THEN left({column}, {width}) || '...' ELSE {column} END"
    )


_EXAMPLE = """SELECT '{kind}' AS kind, k1, k2 FROM (SELECT * FROM judged WHERE {rule}
  ORDER BY k1, k2 LIMIT 3)"""
_EXAMPLES = "\nUNION ALL\n".join(
    _EXAMPLE.format(kind=k, rule=r)
    for k, r in [
        ("true_positive", "is_match AND predicted"),
        ("false_positive", "NOT is_match AND predicted"),
        ("false_negative", "is_match AND NOT predicted"),
    ]
)
_PROMPT = "string_agg({line}, '{sep}' ORDER BY ordinal)"

CONTENT = [
    cte(
        "before",
        """SELECT DISTINCT text FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' (draft)' END AS text
  FROM documents) WHERE text IS NOT NULL""",
    )
]
_KEY = "concat_ws('||', " + ", ".join(
    rf"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
    for c in ("source_id", "source_description", "target_id", "document_number")
) + ")"
KEYED = [
    *R,
    *UNFILTERED,
    cte("keyed", f"SELECT row_id, source_id, source_description, document_number, {_KEY} AS item_key FROM unfiltered"),
    cte(
        "key_pairs",
        """SELECT DISTINCT is_match, least(a, b) AS k1, greatest(a, b) AS k2 FROM (
  SELECT true AS is_match, first_value(item_key) OVER w AS a, item_key AS b, row_number() OVER w > 1 AS later
  FROM keyed WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY row_id)
  UNION ALL
  SELECT false, first_value(item_key) OVER w, item_key, first_value(source_id) OVER w <> source_id
  FROM keyed WHERE document_number IS NOT NULL WINDOW w AS (PARTITION BY document_number ORDER BY row_id)
) WHERE later""",
    ),
    cte("key_items", "SELECT k1 AS item_key FROM key_pairs UNION SELECT k2 FROM key_pairs"),
    cte(
        "key_clusters",
        """SELECT item_key, max(cluster_id) AS cluster_id FROM (SELECT item_key, min(row_id) OVER
  (PARTITION BY source_description) AS cluster_id FROM keyed WHERE source_description IS NOT NULL) GROUP BY item_key""",
    ),
]

ORACLES: dict[str, str] = {
    "R_relationships": RELATIONSHIPS,
    "V_parse_vectors": """SELECT vec_id AS row_id, len(embedding) AS dimension,
  round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""",
    "D_embed_incremental": """SELECT doc_id AS row_id, CASE WHEN length(text) >= 1000 THEN 'stored'
  ELSE 'hashed_bigrams_256' END AS embedding_provider, CAST(256 AS INTEGER) AS embedding_dimension
FROM documents WHERE text IS NOT NULL""",
    "R_combined": statement(COMBINED, "SELECT * FROM combined"),
    "R_text_to_compare": statement(COMBINED, "SELECT row_id, text_to_compare FROM combined"),
    "R_unfiltered": statement(R + UNFILTERED, "SELECT * FROM unfiltered"),
    "R_focus_documents": statement(
        R + [cte("comparison", _COMPARISON)],
        """SELECT row_id, document_number, target_id, target_english_id FROM comparison
WHERE document_number IN (SELECT document_number FROM comparison WHERE target_id = 'S0'
  OR source_id = 'S0' OR target_english_id ILIKE '%Supplier#000000000%'
  OR source_english_id ILIKE '%Supplier#000000000%' OR target_description ILIKE '%Supplier#000000000%'
  OR source_description ILIKE '%Supplier#000000000%'
  OR relationship_description ILIKE '%Supplier#000000000%')""",
    ),
    "R_key_complete": statement(
        COMPLETE, "SELECT row_id, source_id, source_english_id, source_description FROM complete"
    ),
    "R_key_complete_stats": statement(
        COMPLETE,
        """SELECT (SELECT count(*) FROM innovations) AS total, (SELECT count(*) FROM complete) AS complete,
  (SELECT count(*) FROM innovations) - (SELECT count(*) FROM complete) AS removed""",
    ),
    "R_linkage_records": statement(RECORDS, "SELECT * FROM records"),
    "R_nul_violations": statement(
        RECORDS,
        "SELECT record_id, field FROM (SELECT record_id, unnest(["
        + ", ".join(f"CASE WHEN contains({c}, chr(0)) THEN '{c}' END" for c in _CLEANED)
        + "]) AS field FROM records) WHERE field IS NOT NULL",
    ),
    "R_clean_text": statement(
        R + UNFILTERED,
        f"""SELECT row_id, {clean('source_description')} AS source_description,
  {clean('target_english_id')} AS target_english_id, {clean('target_description')} AS target_description
FROM unfiltered""",
    ),
    "D_clean_text": f"SELECT doc_id AS row_id, {clean('text')} AS cleaned FROM documents",
    "D_embed_changes": statement(
        CONTENT,
        """SELECT count(*) FILTER (o AND n) AS kept, count(*) FILTER (n AND NOT o) AS added,
  count(*) FILTER (o AND NOT n) AS removed FROM (SELECT a.text IS NOT NULL AS o, b.text IS NOT NULL AS n
    FROM before a FULL JOIN (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) b ON a.text = b.text)""",
    ),
    "D_embed_content": statement(
        CONTENT,
        """SELECT doc_id AS row_id, sha256(text) AS text_digest, text IN (FROM before) AS reused,
  CAST(64 AS INTEGER) AS embedding_dimension FROM documents WHERE text IS NOT NULL""",
    ),
    "E_key_pairs": statement(KEYED, "SELECT is_match, k1, k2 FROM key_pairs"),
    "E_key_truth": statement(
        KEYED,
        """SELECT item_key, min(item_key) OVER (PARTITION BY s) AS cluster_id FROM
  (SELECT item_key, min(coalesce(source_id, item_key)) AS s FROM keyed
   WHERE item_key IN (SELECT k1 FROM key_pairs UNION SELECT k2 FROM key_pairs) GROUP BY item_key)""",
    ),
    "E_key_confusion": statement(
        KEYED,
        """SELECT count(*) FILTER (is_match AND p) AS true_positives, count(*) FILTER (NOT is_match AND p) AS false_positives,
  count(*) FILTER (is_match AND NOT p) AS false_negatives, count(*) FILTER (NOT is_match AND NOT p) AS true_negatives
FROM (SELECT is_match, k1 <> k2 AND coalesce(a.cluster_id = b.cluster_id, false) AS p FROM key_pairs
  LEFT JOIN key_clusters a ON a.item_key = k1 LEFT JOIN key_clusters b ON b.item_key = k2)""",
    ),
    "E_key_overlap": statement(
        KEYED,
        """SELECT *, round(overlap_items * 100.0::DOUBLE / truth_items, 6) AS overlap_percent FROM (SELECT
  (SELECT count(*) FROM key_items) AS truth_items, (SELECT count(*) FROM key_clusters) AS clustered_items,
  (SELECT count(*) FROM key_items JOIN key_clusters USING (item_key)) AS overlap_items)""",
    ),
    "E_composite_key": statement(
        R + UNFILTERED,
        "SELECT row_id, concat_ws('||', "
        + ", ".join(
            rf"regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
            for c in ("source_id", "source_description", "target_id", "document_number")
        )
        + ") AS item_key FROM unfiltered",
    ),
    "V_embedding_metadata": """SELECT vec_id AS row_id, 'table' AS embedding_provider,
  CAST(len(embedding) AS INTEGER) AS embedding_dimension FROM embeddings""",
    "V_similar_pairs": statement(V, "SELECT i, j, round(score, 6) AS score FROM v_pairs WHERE score > 0.4"),
    "V_similar_pairs_pruned": statement(V, "SELECT i, j, round(score, 6) AS score FROM v_pairs WHERE score > 0.4"),
    "V_groups_pruned": statement(V_GROUPS, "SELECT component AS group_id, node AS member_id FROM groups"),
    "D_similar_pairs": statement(D_FIRST_PAIRS, "SELECT i, j, round(score, 6) AS score FROM t_pairs"),
    "R_similar_pairs": statement(R_PAIRS, "SELECT i, j, round(score, 6) AS score FROM t_pairs"),
    "R_dedup_first": statement(R_FIRST, "SELECT row_id, document_number, source_description FROM firsts"),
    "D_dedup_first": statement(D_FIRST, "SELECT row_id, document_number, n_chars FROM firsts"),
    "R_exact_duplicates": statement(
        COMBINED,
        """SELECT row_id, document_number, source_description FROM combined
QUALIFY count(*) OVER (PARTITION BY source_description) > 1""",
    ),
    "D_exact_duplicates": statement(
        D,
        """SELECT row_id, document_number, n_chars FROM texts
QUALIFY count(*) OVER (PARTITION BY source_description) > 1""",
    ),
    "V_groups": statement(V_GROUPS, "SELECT component AS group_id, node AS member_id FROM groups"),
    "D_groups": statement(D_GROUPS, "SELECT component AS group_id, node AS member_id FROM groups"),
    "D_groups_dedup": statement(
        D_FIRST_PAIRS + [above("t_pairs", 0.8)] + components("groups", "edges"),
        "SELECT component AS group_id, node AS member_id FROM groups",
    ),
    "R_groups": statement(R_GROUPS, "SELECT component AS group_id, node AS member_id FROM groups"),
    "V_sweep_pairs": sweep_pairs(V, "v_pairs", 0.36, 0.6),
    "V_sweep_groups": sweep_groups(V, "v_pairs", 0.36, 0.6),
    "D_sweep_pairs": sweep_pairs(D_FIRST_PAIRS, "t_pairs", 0.6, 0.99),
    "D_sweep_groups": sweep_groups(D_FIRST_PAIRS, "t_pairs", 0.6, 0.99),
    "R_group_sample": statement(
        R_GROUPS
        + [
            cte(
                "drawn",
                """SELECT component FROM (SELECT DISTINCT component FROM groups)
ORDER BY md5('42-' || CAST(component AS VARCHAR)) LIMIT 5""",
            )
        ],
        """SELECT component AS group_id, row_id, left(text_to_compare, 100) || '...' AS text
FROM groups JOIN drawn USING (component) JOIN firsts ON row_id = node""",
    ),
    "V_cosine": """SELECT a.vec_id AS row_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
  CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "D_text_vectors": statement(D + bigrams("t", "texts"), "SELECT row_id, term, k FROM t_post"),
    "V_points_by_group": statement(
        V_GROUPS,
        """SELECT vec_id AS row_id, coalesce(component, -1) AS group_id FROM embeddings
LEFT JOIN groups ON node = vec_id""",
    ),
    "R_validation_prompts": statement(
        MEMBERS,
        """SELECT group_id, CAST(floor((ordinal - 1) / 500) AS INTEGER) AS part,
  string_agg(ordinal || '. ' || coalesce(text_to_compare, '') || chr(10) || chr(10), '' ORDER BY ordinal)
    AS prompt FROM members GROUP BY ALL""",
    ),
    "R_verdicts": statement(KEPT, "SELECT group_id, ordinal FROM wrong"),
    "R_validated_members": statement(KEPT, "SELECT group_id, row_id, ordinal FROM kept"),
    "R_validated_groups": statement(
        KEPT,
        """SELECT group_id, row_id, document_number, source_id, source_english_id, source_description,
  relationship_description, target_id, target_english_id, target_description, text_to_compare FROM kept""",
    ),
    "R_summary_prompts": statement(
        KEPT,
        """SELECT group_id, CAST(floor((ordinal - 1) / 500) AS INTEGER) AS part,
  string_agg(ordinal || '. ' || coalesce(source_english_id, '') || ': '
    || coalesce(source_description, '') || '. ' || coalesce(relationship_description, ''), chr(10)
    ORDER BY ordinal) AS prompt FROM kept GROUP BY ALL""",
    ),
    "R_summaries": statement(
        KEPT
        + [
            cte("summary", _SUMMARY),
            cte(
                "titles",
                """SELECT group_id, source_english_id AS title FROM (SELECT *, row_number() OVER
  (PARTITION BY group_id ORDER BY coalesce(length(source_description), 0) DESC, row_id) AS rn FROM kept)
WHERE rn = 1""",
            ),
        ],
        "SELECT group_id, part, title, description FROM summary JOIN titles USING (group_id)",
    ),
    "R_canonical_member": statement(MEMBERS, "SELECT group_id, canonical_id FROM canonical"),
    "R_group_documents": statement(RAW_DOCS, "SELECT group_id, document_number FROM group_docs"),
    "R_group_relationships": statement(
        RAW_DOCS,
        """SELECT group_id, relationship_type, count(*) AS relationships,
  count(DISTINCT row_id) AS distinct_rows
FROM group_docs JOIN unfiltered USING (document_number) GROUP BY ALL""",
    ),
    "R_collaborations": statement(
        R + UNFILTERED + MENTIONS,
        """SELECT row_id, document_number, org_id, org_name, partner AS collaboration_partner FROM sides""",
    ),
    "R_org_profile": statement(RAW_DOCS + MENTIONS + PROFILES, "SELECT * FROM profiles"),
    "R_focus_role": statement(
        RAW_DOCS + MENTIONS + PROFILES + ROLES, "SELECT group_id, focus_role FROM roles"
    ),
    "R_unified_organizations": statement(UNIFIED + PROFILES, "SELECT * FROM profiles"),
    "R_unified_mentions": statement(
        UNIFIED,
        """SELECT group_id, row_id, side, org_id, CASE WHEN dev THEN 'DEVELOPED_BY' ELSE 'COLLABORATION' END
  AS relationship_type, document_number FROM group_docs JOIN mentions USING (document_number)""",
    ),
    "R_unified": statement(
        UNIFIED
        + PROFILES
        + ROLES
        + [
            cte(
                "titles",
                """SELECT group_id, source_english_id AS title, source_description AS description FROM (SELECT *, row_number() OVER
  (PARTITION BY group_id ORDER BY coalesce(length(source_description), 0) DESC, row_id) AS rn FROM kept)
WHERE rn = 1""",
            ),
            cte("sizes", "SELECT group_id, count(*) AS total_mentions FROM kept GROUP BY group_id"),
            cte(
                "orgs",
                """SELECT group_id, count(*) FILTER (developed_by) AS developers,
  count(*) FILTER (collaboration) AS collaborators FROM profiles GROUP BY group_id""",
            ),
            cte(
                "papers",
                """SELECT group_id, count(*) AS documents FROM group_docs
WHERE document_number IN (SELECT document_number FROM mentions) GROUP BY group_id""",
            ),
        ],
        """SELECT group_id, 'innovation_group_' || group_id AS group_name, title AS canonical_name,
  description AS canonical_description, total_mentions, coalesce(developers, 0) AS developers,
  coalesce(collaborators, 0) AS collaborators, focus_role, coalesce(documents, 0) AS documents
FROM sizes JOIN roles USING (group_id) LEFT JOIN titles USING (group_id)
LEFT JOIN orgs USING (group_id) LEFT JOIN papers USING (group_id)""",
    ),
    "R_unified_aliases": statement(KEPT, "SELECT group_id, row_id, source_english_id AS alias FROM kept"),
    "R_unified_documents": statement(
        UNIFIED,
        """SELECT group_id, document_number FROM group_docs
WHERE document_number IN (SELECT document_number FROM mentions)""",
    ),
    "R_network_nodes": statement(
        R + UNFILTERED,
        """SELECT node_id, kind, min(name) AS name, count(*) AS degree FROM (
  SELECT source_id AS node_id, coalesce(source_type, 'Unknown') AS kind, source_english_id AS name
  FROM unfiltered
  UNION ALL SELECT target_id, 'Organization', target_english_id FROM unfiltered)
WHERE node_id IS NOT NULL GROUP BY node_id, kind""",
    ),
    "R_network_edges": statement(
        R + UNFILTERED,
        """SELECT source_id, target_id, relationship_type, count(*) AS weight,
  count(DISTINCT document_number) AS documents FROM unfiltered
WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL""",
    ),
    "R_sample_size": statement(
        RECORDS,
        """SELECT records, CAST(least(15000, records * (records - 1) // 4) AS BIGINT) AS sample_size
FROM (SELECT count(*) AS records FROM records)""",
    ),
    "R_pair_features": statement(_r_pairs + _r_features[0], _r_features[1]),
    "R_candidates_blocked": statement(_r_pairs, "SELECT i, j, round(score, 6) AS cosine FROM blocked"),
    "R_linkage_report": statement(
        _r_pairs + clusters("records", "records.record_id", 0.7),
        f"""SELECT cluster_id, c.record_id, round(confidence_score, 6) AS confidence_score,
  document_number, source_company, source_id, source_english_id,
  {_cut('source_description')} AS source_description, target_english_id
FROM clusters c JOIN records r ON r.record_id = c.record_id""",
    ),
    "D_candidates_blocked": statement(
        D_CANDIDATES, "SELECT i, j, round(score, 6) AS cosine FROM blocked"
    ),
    "D_pair_features": statement(_d_records + _d_features[0], _d_features[1]),
    "D_optimal_threshold": statement(
        D_CANDIDATES
        + [
            cte(
                "runs",
                """SELECT score, sum(n) OVER w AS k, sum(e) OVER w AS e, sum(e) OVER () AS total FROM (
  SELECT score, count(*) AS n, sum(score) AS e FROM blocked GROUP BY score)
WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
            )
        ],
        """SELECT round(score, 6) AS threshold, round(value, 6) AS value FROM (
  SELECT score, 2 * (e / k) * (e / total) / ((e / k) + (e / total)) AS value FROM runs)
ORDER BY value DESC, score DESC LIMIT 1""",
    ),
    "D_linkage_clusters": statement(
        D_CLUSTERS,
        "SELECT cluster_id, record_id, round(confidence_score, 6) AS confidence_score FROM clusters",
    ),
    "D_linkage_average": statement(
        D_CANDIDATES + average_linkage(0.7),
        """SELECT cluster AS cluster_id, row_id AS record_id,
  round(CASE WHEN records > 1 THEN (coalesce(s, 0.0) + n - 1) / (records - 1) ELSE 1.0 END, 6) AS confidence_score
FROM texts t JOIN placed p ON p.source_description IS NOT DISTINCT FROM t.source_description
JOIN totals USING (cluster) LEFT JOIN given USING (node)""",
    ),
    "D_predicate_costs": statement(
        PREDICATES + _FOUND,
        """SELECT predicate, coalesce(blocks, 0) AS blocks, coalesce(largest, 0) AS largest,
  coalesce(comparisons, 0.0) AS comparisons, (SELECT count(*) FROM hits h WHERE h.predicate = p.predicate) AS matches
FROM (SELECT DISTINCT predicate FROM keys) p LEFT JOIN costs USING (predicate)""",
    ),
    "D_predicate_pairs": statement(
        PREDICATES
        + [
            cte("classes", f"SELECT row_id, min(row_id) OVER (PARTITION BY {', '.join(_D_FIELDS)}) AS head FROM texts"),
            cte(
                "used",
                """SELECT * FROM keyed JOIN classes USING (row_id)
WHERE predicate IN ('rare_source_description', 'prefix_source_description_20')""",
            ),
        ],
        """SELECT DISTINCT a.row_id AS i, b.row_id AS j FROM used a JOIN used b USING (predicate, key)
WHERE a.row_id < b.row_id AND a.row_id = a.head AND b.row_id = b.head
UNION SELECT head, row_id FROM used WHERE row_id <> head""",
    ),
    "D_label_candidates": statement(
        D_CANDIDATES + LABELLED,
        """SELECT i, j, round(score, 6) AS score FROM blocked
ANTI JOIN labelled ON k1 = i AND k2 = j ORDER BY abs(score - 0.5), i, j LIMIT 20""",
    ),
    "D_cluster_header": statement(D_CLUSTERS, "SELECT * FROM headers"),
    "D_cluster_size_stats": statement(
        D_CLUSTERS,
        """SELECT count(*) AS count, round(avg(records), 6) AS mean, round(stddev_samp(records), 6) AS std,
  min(records) AS min, quantile_cont(records, 0.25) AS p25, quantile_cont(records, 0.5) AS p50,
  quantile_cont(records, 0.75) AS p75, max(records) AS max FROM headers""",
    ),
    "D_cross_document": statement(
        D_CLUSTERS,
        """SELECT count(*) FILTER (documents > 1) AS cross_document_clusters,
  count(*) FILTER (documents <= 1) AS same_document_clusters,
  round(count(*) FILTER (documents > 1) * 100.0::DOUBLE / count(*), 6) AS cross_document_percent
FROM headers""",
    ),
    "D_duplicates_summary": statement(
        D_CLUSTERS,
        """SELECT CAST(sum(records) AS BIGINT) AS total_duplicate_records, count(*) AS total_clusters,
  count(*) FILTER (documents > 1) AS cross_document_clusters,
  round(avg(records), 6) AS average_cluster_size FROM headers""",
    ),
    "D_first_clusters": statement(
        D_CLUSTERS,
        """SELECT cluster_id, record_id, document_number FROM clusters JOIN texts ON row_id = record_id
WHERE cluster_id IN (SELECT DISTINCT cluster_id FROM clusters ORDER BY cluster_id LIMIT 5)""",
    ),
    "E_labelled_pairs": LABELS,
    "E_truth_pairs": LABELS,
    "E_label_summary": statement(
        LABELLED,
        """SELECT count(*) FILTER (is_match) AS match_pairs, count(*) FILTER (NOT is_match) AS distinct_pairs,
  count(*) AS total_pairs, round(count(*) FILTER (is_match) * 100.0::DOUBLE / count(*), 6) AS match_percent
FROM labelled""",
    ),
    "E_label_samples": statement(
        LABELLED,
        f"""SELECT is_match, k1, k2, {_cut('a.text', 50)} AS item_1, {_cut('b.text', 50)} AS item_2
FROM (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY is_match ORDER BY k1, k2) <= 3)
JOIN documents a ON a.doc_id = k1 JOIN documents b ON b.doc_id = k2""",
    ),
    "E_item_cluster": statement(CLUSTERED, "SELECT item_key, cluster_id FROM found"),
    "E_predicted_pairs": statement(
        CLUSTERED,
        """SELECT cluster_id, items, coalesce(predicted_pairs, 0) AS predicted_pairs FROM
  (SELECT cluster_id, count(*) AS items FROM found GROUP BY cluster_id) LEFT JOIN
  (SELECT a.cluster_id, count(*) AS predicted_pairs FROM found a JOIN found b
     ON a.cluster_id = b.cluster_id AND a.item_key < b.item_key GROUP BY a.cluster_id)
USING (cluster_id)""",
    ),
    "E_confusion": statement(CONFUSION, "SELECT * FROM confusion"),
    "E_pairwise_metrics": statement(CONFUSION, f"SELECT {_rounded(_RATES)}, {_COUNTS} FROM pairwise"),
    "E_truth_clusters": statement(LABELLED + TRUTH, "SELECT item_key, cluster_id FROM truth"),
    "E_contingency": statement(
        CLUSTERED + LABELLED + TRUTH + CELLS, "SELECT truth_id, cluster_id, n FROM cells"
    ),
    "E_cluster_metrics": statement(
        CLUSTERED + LABELLED + TRUTH + CELLS + METRICS, f"SELECT {_rounded(_METRIC_NAMES)} FROM metrics"
    ),
    "E_overlap": statement(
        CLUSTERED + LABELLED + TRUTH,
        """SELECT *, round(overlap_items * 100.0::DOUBLE / truth_items, 6) AS overlap_percent FROM (SELECT
  (SELECT count(*) FROM items) AS truth_items, (SELECT count(*) FROM found) AS clustered_items,
  (SELECT count(*) FROM items JOIN found USING (item_key)) AS overlap_items)""",
    ),
    "E_examples": statement(
        JUDGED + [cte("examples", _EXAMPLES)],
        f"""SELECT kind, k1, k2, {_cut('a.text')} AS item_1, {_cut('b.text')} AS item_2 FROM examples
JOIN documents a ON a.doc_id = k1 JOIN documents b ON b.doc_id = k2""",
    ),
    "E_report": statement(
        CONFUSION + TRUTH + CELLS + METRICS,
        f"""SELECT {_rounded(_RATES)}, {_COUNTS}, {_rounded(_METRIC_NAMES)},
  (SELECT count(DISTINCT cluster_id) FROM found) AS total_clusters,
  (SELECT count(*) FROM found) AS total_items,
  (SELECT count(*) FROM labelled WHERE is_match) AS ground_truth_positive_pairs,
  (SELECT count(*) FROM labelled WHERE NOT is_match) AS ground_truth_negative_pairs,
  (SELECT count(*) FROM found a JOIN found b ON a.cluster_id = b.cluster_id AND a.item_key < b.item_key)
    AS predicted_pairs
FROM pairwise, metrics""",
    ),
}

ORACLES["R_resumed_answers"] = f"""SELECT group_id, part, length(prompt) || ' characters' AS reasoning,
  CAST(CASE WHEN sha256(prompt)[1] IN ('0', '1', '2', '3', '4') THEN 2 ELSE 1 END AS BIGINT) AS tries, true AS complete
FROM ({ORACLES["R_validation_prompts"]})"""
ORACLES["D_forest_levels"] = f"""SELECT threshold, CAST(round(mean_group_size * groups) - groups AS BIGINT) AS edges
FROM ({ORACLES["D_sweep_groups"]})"""
