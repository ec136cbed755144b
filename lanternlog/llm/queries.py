"""The registered queries of the package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lanternlog import session
from lanternlog.llm import (
    ctw,
    decontaminate,
    divergence,
    filter_audit,
    jaccard_join,
    licenses,
    main_text,
    mixing,
    neighbours,
    pii,
    quality,
    suffix_dedup,
    token_counts,
)

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.pin(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return add


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@_query(
    "op1_decontaminate",
    f"""
WITH d AS (SELECT doc_id, coalesce({_OP1_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_OP1_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("longest")


_OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT root, e.b FROM reach JOIN e ON e.a = node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON node = w.doc_id GROUP BY ALL
"""


@_query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


@_query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(_table(spark, sf_dir, "embeddings"))


_UNIT = """
SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 1, unnest(string_split_regex(text, '\\n[ \\t\\r\\x0B\\f]*\\n')) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, 2, text FROM documents WHERE text IS NOT NULL
"""
_OP8_WORDS = _OP1_WORDS.replace("text", "unit")


def _op8_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT license, {pairs} AS p FROM (SELECT license, {_OP8_WORDS} AS w FROM (VALUES {rows}) AS v(license, unit))),
u AS (SELECT doc_id, kind, {pairs} AS p FROM (SELECT doc_id, kind, {_OP8_WORDS} AS w FROM ({_UNIT}))),
m AS (
  SELECT doc_id, license, kind, 2.0::DOUBLE * len(list_intersect(u.p, t.p)) / (len(u.p) + len(t.p)) AS dice
  FROM u JOIN t ON list_has_any(u.p, t.p)),
b AS (
  SELECT doc_id, license, dice, kind,
    row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, kind) AS k FROM m WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, license, dice, CASE kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' ELSE 'text' END AS passage FROM b WHERE k = 1
"""


@_query("op8_licenses", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    weight = lambda level: "CASE {} {} ELSE 1 END".format(
        mixing.LEVELS[level], " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items()) or "WHEN NULL THEN 1"
    )
    number = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    sql = f"""
WITH counted AS (
  SELECT doc_id, CASE WHEN {number} = '' THEN 'other' ELSE 'domain' || CAST(CAST({number} AS INT) % 4 AS VARCHAR) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS n_tokens
  FROM documents WHERE text IS NOT NULL),
leaves AS (
  SELECT *, tokens * {mixing.MAX_EPOCHS} AS cap, {weight(0)} AS w0, {weight(1)} AS w1, {weight(2)} AS w2
  FROM (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted WHERE n_tokens > 0 GROUP BY ALL)),
n0 AS (SELECT CAST(least(sum(tokens) // {mixing.BUDGET_PARTS}, sum(cap)) AS BIGINT) AS given, 1 AS one FROM leaves)"""
    for level, name in enumerate(mixing.LEVELS):
        up = ", ".join(["one", *mixing.LEVELS[:level]])
        sql += f""",
c{level} AS (SELECT 1 AS one, {", ".join(mixing.LEVELS[: level + 1])}, CAST(sum(cap) AS BIGINT) AS cap, max(w{level}) AS w FROM leaves GROUP BY ALL),
r{level} AS (
  SELECT c{level}.*, given - coalesce(sum(cap) OVER (PARTITION BY {up} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (PARTITION BY {up} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww
  FROM c{level} JOIN n{level} USING ({up})),
f{level} AS (SELECT *, cap * ww <= w * rest AS whole FROM r{level}),
n{level + 1} AS (
  SELECT {up}, {name}, CAST(CASE WHEN whole THEN cap ELSE
    (w * first_value(rest) OVER (PARTITION BY {up} ORDER BY whole, cap / w, {name}))
    // first_value(ww) OVER (PARTITION BY {up} ORDER BY whole, cap / w, {name}) END AS BIGINT) AS given FROM f{level})"""
    return sql + f""",
drawn AS (
  SELECT counted.*, given // tokens AS epochs, given % tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{mixing.SEED}:' || CAST(given // tokens AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM counted JOIN leaves USING (domain, lang, source) JOIN n3 USING (domain, lang, source) WHERE n_tokens > 0 AND given > 0)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM drawn WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


@_query("op9_mixing", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@_query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_table(spark, sf_dir, "documents"), Path(VOCABULARY).read_bytes())


@_query("op5_ctw")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.report(_table(spark, sf_dir, "documents"))


@_query("op2_jaccard_join", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


@_query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


_OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
d AS (
  SELECT part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM t),
cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest(range(1, 6)) AS i),
o AS (
  SELECT '' AS names, []::BIGINT[] AS turn
  UNION ALL SELECT names || name, list_append(turn, i) FROM o, f WHERE NOT list_contains(turn, i)),
s AS (SELECT names, turn, unnest(range(1, 6)) AS step FROM o WHERE len(turn) = 5),
x AS (
  SELECT part, names, turn, step, n, good, toxic, fails[turn[step]] AS failing,
    list_bool_or(list_transform(turn[:step - 1], lambda i: fails[i])) IS TRUE AS gone,
    NOT list_bool_or(list_transform(list_filter([1, 2, 3, 4, 5], lambda i: i <> turn[step]), lambda i: fails[i])) AS alone
  FROM cell, s),
r AS (
  SELECT part, names AS filter_order, CAST(step AS INT) AS step, turn[step] AS i,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (failing AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, names, turn, step)
SELECT * EXCLUDE (i), CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM r
"""


@_query("op12_filter_audit", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, term, n_lang, 1 + 1000000000::HUGEINT * (n_lang + 1)
    // (sum(n_lang) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM k),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1)
    // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""


@_query("op13_divergence", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@_query("op11_main_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))
