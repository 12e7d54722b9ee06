"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowsmith.llm import (
    decontaminate,
    exact,
    language,
    licences,
    lines,
    manifest,
    mixing,
    near,
    packing,
    quality,
    repeats,
    secret_scan,
    variants,
)
from rowsmith.operators.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Words as the contracts define them; E'' holds the separators.
SQL_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SQL_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN least ON least.x = d.doc_id
"""


@query("op1_near_duplicates", NEAR_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


@query("op2_repeated_strings")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(documents(spark, sf_dir)).drop("spans")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(written(packing.measured(documents(spark, sf_dir))))


@query("op4_suffix_tree_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(documents(spark, sf_dir))


@query(
    "op5_exact_duplicates",
    r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir))


@query("op6_source_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


@query("op7_licence_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


@query("op8_quality_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.measured(documents(spark, sf_dir)))
    model = quality.learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.verdicts(rows, model).drop("accepted")


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents
), w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS wordy FROM l),
common AS (SELECT line, min(doc_id) AS keeper FROM w WHERE wordy GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (SELECT w.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM w LEFT JOIN common ON w.line = common.line AND wordy)
SELECT doc_id, count(*) FILTER (WHERE wordy) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op9_line_spread", LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup(documents(spark, sf_dir))
    return cleaned.selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256) AS kept_sha256")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.train(docs))


# DuckDB has no CRC-32: one step a byte over the table of the polynomial, which is made here by the same rule.
CRC_SQL = """
bits AS (SELECT i, 0 AS step, i AS v FROM range(256) AS r(i) UNION ALL
  SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8)"""


def sql_crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of an expression; needs CRC_SQL and a join with crc_table."""
    hexed = f"hex(encode({text}))"
    steps = f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


VARIANTS_SQL = rf"""
WITH RECURSIVE {CRC_SQL.strip()},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r WHERE length(run) >= 7),
h AS (SELECT run, {sql_crc("id || ':' || run")} AS h FROM l, crc_table),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.head || d.tail
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.head || d.tail
), best AS (SELECT word, count(*) AS n_near, max(n) AS m, arg_min(near, (-n, near)) AS near FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS stop, 0 AS step FROM f UNION ALL SELECT path.word, f.form, step + 1 FROM path JOIN f ON f.word = path.stop WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(stop, step) AS root FROM path GROUP BY word) USING (word)
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


_BENCHMARK_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_BENCHMARK_WORDS} AS w FROM benchmark),
i AS (SELECT item, least(len(w), 10) AS n, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS content FROM i),
places AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS content
  FROM (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, p.n, s, item FROM places p JOIN windows USING (content)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT r, n, s FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


@query("op12_benchmark_contamination", CONTAMINATION_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_leaf(text: str) -> str:
    fields = ", ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({fields}))"


def _sql_climb(name: str, ground: str) -> str:
    """All nodes over a ground (tree, i, n, digest), and beside each the siblings of its run."""
    beside = "coalesce(string_agg('64:' || digest, '') OVER (PARTITION BY tree, level, i // 3 ORDER BY i ROWS BETWEEN {}), '')"
    return f"""{name} AS (SELECT tree, 0 AS level, i, n, digest FROM {ground} UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg('64:' || digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_runs AS (SELECT tree, level, i, {beside.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS before, {beside.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS after
  FROM {name} WHERE n > 1)"""


def _sql_walk(name: str, start: str, runs: str) -> str:
    """The way of each row from its node to the root, with the digest that it comes to and the siblings passed."""
    return f"""{name} AS (SELECT r, tree, level, i, own, proof FROM {start} UNION ALL
  SELECT r, w.tree, w.level + 1, w.i // 3, sha256(before || '64:' || own || after), proof || before || after
  FROM {name} w JOIN {runs} USING (tree, level, i)),
{name}_ends AS (SELECT r, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM {name} GROUP BY r)"""


MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_SQL.strip()},
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf("text")} AS leaf,
  CASE WHEN {sql_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} END AS forged FROM documents, crc_table),
g AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM l),
{_sql_climb("low", "g")},
s AS (SELECT tree AS source_key, 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, digest FROM low WHERE n = 1),
{_sql_climb("high", "s")},
{_sql_walk("first", "(SELECT r, tree, 0 AS level, i, coalesce(forged, leaf) AS own, '' AS proof FROM g)", "low_runs")},
{_sql_walk("last", "(SELECT r, 'top' AS tree, 0 AS level, s.i, f.own, f.proof FROM first_ends f JOIN g USING (r) JOIN s ON s.source_key = g.tree)", "high_runs")}
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM g JOIN s ON s.source_key = g.tree JOIN last_ends USING (r), (SELECT digest AS root FROM high WHERE n = 1)
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.prove(documents(spark, sf_dir))
