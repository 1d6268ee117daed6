"""The operators on the given tables, with production parameters, and SQL where it gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    clusters,
    collocations,
    decontaminate,
    lm,
    minhash,
    mixture,
    pages,
    quality,
    repeats,
    secrets,
    simhash,
    templates,
    tokens,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WHITE_WORDS = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""
    WITH lowered AS (
      SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
      UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
    worded AS (
      SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
    wins AS (
      SELECT DISTINCT id AS item_id, least(len(w), 10) AS n,
             list_slice(w, i, i + least(len(w), 10) - 1) AS win
      FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i
            FROM worded WHERE kind = 'b' AND len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    found AS (
      SELECT d.id, d.i, d.n, wins.item_id
      FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
            FROM worded, sizes WHERE kind = 'd' AND len(w) >= n) AS d
      JOIN wins ON wins.n = d.n AND wins.win = list_slice(d.w, d.i, d.i + d.n - 1)),
    hit AS (
      SELECT id, count(DISTINCT p) AS n_hit
      FROM (SELECT id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY id),
    items AS (
      SELECT id, list_sort(list(DISTINCT item_id)) AS items FROM found GROUP BY id)
    SELECT CAST(worded.id AS BIGINT) AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(len(items), 0) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM worded LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
    """
)
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.digest(F.col("items")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query(
    r"""
    WITH worded AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    wins AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM worded WHERE len(w) >= 13)),
    first AS (SELECT win, min(doc_id) AS d FROM wins GROUP BY win),
    gone AS (
      SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p
      FROM wins JOIN first USING (win) WHERE d < doc_id),
    lists AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE
             list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
    FROM worded LEFT JOIN lists USING (doc_id)
    """
)
def op6_repeated_windows(spark, sf_dir):
    found = repeats.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    r"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE
        list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
      FROM worded),
    classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
    parts AS (SELECT rep, n, unnest(s) AS shingle FROM classes),
    pairs AS (
      SELECT a.rep AS a, b.rep AS b, a.n + b.n AS sizes, count(*) AS shared
      FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.rep < b.rep GROUP BY ALL),
    links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (sizes - shared)),
    reach AS (
      SELECT rep AS x, rep AS y FROM classes
      UNION
      SELECT x, CASE WHEN a = y THEN b ELSE a END FROM reach JOIN links ON a = y OR b = y),
    component AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
           coalesce(component_id, doc_id) = doc_id AS kept
    FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN component USING (rep)
    """
)
def op7_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_quality_outliers(spark, sf_dir):
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op3_mixture(spark, sf_dir):
    return mixture.mixture(table(spark, sf_dir, "documents")).drop("copies")


@query(
    r"""
    WITH raw AS (
      SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    lines AS (
      SELECT doc_id, CAST(number AS INTEGER) AS number,
             list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
               lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w
      FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS number FROM raw)),
    around AS (
      SELECT doc_id, number, w,
             lag(w) OVER d AS before, lead(w) OVER d AS after, list_slice(w, 1, 3) AS lead3
      FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY number)),
    deep AS (SELECT * FROM around WHERE len(w) > 3),
    counted AS (
      SELECT len(w) AS n, lead3, w, count(*) AS c, min((doc_id, number)) AS first FROM deep GROUP BY ALL),
    leaves AS (
      SELECT n, lead3, arg_min(w, (-c, first)) AS seed FROM counted GROUP BY ALL
      HAVING count(*) > 1 AND sum(c) >= 5),
    mapped AS (
      SELECT w, CASE WHEN len(list_filter(list_zip(w, seed), lambda p: p[1] = p[2])) / len(w) >= 0.6
                     THEN seed ELSE w END AS template
      FROM counted JOIN leaves USING (n, lead3)),
    placed AS (
      SELECT doc_id, number, coalesce(template, deep.w) AS template, before, after
      FROM deep LEFT JOIN mapped USING (w)),
    one AS (
      SELECT template, doc_id, arg_min((before, after), number) AS around
      FROM placed GROUP BY ALL),
    ringed AS (SELECT template, around, count(*) AS n FROM one GROUP BY ALL),
    found AS (
      SELECT template FROM ringed GROUP BY ALL
      HAVING sum(n) >= 5 AND count(*) >= 5 AND 2 * max(n) <= sum(n)),
    gone AS (SELECT doc_id, list(number) AS gone FROM placed SEMI JOIN found USING (template) GROUP BY doc_id)
    SELECT documents.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines,
           CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN parts ELSE
             list_filter(parts, lambda x, i: NOT list_contains(gone, i - 1)) END, chr(10))) AS kept_sha256
    FROM documents LEFT JOIN raw USING (doc_id) LEFT JOIN gone ON gone.doc_id = documents.doc_id
    """
)
def op9_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    found = templates.drop_lines(docs, dropped="dropped")
    lines = F.coalesce(F.length("whole") - F.length(F.replace(F.col("whole"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return found.select(
        "doc_id",
        lines.cast("bigint").alias("n_lines"),
        F.size("dropped").cast("bigint").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def _secrets_sql() -> str:
    """Spans from the texts between matches and the matches, rule by rule."""
    parts = []
    for n, rule in enumerate(secrets.RULES):
        regex = rule.regex.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {n} AS rule, '{rule.kind}' AS kind, {rule.least} AS least,
                   string_split_regex(text, '{regex}') AS gaps,
                   regexp_extract_all(text, '{regex}') AS found,
                   regexp_extract_all(text, '{regex}', {rule.group}) AS held
                FROM documents WHERE regexp_matches(text, '{regex}')"""
        )
    return f"""
    WITH hits AS ({" UNION ALL ".join(parts)}),
    placed AS (
      SELECT doc_id, rule, kind, least, found[i] AS m, held[i] AS g,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM hits)),
    spans AS (
      SELECT doc_id, rule, start, kind || ':' || start || ':' || (start + length(m)) AS span
      FROM placed WHERE length(g) >= least),
    lists AS (
      SELECT doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access,
             count(*) FILTER (rule = 2) AS n_hex,
             string_agg(span, ',' ORDER BY start, rule) FILTER (rule < 3) AS base,
             string_agg(span, ',' ORDER BY start, rule) AS spans
      FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN lists USING (doc_id)
    """


@query(_secrets_sql())
def op10_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(of(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query(
    r"""
    WITH cut AS (
      SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages),
    blocks AS (
      SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(?:p|h1)>'),
        lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
          regexp_replace(b, '<[^>]*>', ' ', 'g'), '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
          '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS b
      FROM cut)
    SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text,
           CAST(coalesce(length(array_to_string(b, chr(10) || chr(10))), 0) AS BIGINT) AS n_chars
    FROM blocks
    """
)
def op8_main_text(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


@query()
def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query()
def op5_pseudo_likelihood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


@query(
    r"""
    WITH pieces AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)),
    f AS MATERIALIZED (
      SELECT lang, m, array_to_string(g, ' ') AS g, count(*) AS c
      FROM (SELECT lang, m, list_slice(w, i, i + m - 1) AS g
            FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
                  FROM pieces, (VALUES (1), (2), (3)) AS sizes(m) WHERE len(w) >= m))
      GROUP BY ALL),
    totals AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY lang),
    candidates AS MATERIALIZED (
      SELECT lang, m, g, string_split(g, ' ') AS w, c AS a FROM f WHERE m >= 2 AND c >= 10),
    parts AS (
      SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
      FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates)),
    cuts AS (
      SELECT p.lang, p.g, p.a, p.k, l.c AS l, r.c AS r,
             (1000000 * CAST(p.a AS HUGEINT) * p.a) // (CAST(l.c AS HUGEINT) * r.c) AS score
      FROM parts AS p JOIN f AS l ON l.lang = p.lang AND l.g = p.head JOIN f AS r ON r.lang = p.lang AND r.g = p.tail),
    scored AS (
      SELECT lang, g, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score
      FROM cuts GROUP BY ALL),
    inner_phrases AS (
      SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, max(a) AS longer
      FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE m = 3) GROUP BY ALL),
    ranked AS (
      SELECT s.lang, s.g AS phrase, a, l, r, n, score,
             row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank
      FROM scored AS s JOIN totals USING (lang)
      LEFT JOIN inner_phrases AS p ON p.lang = s.lang AND p.g = s.g
      WHERE longer IS NULL OR 100 * longer < 50 * a)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000
    """
)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignment and new centroids, round by round."""
    parts = [
        f"""kept AS (
      SELECT row_number() OVER () AS row, vec_id,
             list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
    c0 AS (
      SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster, v AS c
      FROM kept QUALIFY cluster < {k})"""
    ]
    for turn in range(rounds + 1):
        parts.append(
            f"""a{turn} AS (
      SELECT row, vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
      FROM (SELECT row, vec_id, v, cluster,
              list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
            FROM kept, c{turn})
      GROUP BY row, vec_id, v)"""
        )
        if turn < rounds:
            parts.append(
                f"""s{turn} AS (
      SELECT cluster, j, sum(x) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{turn}) GROUP BY ALL),
    c{turn + 1} AS (
      SELECT c{turn}.cluster, coalesce(m.c, c{turn}.c) AS c
      FROM c{turn} LEFT JOIN (
        SELECT cluster, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY j) AS c
        FROM s{turn} GROUP BY cluster) AS m USING (cluster))"""
            )
    return f"""
    WITH {", ".join(parts)}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
           CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cluster)
    """


@query(_clusters_sql())
def op12_centroid_clusters(spark, sf_dir):
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


@query()
def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
