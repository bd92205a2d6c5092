"""Queries of the training-data operators, as the driver calls them: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import byte_bpe, dartminhash, deleted_interpolation, gear_chunks, kmeans_tree, lsh_ensemble, lyndon_dedup, secret_automata, url_templates, zstd_quality
from docquarry.llm.common import fold, table
from docquarry.llm.url_templates import LOWER, UPPER, WILD, Tree

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = zstd_quality.train(docs, table(spark, sf_dir, "labels"))
    return zstd_quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents"))


def op3_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), url_templates.rules_of(RULES))


def op6_lsh_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_ensemble.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gear_chunks.digest(gear_chunks.repeats(table(spark, sf_dir, "documents"), text=False))


def op9_lyndon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_dedup.deduplicate(table(spark, sf_dir, "documents"), spans=False)


def op10_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_automata.digest(secret_automata.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_zstd_quality, op2_deleted_interpolation, op3_dartminhash, op4_kmeans_tree, op5_url_templates, op6_lsh_ensemble, op7_byte_bpe, op8_gear_chunks, op9_lyndon_dedup, op10_secret_automata)}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x80-\x{10FFFF}]+')"
_RUNS = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"



def _url_sql(rules: list[tuple[str, str]], how: Tree = Tree()) -> str:
    """op5: rules, shapes, literals, merging from the deepest level up (a recursive step a level) and purity."""
    real = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    said = lambda text: text.replace("'", "''")
    fits = [(f"(host = '{said(n.lower())}' OR ends_with(host, '.{said(n.lower())}')) AND starts_with(path, '/{said(prefix)}')", text, verdict)
            for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True) for n, _, prefix in [text.partition("/")]]
    choose = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{said(f[i])}'" for f in fits) + " END"
    rate = lambda b, n: f"CAST({b} AS DOUBLE) / greatest({n}, 1)"
    bound, m = math.sqrt(math.log(2 / how.alpha) / 2), real(how.smoothing)
    return f"""
        WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM pages),
        rest AS (SELECT r, page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS t FROM raw),
        cut AS (SELECT r, page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        urls AS MATERIALIZED (SELECT *, {choose(1)} AS rule, {choose(2)} AS said,
            list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN length(s) > 40 OR regexp_matches(s, '(-[^-]*){{3}}') THEN '{{slug}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS shapes FROM cut),
        seen AS MATERIALIZED (SELECT host, shapes, count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(said) AS labelled FROM urls GROUP BY ALL),
        forms AS (SELECT shapes, sum(n) AS n FROM seen GROUP BY ALL),
        flat AS MATERIALIZED (SELECT shapes, n, unnest(shapes) AS shape, unnest(range(len(shapes))) AS level FROM forms),
        literal AS MATERIALIZED (SELECT level, shape FROM flat GROUP BY ALL HAVING sum(n) >= {how.support}),
        general AS (SELECT shapes, list(CASE WHEN literal.shape IS NULL THEN '{WILD}' ELSE flat.shape END ORDER BY flat.level) AS template FROM flat LEFT JOIN literal USING (level, shape) GROUP BY ALL),
        tree AS MATERIALIZED (SELECT host, shapes, template, blocked, labelled FROM seen JOIN general USING (shapes)),
        walk AS (
            SELECT host, template, CAST(sum(blocked) AS BIGINT) AS blocked, CAST(sum(labelled) AS BIGINT) AS labelled, template AS merged, coalesce((SELECT max(level) FROM literal), -1) AS k FROM tree GROUP BY host, template
            UNION ALL
            SELECT host, template, blocked, labelled,
                CASE WHEN own_n > 0 AND abs({rate('own_b', 'own_n')} - {rate('all_b', 'all_n')}) <= {real(bound)} * (1 / sqrt(greatest(own_n, 1)) + 1 / sqrt(greatest(all_n, 1))) THEN parent ELSE merged END, k - 1
            FROM (SELECT *, sum(blocked) OVER own AS own_b, sum(labelled) OVER own AS own_n, sum(blocked) OVER every AS all_b, sum(labelled) OVER every AS all_n
                FROM (SELECT *, list_transform(merged, lambda s, i: CASE WHEN i = k + 1 THEN '{WILD}' ELSE s END) AS parent FROM walk WHERE k >= 0)
                WINDOW own AS (PARTITION BY host, merged), every AS (PARTITION BY host, parent))),
        branch AS MATERIALIZED (SELECT * FROM walk WHERE k = -1),
        final AS (SELECT host, merged, sum(blocked) AS blocked, sum(labelled) AS labelled FROM branch GROUP BY ALL),
        everywhere AS (SELECT template, (sum(blocked) + {real(how.smoothing * how.base)}) / (sum(labelled) + {m}) AS shared FROM branch GROUP BY ALL),
        judged AS (SELECT b.host, b.template, array_to_string(b.merged, '/') AS branch, (f.blocked + {m} * shared) / (f.labelled + {m}) AS purity
            FROM branch b JOIN final f ON f.host = b.host AND f.merged = b.merged JOIN everywhere e ON e.template = b.template)
        SELECT page_id, u.host, path, rule, coalesce(said, CASE WHEN purity >= {real(how.reject)} THEN 'block' ELSE 'allow' END) AS verdict, branch AS template, purity
        FROM urls u JOIN tree t ON t.host = u.host AND t.shapes = u.shapes JOIN judged j ON j.host = t.host AND j.template = t.template"""


def _suffix_sql(plan: lyndon_dedup.Plan = lyndon_dedup.Plan()) -> str:
    """op9: every window of a text's bytes (two hexadecimal digits each), those that occur twice, and the stretches that they cover."""
    space = "('20', '09', '0A', '0B', '0C', '0D')"
    stretches = lambda n: f"""(SELECT r, min(pos) AS a, max(pos) + {n} AS b FROM (
            SELECT r, pos, sum(CASE WHEN pos <= before + {n} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM (
                SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM (
                    SELECT r, pos, count(*) OVER (PARTITION BY w) AS times FROM (
                        SELECT r, pos, md5_number(substr(h, 2 * pos + 1, {2 * n})) AS w FROM (SELECT r, h, unnest(range(n - {n} + 1)) AS pos FROM docs WHERE n >= {n}))) WHERE times > 1)) GROUP BY r, run)"""  # noqa: E731
    return f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, h, length(h) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
        gone AS MATERIALIZED {stretches(plan.length)},
        pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM gone),
        kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h FROM pieces JOIN docs USING (r) GROUP BY r),
        again AS MATERIALIZED {stretches(plan.passage)},
        passages AS (SELECT r, sum(b - a) AS n FROM again JOIN docs USING (r)
            WHERE len(list_filter(range(a, b), lambda i: substr(h, 2 * i + 1, 2) NOT IN {space} AND (i = a OR substr(h, 2 * i - 1, 2) IN {space}))) > {plan.words} GROUP BY r)
        SELECT doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256, coalesce(p.n, 0)::BIGINT AS n_passage
        FROM docs d LEFT JOIN kept k USING (r) LEFT JOIN passages p USING (r)"""


#: Exact results of the operators that SQL can express; the operators find candidates by signatures and verify them.
ORACLES: dict[str, str] = {
    "op9_lyndon_dedup": _suffix_sql(),
    "op5_url_templates": _url_sql(url_templates.rules_of(RULES)),
    "op3_dartminhash": f"""
        WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        sets AS MATERIALIZED (SELECT r, doc_id, {_RUNS} AS s FROM (SELECT *, least(5, len(w)) AS k FROM docs WHERE len(w) > 0)),
        one AS MATERIALIZED (SELECT r, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM one a JOIN one b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE n >= 0.8 * (len(p.s) + len(q.s) - n) - 1e-9),
        twoway AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, twoway.b FROM reach JOIN twoway ON twoway.a = reach.b),
        named AS (SELECT reach.a AS r, min(d.doc_id) AS class_id FROM reach JOIN docs d ON d.r = reach.b GROUP BY 1)
        SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE class_id END AS class_id FROM docs LEFT JOIN named USING (r)""",
    "op6_lsh_ensemble": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        items AS MATERIALIZED (SELECT item_id, k, {_RUNS} AS s FROM (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) WHERE k > 0),
        one AS MATERIALIZED (SELECT item_id, k, len(s) AS size, unnest(s) AS x FROM items),
        own AS MATERIALIZED (SELECT r, doc_id, k, unnest({_RUNS}) AS x FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
        SELECT doc_id, item_id, count(*) / size AS containment, count(*)::INTEGER AS shared, size::INTEGER AS size
        FROM own JOIN one USING (k, x) GROUP BY r, doc_id, item_id, size HAVING count(*) >= 0.8 * size - 1e-9""",
}
