"""The queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

from kgspark.plans.lineage import spread

from . import class_lm, decontaminate, html_text, licenses, mixing, near_dedup, quality, sharding, simhash_dedup, token_alignment, token_output, url_filter, vector_codes
from .common import ALNUM_WORD, SPACED_WORD, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(spread(table(spark, sf_dir, "documents", "doc_id", "text")), words=4, percent=80)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(spread(table(spark, sf_dir, "documents", "doc_id", "text", "source")))


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenized(spread(table(spark, sf_dir, "documents", "doc_id", "text")), end_id=2)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), model)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spread(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(spread(table(spark, sf_dir, "documents", "doc_id", "text")), words=3, radius=2)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


_ALL = (op1_near_dedup, op2_license_scan, op3_main_text, op4_quality_rules, op5_mix_sources, op6_shard_tree, op7_token_output, op8_decontaminate, op9_class_lm, op10_url_filter)
QUERIES = {f.__name__: f for f in (*_ALL, op11_vector_codes, op12_simhash_dedup, op13_token_alignment)}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{ALNUM_WORD}')"
_SPACED = f"regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}')"


def _draw(digest: str, digits: int = 13, start: int = 1) -> str:
    return f"CAST('0x' || substr({digest}, {start}, {digits}) AS BIGINT)"


def _least(path: str, children: str, weight: str) -> str:
    """The child i of ``children`` whose draw, divided by its weight, is the smallest."""
    drawn = f"-ln(({_draw(f"md5({path} || '/' || i)")} + 0.5) / pow(2, 52)) / ({weight})"
    return f"list_sort(list_transform({children}, lambda i: {{'d': {drawn}, 'i': i}}))[1].i"


def _count(characters: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{characters}]', '', 'g'))"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    part = "list_sum(list_transform(list_zip({0}, {1}), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END))"
    return f"round(sqrt(greatest(({part.format(p, q)} + {part.format(q, p)}) / 2, 0)), 6)"


_CLASS_COUNTS = ", ".join(
    [_count(c) for c in ("a-z", "A-Z", "0-9", r"\x09-\x0D ", r""".,;:!?''"\-()""", "#*$%&|<>")]
    + [_count(r"\x00-\x08\x0E-\x1F\x7F+/=@\[\\\]^_`{}~"), _count(r"\x{80}-\x{27F}"), _count(r"\x{280}-\x{10FFFF}")]
)


def _codes_sql(rounds: int = 6) -> str:
    """SQL of op11: long tables of parts and entries, one pair of assignment and update a round."""
    steps = ["b0 AS (SELECT p, e, j, x AS c FROM cells JOIN first USING (r))"]
    distance = "SELECT r, p, e, sum((x - c) * (x - c)) AS d FROM cells JOIN {0} USING (p, j) GROUP BY r, p, e"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, p, min_by(e, (d, e)) AS e, min(d) AS d FROM ({distance.format(f'b{k}')}) GROUP BY r, p)")
        if k < rounds:
            means = f"SELECT p, e, j, sum(x) AS s, count(*) AS n FROM cells JOIN a{k} USING (r, p) GROUP BY p, e, j"
            steps.append(f"b{k + 1} AS (SELECT b.p, b.e, b.j, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c FROM b{k} b LEFT JOIN ({means}) USING (p, e, j))")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sized AS (SELECT CAST(ceil(max(len(embedding)) / 8) AS BIGINT) AS w FROM kept),
cells AS (SELECT r, i // w AS p, i % w AS j, CAST(floor(4096 * CAST(coalesce(embedding[i + 1], 0) AS DOUBLE)) AS BIGINT) AS x FROM kept, sized, unnest(range(8 * w)) AS t(i)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT min_by(r, embedding) AS r, vec_id FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT 16)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (r)
"""


_COMMON = ", ".join(f"({lang!r}, [{', '.join(map(repr, words))}])" for lang, words in quality.COMMON_WORDS.items())
_LIMITS = quality.Limits()

#: What has no SQL here: sketches, indexes, trees and models that are fitted, tokenizer ids, HTML.
ORACLES: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op4_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_SPACED} AS w, [{_CLASS_COUNTS}] AS classes FROM documents),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM docs, unnest(range(1, len(w) - 1)) AS t(i)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM again, unnest([0, 1, 2]) AS t(j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{SPACED_WORD}') GROUP BY r),
counted AS (SELECT r, doc_id, lang, w, classes, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, classes[6] AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    len(w) < {_LIMITS.min_words} OR 100 * coalesce(repeats.n, 0) > {_LIMITS.max_repeat_percent} * len(w) AS base_failed FROM docs LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)),
common(lang, words) AS (VALUES {_COMMON}),
tokens AS (SELECT r, lang, translate(unnest(w), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM counted),
placed AS (SELECT r, len(words) AS size, coalesce(list_position(words, t), list_position(words, trim(t, '.,;:!?''"-()')), len(words) + 1) AS place FROM tokens JOIN common USING (lang)),
told AS (SELECT r, any_value(size) AS size, histogram(place) AS h FROM placed GROUP BY r),
shares AS (SELECT c.*, list_transform(classes, lambda x: x / nullif(list_sum(classes), 0)) AS p,
    CASE WHEN h IS NOT NULL THEN list_transform(range(1, size + 2), lambda i: coalesce(h[i], 0) / n_words) END AS q FROM counted c LEFT JOIN told USING (r)),
good AS (SELECT * FROM shares WHERE NOT base_failed AND n_words >= {_LIMITS.guard_words}),
class_refs AS (SELECT lang, list(m ORDER BY i) AS ref_p FROM (SELECT lang, i, avg(p[i]) AS m FROM good, unnest(range(1, 10)) AS t(i) GROUP BY lang, i) GROUP BY lang),
word_refs AS (SELECT lang, list(m ORDER BY i) AS ref_q FROM (SELECT lang, i, avg(q[i]) AS m FROM good, unnest(range(1, len(q) + 1)) AS t(i) GROUP BY lang, i) GROUP BY lang),
held AS (SELECT s.*, CASE WHEN n_words + list_sum(classes) > 0 THEN {_distance("p", "ref_p")} END AS class_distance, {_distance("q", "ref_q")} AS word_distance
    FROM shares s LEFT JOIN class_refs c ON s.lang IS NOT DISTINCT FROM c.lang LEFT JOIN word_refs v ON s.lang = v.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
    NOT base_failed AND (n_words < {_LIMITS.guard_words} OR (coalesce(class_distance, 0) <= {_LIMITS.max_class_distance} AND coalesce(word_distance, 0) <= {_LIMITS.max_word_distance})) AS kept FROM held
""",
    "op5_mix_sources": f"""
WITH docs AS (SELECT doc_id, source, len({_SPACED}) AS size, -ln(({_draw("md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix|' || coalesce(text, ''))")} + 0.5) / pow(2, 52))
    / greatest(length(translate(coalesce(text, ''), '#*$%&|<>', '')) / greatest(length(coalesce(text, '')), 1), 0.05) AS key FROM documents),
sources AS (SELECT source, sum(size) AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM docs GROUP BY source),
levels AS (SELECT s.source, 3 * s.source_size / s.w AS ratio, ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * o.source_size) FILTER (3 * o.source_size / o.w < 3 * s.source_size / s.w), 0))
    / sum(o.w) FILTER (3 * o.source_size / o.w >= 3 * s.source_size / s.w) AS level FROM sources s, sources o GROUP BY s.source, s.source_size, s.w),
targets AS (SELECT source, source_size, CAST(least(3 * source_size, w * (SELECT min_by(level, ratio) FROM levels WHERE ratio >= level)) AS DOUBLE) AS target FROM sources),
budgets AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM targets),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before FROM docs)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(CASE WHEN size > 0 THEN budget // source_size * size + greatest(least(budget % source_size - before, size), 0) ELSE 0 END AS BIGINT) AS taken
FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
""",
    "op6_shard_tree": f"""
WITH docs AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
sums AS (SELECT *, xor(4294967295, list_reduce(flatten(list_transform(bytes, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) AS text_crc32 FROM docs),
regions AS (SELECT *, {_least("k", "range(2)", "8")} AS r2, {_least("k", "range(3)", "CASE WHEN i < 2 THEN 8 ELSE 1 END")} AS r3 FROM sums),
racks AS (SELECT *, {_least("k || '/' || r2", "range(2)", "4")} AS rack FROM regions),
shards AS (SELECT *, {_least("k || '/' || r2 || '/' || rack", "range(8 * r2 + 4 * rack, 8 * r2 + 4 * rack + 4)", "1")} AS shard FROM racks),
placed AS (SELECT *, CASE WHEN r3 = 2 THEN 16 ELSE shard END AS grown_shard,
    {_draw("md5(concat_ws('|', doc_id, text_crc32, size))", 8)} % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / 16384) AS BIGINT)) AS g FROM shards)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM placed
""",
    "op8_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS gram FROM items, unnest(range(1, len(w) - n + 2)) AS t(k) WHERE n > 0),
windows AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM docs, (SELECT DISTINCT n FROM grams) AS s, unnest(range(1, len(w) - n + 2)) AS t(k)),
found AS (SELECT DISTINCT r, n, k, item_id FROM windows JOIN grams USING (n, gram)),
hit AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM found, unnest(range(0, n)) AS t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
}
