"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import infill, mixing, packing, partenum, pii, quality, rules, secrets, simhash, topk, toxicity, urls, whitening
from tessera.llm.common import read


def default_tokenizer() -> str:
    """Where the public vocabulary lies; packing itself takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), default_tokenizer())


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    made = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"), fields)
    return made.select("doc.doc_id", *fields)


def op12_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.linked_sets(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(read(spark, sf_dir, "embeddings"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule, from one stored ledger: rows that fail the rule, that only it rejects, and what is kept."""
    led = rules.stored(read(spark, sf_dir, "documents"))
    parts = [rules.ablation(led, p).select(F.lit(p).alias("policy"), "*") for p in rules.POLICIES]
    return parts[0].unionByName(parts[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_secrets, op3_simhash, op4_quality_rules, op5_toxicity,
        op6_topk, op7_quality, op8_url_filter, op9_mixing, op10_pii, op11_infill,
        op12_partenum, op13_whitening, rules_ablation,
    )
}

_WS = r"[\x20\x09-\x0D]+"

LEDGER_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS lines FROM t),
g AS (SELECT r, p, list_slice(words, p, p + 7) AS gram
      FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS p FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, sum(least(8, coalesce(after - p, 8)))::BIGINT AS n
            FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS after FROM twice) GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: NOT regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z][^A-Z]*[A-Z]')))::BIGINT AS n_caps,
             (length(text) - length(regexp_replace(text, '[0-9.,;:''"()-]', '', 'g')))::BIGINT AS n_marks
      FROM w LEFT JOIN covered c ON w.r = c.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_caps > 30 * n_words THEN 8 ELSE 0 END
              + CASE WHEN 10 * n_dup_lines > n_words THEN 16 ELSE 0 END
              + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_marks > 70 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
"""
OP4_SQL = LEDGER_SQL + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits & 111 = 0 AS kept, fail_bits FROM b
"""

ABLATION_SQL = LEDGER_SQL + """, p AS (SELECT * FROM (VALUES ('v1', 127), ('v2', 111)) p(policy, mask)),
u AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('many_symbols', 4), ('capitals', 8), ('duplicate_lines', 16),
      ('long_words', 32), ('mostly_marks', 64)) u(rule, bit)),
x AS (SELECT policy, rule, bit, fail_bits & mask AS bits FROM b, p, u WHERE mask & bit <> 0)
SELECT policy, rule, count(*) FILTER (bits & bit <> 0) AS failed, count(*) FILTER (bits = bit) AS failed_alone,
       count(*) FILTER (bits = 0) AS kept, count(*) FILTER (bits IN (0, bit)) AS kept_without FROM x GROUP BY policy, rule
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
h AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r AS (SELECT *, '.' || host AS dotted FROM h),
v AS (SELECT page_id, host, path,
        CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[^A-Za-z0-9])(casino|poker|roulette|jackpot|viagra|cialis|porn|xxx|escort|warez|keygen|'
              || '(free|cheap|best|buy|online|discount|live|instant|no|easy|fast|win|top|order)[^A-Za-z0-9]+(bets|betting|slots|pills|pharmacy|meds|loans|'
              || 'payday|credit|dating|cams|essays|replica|watches|followers|crack|serial|lottery))($|[^A-Za-z0-9])')
            THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1))::BIGINT AS w,
             (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
             (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_w
      FROM o),
c AS (SELECT *, 3 * total - 2 * filled AS rest2, 4 * source_size * left_w < w * (3 * total - 2 * filled) AS capped FROM f),
free AS (SELECT left_w AS free_w, rest2 AS free_rest2 FROM c WHERE NOT capped ORDER BY left_w DESC LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE
             ELSE (w * (SELECT free_rest2 FROM free))::DOUBLE / (2 * (SELECT free_w FROM free))::DOUBLE END AS target FROM c),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS copies FROM g),
b AS (SELECT *, floor(target)::BIGINT - copies * source_size AS rest FROM k),
v AS (SELECT source, h, sum(size)::BIGINT AS there, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM d GROUP BY source, h),
t AS (SELECT d.*, b.source_size, b.target, b.copies, b.rest, v.there, v.upto - v.there AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN v ON d.source IS NOT DISTINCT FROM v.source AND d.h = v.h)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN before + there <= rest THEN size WHEN before >= rest OR there = 0 THEN 0
                             ELSE floor(size * (rest - before) / there)::BIGINT END)::BIGINT AS taken
FROM t
"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
             ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS pre, array_to_string(list_slice(units, a + 1, b), '') AS mid,
             array_to_string(list_slice(units, b + 1, n), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                          ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""

ORACLES = {"op11_infill": OP11_SQL, "op4_quality_rules": OP4_SQL, "rules_ablation": ABLATION_SQL, "op8_url_filter": OP8_SQL, "op9_mixing": OP9_SQL}
