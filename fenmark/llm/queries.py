"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm import align, decontam, fim, langid, licenses, linededup, mixing, quality, secrets, simhash, substring, toxicity, warc
from fenmark.llm.runtime import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("found")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents")).drop("findings")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return align.aligned(table(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (_UPPER, _LOWER)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Licenses by brute force: each template's shingles in every window that starts at a stride.
_TEMPLATES = ", ".join(f"({k}, {_quoted(i)}, {_quoted(c)}, {_quoted(t)})" for k, (i, c, t) in enumerate(licenses.KNOWN))
_WORDS = "[x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> '']"

#: The 160 bits of a SHA-1 in 32 groups of five, as base 32.
_SHA1_BITS = "array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(sha1(coalesce(html, '')), i, 1)) - 1) + 1, 4) FOR i IN range(1, 41)], '')"
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum([CAST(substr(bits, 5 * g + b, 1) AS INTEGER) * (1 << (5 - b)) FOR b IN range(1, 6)]) AS INTEGER) + 1, 1) FOR g IN range(0, 32)], '')"

SQL: dict[str, str] = {
    "op1_license_scan": f"""
        WITH t AS (SELECT k, license, category, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) AS v(k, license, category, text)),
        ts AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS shingle FROM t, unnest(range(1, len(w) - 3)) AS u(i)),
        tn AS (SELECT k, license, category, len(w) - 4 AS n, greatest(1, (len(w) - 4) // 4) AS stride, (SELECT count(*) FROM ts WHERE ts.k = t.k) AS all_n FROM t),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
        hits AS (SELECT doc_id, k, pos, shingle FROM ds JOIN ts USING (shingle)),
        wins AS (SELECT doc_id, k, win, count(DISTINCT shingle) / max(all_n) AS containment
                 FROM hits JOIN tn USING (k), unnest(range(greatest(0, (pos - n) // stride - 1), pos // stride + 2)) AS u(win)
                 WHERE pos >= win * stride - stride AND pos < win * stride + n + stride GROUP BY doc_id, k, win),
        best AS (SELECT doc_id, k, max(containment) AS containment FROM wins WHERE containment >= 0.8 GROUP BY doc_id, k),
        named AS (SELECT doc_id, count(*) AS n_templates, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                         string_agg(DISTINCT category, ',' ORDER BY category) AS categories, max(containment) AS best_containment
                  FROM best JOIN tn USING (k) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_templates, 0) AS n_templates, coalesce(licenses, '') AS licenses,
               coalesce(categories, '') AS categories, CAST(coalesce(best_containment, 0) AS DOUBLE) AS best_containment
        FROM documents LEFT JOIN named USING (doc_id)""",
    "op3_line_dedup": f"""
        WITH l AS (SELECT doc_id, i, lines[i] AS line,
                          translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
        o AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
        FROM l LEFT JOIN o USING (key) GROUP BY doc_id""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_BASE32} AS payload_digest
                   FROM (SELECT *, {_SHA1_BITS} AS bits FROM pages)),
        l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM l""",
    "op8_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
        items AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
                  FROM b, unnest(range(1, greatest(0, len(w) - least(13, len(w)) + 1) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT size FROM items),
        wins AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
                 FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
        found AS (SELECT doc_id, i, size, item FROM wins JOIN items USING (size, win)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        wins AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
        later AS (SELECT doc_id, i FROM wins QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS t(p)),
        left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN left_ USING (doc_id) LEFT JOIN lost USING (doc_id)""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, [CAST('0x' || substr(x, 8 * g + 1, 8) AS BIGINT) FOR g IN range(0, 4)] AS h FROM d),
        f AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
