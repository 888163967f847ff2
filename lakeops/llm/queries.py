"""One query per operator over its whole table, and the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.llm import (
    alignment, bpe, conversations, jaccard_join, license_scan, packing, quality_model, quality_rules, secret_scan, simhash, sketches, token_files, url_filters,
)
from lakeops.llm.registry import query, table
from lakeops.llm.vocabularies import BYTE_BPE, PIECE_BPE, WORD_BPE, path
from lakeops.session import scratch_dir

_WORDS = r"[^\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos WHERE i + 7 <= len(ws)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) AS x WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) AS ks GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_twice_words
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, {' + '.join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, (_, c) in enumerate(quality_rules.RULES))} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & {quality_rules.mask_of(quality_rules.BASE)}) <> 0 AS base_failed,
  (failed & {quality_rules.CURRENT.mask}) = 0 AS kept, failed::BIGINT AS failed FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def op5(spark, sf_dir):
    entries = quality_rules.judge(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"),
        (F.col("kept_base") & F.col(f"kept_{quality_rules.CURRENT.version}")).alias("kept"), "failed",
    )


@query("op1_token_files")
def op1(spark, sf_dir):
    out = scratch_dir(spark, "token_files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), out, path(BYTE_BPE), end_id=0)
    return token_files.read_tokens(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "position")


@query("op2_bpe_round_trip")
def op2(spark, sf_dir):
    return bpe.encode_decode_digest(table(spark, sf_dir, "documents"), path(BYTE_BPE))


@query("op4_packing")
def op4(spark, sf_dir):
    return digest_pieces(packing.pack(table(spark, sf_dir, "documents"), path(WORD_BPE), end_id=2, size=4096))


def digest_pieces(pieces):
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_simhash_near_dedup")
def op9(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")




OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS (
""" + "\nUNION ALL\n".join(
    f"  SELECT doc_id, t, {i} AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS m, "
    f"regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS s FROM d"
    for i, r in enumerate(secret_scan.RULES) for p in [
        r.pattern.replace("'", "''").replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")]
) + r"""
),
each AS (SELECT doc_id, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM hits),
spans AS (
  SELECT doc_id, kind, length(g[i]) AS inner_length, least,
    list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b,
    length(m[i]) AS n
  FROM each),
kept AS (SELECT doc_id, kind, b::BIGINT AS b, (b + n)::BIGINT AS e FROM spans WHERE inner_length >= least),
named AS (SELECT *, """ + "CASE kind " + " ".join(f"WHEN {i} THEN '{r.kind}'" for i, r in enumerate(secret_scan.RULES)) + r""" END || ':' || b || ':' || e AS x FROM kept),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(x, ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY b, kind) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""


@query("op10_secret_scans", OP10_SQL)
def op10(spark, sf_dir):
    ledger = secret_scan.BlobLedger(spark, secret_scan.ledger_path(spark, "reported"))
    found = ledger.report(ledger.update(table(spark, sf_dir, "documents")))
    s = F.col("spans")
    return found.select(
        F.col("path").alias("doc_id"), *[secret_scan.counted(s, i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)],
        F.sha2(secret_scan.listed(s, kinds=len(secret_scan.BASE)), 256).alias("base_sha256"),
        secret_scan.listed(s).alias("spans"))


@query("op3_license_scans")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(
            ":", x["family"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"),
        F.array_min(F.transform("licences", lambda x: x["probability"])).alias("least_probability"),
        F.array_min(F.transform("licences", lambda x: x["likeness"])).alias("least_likeness"))


@query("op6_document_fingerprints")
def op6(spark, sf_dir):
    return sketches.compare_with_next(table(spark, sf_dir, "documents"))


_RULE_SQL = "CASE " + " ".join(
    f"WHEN ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(url_filters.RULES, key=lambda r: -len(r.name))) + " END"
_RULE_VERDICT_SQL = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in url_filters.RULES)
_GLOB_SQL = "CASE " + " ".join(
    f"WHEN ('.' || host) LIKE '.{g.host.replace('*', '%')}' AND path LIKE '{g.path.replace('*', '%')}' THEN '{g.verdict}'"
    for g in url_filters.GLOBS) + " ELSE 'allow' END"

OP7_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
q AS (SELECT *, {_RULE_SQL} AS rule FROM p)
SELECT page_id, host, path, rule, {_RULE_VERDICT_SQL} ELSE {_GLOB_SQL} END AS verdict FROM q
"""


@query("op7_url_filters", OP7_SQL)
def op7(spark, sf_dir):
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.grade(docs, model, at_least=2, tail=model.cut).select("doc_id", "graded.*")


@query("op11_cross_tokenizer_alignment")
def op11(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), path(BYTE_BPE), path(PIECE_BPE))


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))


@query("op13_ngram_jaccard_join")
def op13(spark, sf_dir):
    return jaccard_join.similar(table(spark, sf_dir, "documents"))
