"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import ann, dialogue, lexical, mixing, neardup, pieces, pii, quality, sharding, tokens, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A vocabulary file's path; the same on the driver and on all workers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.Index(rows).search(rows.where("vec_id % 50 = 0"), k=5)


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"), seed=1)


def op3_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = urlfilter.labelled(pages, _table(spark, sf_dir, "labels"))
    return urlfilter.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, report=True)


def op9_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.planned(_table(spark, sf_dir, "pages")))
    return warc.records(warc.read(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "failures",
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = toxicity.fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(_table(spark, sf_dir, "conversations")))


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does by itself, from the bitmasks of all documents."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan, op2_merge_dropout, op3_pretoken_counts, op4_water_filling, op5_feistel_shards,
        op6_host_reputation, op7_prob_minhash, op8_surrogates, op9_chunked_warc, op10_rule_ledger,
        op11_ranked_search, op12_subsequence_svm, op13_turn_repair, ledger_ablations,
    )
}

ORACLE_SQL = {
    "op4_water_filling": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
t AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS full_at,
             1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t),
m AS (SELECT arg_min(level, full_at) FILTER (WHERE level <= full_at) AS lam FROM l),
g AS (SELECT l.source, l.source_size, least(cap, coalesce(lam * w, cap)) AS target FROM l, m),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (
  SELECT d.*, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS need,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * start + size <= 2 * need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
    "op6_host_reputation": r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS host, bad FROM (SELECT host, try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1) AS BIGINT) AS doc_id FROM p) JOIN b USING (doc_id)),
q AS (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, regexp_matches(host, '^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$') AS address,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (@SUFFIXES@) AS listed
  FROM o),
h AS (
  SELECT host, CASE WHEN address THEN host WHEN listed THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
         CASE WHEN address THEN 'address' WHEN listed THEN two ELSE list_last(string_split(host, '.')) END AS suffix,
         CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM q GROUP BY 1, 2, 3),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
sx AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY 1),
base AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM sx),
children AS (
  SELECT 0 AS lvl, '' AS parent, n, k FROM sx UNION ALL SELECT 1, suffix, n, k FROM dm UNION ALL SELECT 2, domain, n, k FROM h),
own AS (SELECT lvl, parent, sum(n) AS pn, sum(k) AS pk, sum(n * n) AS nn, sum(k * k / n) AS kk, count(*) AS c FROM children GROUP BY 1, 2),
sums AS (
  SELECT lvl, sum(kk - pk * pk / pn - pk / pn * (1 - pk / pn) * (c - 1)) AS over_, sum(pk / pn * (1 - pk / pn) * (pn - nn / pn - (c - 1))) AS room
  FROM own GROUP BY lvl),
st AS (SELECT lvl, 1 / least(greatest(coalesce(CASE WHEN room > 0 THEN over_ / room END, 0.0), 1.0 / 1001), 0.5) - 1 AS m FROM sums),
m AS (SELECT coalesce(max(m) FILTER (WHERE lvl = 0), 1000.0) AS m0, coalesce(max(m) FILTER (WHERE lvl = 1), 1000.0) AS m1, coalesce(max(m) FILTER (WHERE lvl = 2), 1000.0) AS m2 FROM st),
top AS (SELECT suffix, (k + m0 * p) / (n + m0) AS mean FROM sx, base, m),
mid AS (SELECT domain, (dm.k + m1 * top.mean) / (dm.n + m1) AS mean FROM dm JOIN top USING (suffix), m),
low AS (SELECT host, n, (h.k + m2 * mid.mean) / (h.n + m2) AS mean, m2 FROM h JOIN mid USING (domain), m),
bound AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + m2 + 1)) AS low FROM low)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN bound.low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN bound ON regexp_replace(regexp_replace(regexp_replace(r.host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') = bound.host
""".replace("@SUFFIXES@", ", ".join(f"'{s}'" for s in urlfilter.SUFFIXES)),
    "op9_chunked_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
""",
    "op10_rule_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
n AS (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_marks FROM w),
win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, n_words - 6)) AS i FROM n WHERE n_words >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, CAST(sum(least(8, i - coalesce(prev, -8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM twice) GROUP BY rid),
f AS (
  SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN cov USING (rid)),
v AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND 2 * n_marks > n_words THEN 32 ELSE 0 END AS failures FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM v
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
n AS (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, c.docs),
p AS (
  SELECT doc_id, rid, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c.docs) // c.terms))) AS impact
  FROM tf JOIN w USING (term) JOIN n USING (rid), c),
s AS (SELECT item_id, doc_id, rid, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
""",
    "op13_turn_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS signs FROM conversations),
told AS (
  SELECT *, xor(list_reduce(list_transform(signs, lambda c: CAST(ord(c) AS BIGINT)), lambda a, b:
      list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM told WHERE kind <> 0),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn ASC NULLS FIRST) AS seen FROM hurt),
named AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text, seen) AS BIGINT) AS i, substring(role, 1, 1) AS r,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM met),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM named),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT c.conv_id, count(f.i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs c LEFT JOIN faulty f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY c.conv_id),
-- what may follow a last role ('' at the start): the next one, and what is inserted before it
moves (s, t, ins, added) AS (VALUES ('', 's', '', ''), ('', 'u', '', ''), ('', 'a', 'I', 'user:' || chr(10)), ('s', 'u', '', ''), ('s', 'a', 'I', 'user:' || chr(10)),
  ('u', 'a', '', ''), ('u', 'u', 'I', 'assistant:' || chr(10)), ('a', 'u', '', ''), ('a', 'a', 'I', 'user:' || chr(10))),
ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM convs
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit, best.out FROM (
    SELECT conv_id, i, s, min(struct_pack(cost := cost, audit := audit, out := out)) AS best FROM (
      SELECT f.conv_id, f.i, w.s, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.out FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      UNION ALL
      SELECT f.conv_id, f.i, m.t, w.cost + 3 * length(m.ins) + CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN f.r = m.t THEN 0 ELSE 3 END,
             w.audit || m.ins || CASE WHEN f.r = m.t THEN 'K' ELSE 'R' END,
             w.out || m.added || CASE WHEN f.r = m.t THEN f.role WHEN m.t = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10)
      FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.s = w.s
      WHERE f.fault NOT IN ('blank', 'duplicate') AND (f.r = m.t OR m.t <> 's')) GROUP BY conv_id, i, s)),
done AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + CASE s WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, audit := audit || CASE s WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
         out := out || CASE s WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END)) AS best
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.n GROUP BY w.conv_id)
SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit,
       sha256(left(best.out, greatest(length(best.out) - 1, 0))) AS repaired_sha256
FROM counts c JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id
""",
}

ORACLE_SQL["ledger_ablations"] = (
    "WITH ledger AS (" + ORACLE_SQL["op10_rule_ledger"] + """),
r AS (SELECT unnest(['too_few_words', 'repeated_windows', 'symbol_ratio', 'repeated_lines', 'word_length', 'shouting']) AS rule, unnest([1, 2, 4, 8, 16, 32]) AS b)
SELECT rule, count(*) AS n_docs, count(*) FILTER (WHERE failures & b <> 0) AS n_failed, count(*) FILTER (WHERE failures = b) AS n_only, count(*) FILTER (WHERE failures & (63 - b) = 0) AS n_kept_without
FROM ledger, r GROUP BY rule"""
)
