"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import chat_windows, filter_audit, lattice, licenses, line_dedup, mixing, ngram_join, packing, pii, quality_classifier, robust_outliers, spelling, suffix_index
from tidewire.llm.common import lines, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.robust_outliers(table(spark, sf_dir, "documents")).drop("stratum", "distance")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("row.doc_id", F.size(lines(F.col("row.text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_shingles"), "component_id")


#: Key of the surrogates in the registered query; a user gives a secret of their own.
PII_KEY = "registered query"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("row.doc_id", "n_entities", F.col("new_text").alias("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    more = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text")) for k, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more[0]).unionByName(more[1])
    back = chat_windows.read_back(chat_windows.chat_windows(turns))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_index.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_best_fit_packing, op4_embedding_near_dedup, op5_line_dedup, op6_ngram_jaccard, op7_pii_surrogates, op8_mixing, op9_chat_formatting, op10_quality_classifier, op11_suffix_dedup, op12_spelling_variants, op13_filter_audit)}

#: Blanks that the contracts name, as DuckDB writes them.
_WORD = r"[^\x20\x09-\x0D]+"

OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, f.keeper IS NOT NULL AND f.keeper <> k.doc_id AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
f AS (SELECT e.doc_id, e.g FROM e JOIN (SELECT g FROM e GROUP BY g HAVING count(*) > 1) USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 75 * (x.n + y.n - o)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, sum(s) OVER () AS total FROM s),
r AS (SELECT *, coalesce(sum(3 * s) OVER (ORDER BY s * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
             sum(w) OVER (ORDER BY s * (6 // w), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
c AS (SELECT *, 3 * s * w_left <= (total - given) * w AS stopped FROM r),
t AS (SELECT source, s, stopped,
             ((total - coalesce(sum(CASE WHEN stopped THEN 3 * s END) OVER (), 0)) * w)::HUGEINT AS num,
             coalesce(sum(CASE WHEN NOT stopped THEN w END) OVER (), 1)::HUGEINT AS den FROM c),
p AS (SELECT source, s::BIGINT AS source_size, den, CASE WHEN stopped THEN (3 * s)::DOUBLE ELSE num::DOUBLE / den::DOUBLE END AS target,
             CASE WHEN stopped THEN 3 ELSE num // (den * s) END AS epochs,
             CASE WHEN stopped THEN 0 ELSE num - (num // (den * s)) * den * s END AS rest FROM t),
h AS (SELECT source, place, sum(size) AS n FROM d GROUP BY source, place),
a AS (SELECT source, place, n, sum(n) OVER (PARTITION BY source ORDER BY place) - n AS before FROM h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.epochs + CASE WHEN (2 * a.before + a.n) * p.den <= 2 * p.rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN a ON d.source IS NOT DISTINCT FROM a.source AND d.place = a.place
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM c),
s AS (SELECT *, bool_or(nth = 1 AND role = 'system') OVER (PARTITION BY conv_id) AS has_system,
             nth = 1 AND role = 'system' AS lead,
             coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS lead_n,
             -- a turn's text and role escaped, with its marks
             length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) + length(role)
             + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) + 14 AS chars FROM n),
p AS (SELECT *, CASE WHEN lead THEN -1 ELSE sum(CASE WHEN lead THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY nth) - n END AS pos FROM s),
q AS (SELECT *, greatest(1, 384 - lead_n) AS stride FROM p),
v AS (SELECT *, CASE WHEN pos <= 0 THEN 0 ELSE 2 * (pos // stride) + CASE WHEN pos + n > (pos // stride + 1) * stride THEN 1 ELSE 0 END END AS v FROM q),
w AS (SELECT conv_id, v, min(pos) AS start, least(128, greatest(0, 512 - max(lead_n) - sum(n))) AS room FROM v WHERE v > 0 GROUP BY conv_id, v),
again AS (
  SELECT w.conv_id, sum(v.chars) AS chars FROM w JOIN v ON w.conv_id = v.conv_id
   AND (v.lead OR v.pos >= 0 AND v.pos >= w.start - w.room AND v.pos + v.n <= w.start) GROUP BY w.conv_id),
t AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars FROM v GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       (t.chars + coalesce(again.chars, 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN again ON t.conv_id = again.conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
s AS (SELECT doc_id, q, md5(substr(hx, 2 * q + 1, 200)) AS w FROM (SELECT doc_id, hx, unnest(range(length(hx) // 2 - 99)) AS q FROM d)),
a AS (SELECT doc_id, q FROM (SELECT doc_id, q, row_number() OVER (PARTITION BY w ORDER BY doc_id, q) AS nth FROM s) WHERE nth > 1),
g AS (SELECT *, CASE WHEN q <= lag(q) OVER (PARTITION BY doc_id ORDER BY q) + 100 THEN 0 ELSE 1 END AS new FROM a),
n AS (SELECT doc_id, q, sum(new) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM g),
r AS (SELECT doc_id, min(q) AS start, max(q) + 100 AS stop FROM n GROUP BY doc_id, run),
b AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM r),
k AS (SELECT b.doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last,
             string_agg(substr(hx, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS head FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN hx ELSE head || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP12_SQL = r"""
WITH bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i)),
tab AS (WITH RECURSIVE t AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)
        SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY id, run),
x AS (SELECT *, hex(encode(id || ':' || run)) AS hx FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM x, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)::INT)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.l = b.l AND a.word <> b.word
      UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
      UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * v.n THEN (SELECT min(p.other) FROM p WHERE p.word = v.word AND p.other_n = b.most) END AS form,
             CASE WHEN b.most >= 5 * v.n THEN b.most END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
s AS (WITH RECURSIVE s AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
      SELECT word, max_by(root, k) AS root FROM s GROUP BY word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.root FROM f JOIN s ON s.word = f.word
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

ORACLE_SQL = {"op5_line_dedup": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_mixing": OP8_SQL, "op9_chat_formatting": OP9_SQL, "op11_suffix_dedup": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_filter_audit": OP13_SQL}
