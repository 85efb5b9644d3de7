"""The registered queries of this subpackage and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, loss_text, read_turns
from .common import LOWER, UPPER, held_out, table
from .exact_dedup import exact_duplicates
from .html_text import extract_main_text
from .langid import identify_language
from .lattice import near_vectors
from .media import read_media, store_media
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .pii import KINDS, find_personal_data
from .repair import damage, repair_conversations, with_digest
from .toxicity import score_toxicity
from .variants import spelling_variants

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER p, 0))::DOUBLE AS level FROM f
      WINDOW p AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * w > cap AS stops FROM l),
t AS (SELECT source, source_size,
        CASE WHEN stops THEN cap::DOUBLE ELSE (sum(source_size) OVER () - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ())::DOUBLE
             / sum(CASE WHEN stops THEN 0 ELSE w END) OVER ()::DOUBLE * w END AS target FROM c),
q AS (SELECT d.doc_id, d.source, d.h, d.size, t.source_size, t.target,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (turn * source_size + upto)::DOUBLE / target AS finish FROM q, range(3) r(turn) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, h, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS total FROM k),
n AS (SELECT doc_id, count(*) AS copies FROM o WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n USING (doc_id)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_chats(rows).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Adjacent turns of one role would share a header, so the length counts headers where the role changes.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
        length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|/?SYS>>|bos>|eos>|pad>|unk>|start_of_turn>|end_of_turn>|begin_of_text|end_of_text)')) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 8 + length(role) + 1 END
             + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4, percent=80)


#: All pairs that share a shingle, and what is reachable over those that are linked.
OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a WHERE r.c < e.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON doc_id = node
"""


def _learnable(docs: DataFrame) -> DataFrame:
    """What models may learn from: id and text of the documents that are not held out."""
    return docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    scored = score_toxicity(docs, labelled, _learnable(docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(table(spark, sf_dir, "documents")))
    feature = F.concat(F.lit("peaks:"), F.size("fingerprint"), F.lit(":"), F.lower(F.hex(F.xxhash64("fingerprint"))))
    return read.withColumn("feature", feature)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["rule"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    found = identify_language(docs, labelled, _learnable(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(*repair_conversations(damage(table(spark, sf_dir, "conversations"))))


#: The damage by checksums bit by bit; edits row after row, the cheapest and least for each last initial (0 none, 1 s, 2 u, 3 a).
OP11_SQL = r"""
WITH RECURSIVE src AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits AS (SELECT *, flatten(list_transform(string_split(key, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1)))::BIGINT[] AS b FROM src),
code AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
                       lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) % 20 AS kind FROM bits),
damaged AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM code, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM ordered),
faulty AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN t[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair FROM numbered),
ins(s, s2, edits, lines) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', chr(10) || 'user:'), (1, 2, 'I', chr(10) || 'user:'), (3, 2, 'I', chr(10) || 'user:'), (2, 3, 'I', chr(10) || 'assistant:'),
  (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
op(s, s2, edit, initial, role, cost) AS (VALUES (0, 0, 'D', NULL, NULL, 2), (1, 1, 'D', NULL, NULL, 2), (2, 2, 'D', NULL, NULL, 2), (3, 3, 'D', NULL, NULL, 2),
  (0, 1, 'K', 's', NULL, 0), (0, 2, 'K', 'u', NULL, 0), (1, 2, 'K', 'u', NULL, 0), (3, 2, 'K', 'u', NULL, 0), (2, 3, 'K', 'a', NULL, 0),
  (0, 2, 'R', NULL, 'user', 1), (1, 2, 'R', NULL, 'user', 1), (3, 2, 'R', NULL, 'user', 1), (2, 3, 'R', NULL, 'assistant', 1)),
d(c, i, s, cost, audit, lines) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, 0::BIGINT, '', '' FROM src
  UNION ALL
  SELECT c, i, s2, min(cost), arg_min(audit, (cost, audit)), arg_min(lines, (cost, audit)) FROM (
    SELECT d.c, f.i, op.s2, d.cost + 5 * length(ins.edits) + op.cost + CASE WHEN op.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           d.audit || ins.edits || op.edit AS audit,
           d.lines || ins.lines || CASE op.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || op.role || ':' || f.text END AS lines
    FROM d JOIN ins ON d.s = ins.s JOIN faulty f ON f.c = d.c AND f.i = d.i + 1 JOIN op ON op.s = ins.s2
      AND (op.edit = 'D' OR f.fault IN ('', 'truncated')) AND (op.edit <> 'K' OR left(f.role, 1) = op.initial)) GROUP BY ALL),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c),
ends AS (SELECT d.c, d.cost + 5 * length(ins.edits) AS cost, d.audit || ins.edits AS audit, d.lines || ins.lines AS lines
         FROM d JOIN ins ON d.s = ins.s LEFT JOIN n ON n.c = d.c WHERE ins.s2 IN (0, 3) AND d.i = coalesce(n.n, 0)),
best AS (SELECT c, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(lines, (cost, audit)) AS lines FROM ends GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(substr(lines, 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM src) JOIN best USING (c) LEFT JOIN n USING (c)
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


#: All pairs by cosine, and what is reachable over links.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE ok),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.node = l.a WHERE r.c < l.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2, slip=97)


#: Slips by checksums bit by bit; near words agree in a word without one letter, at one place or as a whole.
OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM t WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)] END)),
        lambda byte: list_transform(range(8), lambda k: (byte >> k) & 1)))::BIGINT[] AS bits FROM g),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) AS h FROM b),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM s GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, c.word AS b FROM d a JOIN d c ON a.i = c.i AND a.rest = c.rest AND a.word <> c.word AND length(a.word) = length(c.word)
      UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
near AS (SELECT a AS word, count(*) AS n_near, min((-w.n, b)) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN near USING (word)),
r(word, far, done) AS (SELECT word, word, form IS NULL FROM f UNION ALL SELECT r.word, f.form, g.form IS NULL FROM r JOIN f ON f.word = r.far JOIN f g ON g.word = f.form WHERE NOT r.done)
SELECT f.word, n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, far AS root FROM f JOIN r ON r.word = f.word AND r.done
"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_chat_format": op6_chat_format,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_near_dedup": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}
