"""The registered queries opN_<name> and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubag.llm.common import table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import secrets as S

    found = S.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    line = lambda col: F.concat_ws(",", F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("findings", lambda x: x["kind"].isin(S.KINDS[:3]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


@query
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pubag.llm import bpe

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def _remainder(of: int):
    """crc32 of the document id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.*, coalesce(s.first_doc <> d.doc_id, false) AS gone FROM keyed d LEFT JOIN shared s ON s.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_remainder(5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.profiles(docs.where(_remainder(4) != 2)))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import mixing

    sizes = mixing.sized(table(spark, sf_dir, "documents"))
    sources = mixing.targets(sizes)
    words = mixing.taken(sizes, sources).groupBy("uid").agg(F.sum("words").alias("taken"))
    per = sources.select(F.col("source").alias("s"), "source_size", "target")
    out = sizes.join(words, "uid", "left").join(per, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


SQL["op5_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER o AS k,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM per WINDOW o AS (ORDER BY 2.0 * source_size / w, encode(source) NULLS LAST)),
level AS (
  SELECT (3 * total - 2 * cut)::DOUBLE / (2 * rest) AS part FROM ranked
  WHERE 2 * source_size >= w * ((3 * total - 2 * cut)::DOUBLE / (2 * rest)) ORDER BY k LIMIT 1),
aimed AS (
  SELECT source, source_size, least(2.0 * source_size, w * (SELECT part FROM level))::DOUBLE AS target FROM per),
placed AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, least(2 * a.source_size, floor(a.target + 0.5))::BIGINT AS quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized d JOIN aimed a ON a.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(ahead + size, quota) - ahead)
        + greatest(0, least(ahead + source_size + size, quota) - ahead - source_size))::BIGINT AS taken
FROM placed
"""


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import topk

    rows = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    whole = rows.select("id", F.transform("vec", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    return topk.top_k(whole, F.col("id") % 50 == 0, 5)


SQL["op7_exact_top_k"] = r"""
WITH rows AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows q JOIN rows c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, qr ORDER BY score DESC, vec_id) AS rk FROM scored)
SELECT query_id, rk::INTEGER AS rank, vec_id, score FROM ranked WHERE rk <= 5
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pubag.llm import tokencount

    vocabulary = tokencount.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


@query
def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import ann, topk

    rows = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(rows, F.col("id") % 20 == 0, 20)


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import codes

    coded = codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Three complete assignments with two updates between them, one row a component (vectors of one length)."""
    near = """a{k} AS (
  SELECT r, p, e, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS rk FROM (
      SELECT x.r, x.p, b.e, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
      FROM part x JOIN b{k} b ON b.p = x.p AND b.j = x.j GROUP BY x.r, x.p, b.e))
  WHERE rk = 1)"""
    mean = """b{n} AS (
  SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT x.p, a.e, x.j, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v
    FROM part x JOIN a{k} a ON a.r = x.r AND a.p = x.p GROUP BY x.p, a.e, x.j) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS (SELECT r, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS i, len(v) // 16 AS w FROM kept),
part AS (SELECT r, v, i // w AS p, i % w AS j FROM comp),
b0 AS (SELECT p, r - 1 AS e, j, v FROM part WHERE r <= 64),
{near.format(k=0)},
{mean.format(n=1, k=0)},
{near.format(k=1)},
{mean.format(n=2, k=1)},
{near.format(k=2)},
coded AS (
  SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT k.vec_id, lower(c.code) AS code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM b2) AS codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r
"""


SQL["op11_vector_codes"] = _op11_sql()


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm.embdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


SQL["op12_embedding_near_dedup"] = r"""
WITH RECURSIVE rows AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: x::DOUBLE) AS v,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable
  FROM embeddings),
links AS (
  SELECT a.r, b.r AS other, b.vec_id AS other_id FROM rows a JOIN rows b ON a.r <> b.r
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(r, other, id) AS (
  SELECT r, r, vec_id FROM rows
  UNION
  SELECT x.r, l.other, l.other_id FROM reached x JOIN links l ON l.r = x.other),
least AS (SELECT r, min(id) AS component_id FROM reached GROUP BY r)
SELECT w.vec_id, (SELECT count(*) FROM links l WHERE l.r = w.r) AS n_links, c.component_id,
       w.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM rows w JOIN least c ON c.r = w.r
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pubag.llm import convrepair as R

    rows = R.damaged(table(spark, sf_dir, "conversations"))
    out = R.report(rows, R.plans(rows))
    return out.select(F.col("conv").alias("conv_id"), *R.COUNTS, "cost", "audit", "repaired_sha256")


SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                         lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fault
  FROM said),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(0, 2) t(i) WHERE fault <> 0 AND (i = 0 OR fault = 3)),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
turns AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f,
         left(role, 1) AS i, row_number() OVER o AS rn,
         coalesce(lag(left(role, 1)) OVER o || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM seen WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
         count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM turns GROUP BY conv_id),
back(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}, {'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']},
         {'c': 2::BIGINT, 'a': 'I', 't': ['assistant:']}, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} FROM stats
  UNION ALL
  SELECT conv_id, k, list_min([g0, {'c': 2 + f2.c, 'a': 'I' || f2.a, 't': list_prepend('user:', f2.t)}]),
         list_min([g1, {'c': 2 + f2.c, 'a': 'I' || f2.a, 't': list_prepend('user:', f2.t)}]), f2,
         list_min([g3, {'c': 2 + g2.c, 'a': 'I' || g2.a, 't': list_prepend('user:', g2.t)}])
  FROM (SELECT *, list_min([g2, {'c': 2 + g3.c, 'a': 'I' || g3.a, 't': list_prepend('assistant:', g3.t)}]) AS f2 FROM (
    SELECT b.conv_id, b.k - 1 AS k,
      list_min([{'c': 3 + s0.c, 'a': 'D' || s0.a, 't': s0.t}, {'c': no + cut + 2 + s2.c, 'a': 'R' || s2.a, 't': list_prepend('user:' || r.text, s2.t)},
                {'c': no + cut + s1.c + CASE WHEN r.i = 's' THEN 0 ELSE 1000000000 END, 'a': 'K' || s1.a, 't': list_prepend(r.role || ':' || r.text, s1.t)},
                {'c': no + cut + s2.c + CASE WHEN r.i = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 't': list_prepend(r.role || ':' || r.text, s2.t)}]) AS g0,
      list_min([{'c': 3 + s1.c, 'a': 'D' || s1.a, 't': s1.t}, {'c': no + cut + 2 + s2.c, 'a': 'R' || s2.a, 't': list_prepend('user:' || r.text, s2.t)},
                {'c': no + cut + s2.c + CASE WHEN r.i = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 't': list_prepend(r.role || ':' || r.text, s2.t)}]) AS g1,
      list_min([{'c': 3 + s2.c, 'a': 'D' || s2.a, 't': s2.t}, {'c': no + cut + 2 + s3.c, 'a': 'R' || s3.a, 't': list_prepend('assistant:' || r.text, s3.t)},
                {'c': no + cut + s3.c + CASE WHEN r.i = 'a' THEN 0 ELSE 1000000000 END, 'a': 'K' || s3.a, 't': list_prepend(r.role || ':' || r.text, s3.t)}]) AS g2,
      list_min([{'c': 3 + s3.c, 'a': 'D' || s3.a, 't': s3.t}, {'c': no + cut + 2 + s2.c, 'a': 'R' || s2.a, 't': list_prepend('user:' || r.text, s2.t)},
                {'c': no + cut + s2.c + CASE WHEN r.i = 'u' THEN 0 ELSE 1000000000 END, 'a': 'K' || s2.a, 't': list_prepend(r.role || ':' || r.text, s2.t)}]) AS g3
    FROM back b JOIN (SELECT *, CASE WHEN f IN ('b', 'd') THEN 1000000000 ELSE 0 END AS no, CASE WHEN f = 't' THEN 1 ELSE 0 END AS cut FROM turns) r
      ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.rn = b.k))),
best AS (SELECT conv_id, s0 FROM back WHERE k = 0)
SELECT o.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
       coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(b.s0.c, 0)::BIGINT AS cost,
       coalesce(b.s0.a, '') AS audit, sha256(coalesce(array_to_string(b.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
