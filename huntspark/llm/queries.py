"""One query per operator, over its whole table with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat, exact_dedup, fingerprints, jaccard_join, kneser_ney, mixing, packing, token_files, url_templates, vector_codes, vectors, warc
from .common import cut_lineage, shared_dir, table

#: The rules of the url query: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_warc_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every page as its WARC record says, after archives of all pages were written and read."""
    path = shared_dir(spark, "warc")
    warc.write(warc.records(table(spark, d, "pages").select("page_id", "url", "html")), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    found = warc.read(spark, path)
    found = cut_lineage(found.select(page(F.col("record_id")).alias("page_id"), "record_type", page(F.col("refers_to")).alias("refers_to"),
                                     F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
                                     F.when(response, F.octet_length("payload").cast("bigint")).alias("own_bytes")))
    sizes = found.filter(response).groupBy("payload_digest").agg(F.max("own_bytes").alias("digest_bytes"))
    return found.join(sizes, "payload_digest", "left").select("page_id", F.coalesce("own_bytes", "digest_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op2_scaled_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprinted(table(spark, d, "documents").select("doc_id", "text"))


def op3_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    rows = mixing.planned(docs)
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
                       F.aggregate("_mix_takes", F.lit(0).cast("bigint"), lambda a, x: a + x["words"]).alias("taken"))


def op4_url_templates(spark: SparkSession, d: str) -> DataFrame:
    """Rule and verdict of every url."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_templates.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_binary_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces of binary length, with a checksum of their ids."""
    pieces = packing.packed(table(spark, d, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), special=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_posting_lists(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


def trusted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are labelled good and not toxic, by all their labels."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def op7_kneser_ney(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of every document, the limit of its language, and whether it is kept."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return kneser_ney.judged(docs, trusted_ids(spark, d))


def op8_sparse_product(spark: SparkSession, d: str) -> DataFrame:
    """Size of every document's shingle set and the component it is linked to."""
    return jaccard_join.near_groups(table(spark, d, "documents").select("doc_id", "text"))


def op9_mixed_range_coder(spark: SparkSession, d: str) -> DataFrame:
    """Every document's ids as the coded files hold them."""
    path = shared_dir(spark, "tokens")
    token_files.write(table(spark, d, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), special=True)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_role_repair(spark: SparkSession, d: str) -> DataFrame:
    """All conversations with repaired roles, rendered turn by turn."""
    return chat.repaired(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Links and groups between the tokens of two vocabularies in every document."""
    return alignment.linked(table(spark, d, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_gnat_codes(spark: SparkSession, d: str) -> DataFrame:
    """Product codes of all vectors and what they lose."""
    return vector_codes.coded(table(spark, d, "embeddings").select("vec_id", "embedding", "label"))


def op13_fuse_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document, the one that stays of its equals, and how many they are."""
    return exact_dedup.deduplicated(table(spark, d, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_warc_chain, op2_scaled_sketch, op3_source_mix, op4_url_templates, op5_binary_packing, op6_posting_lists, op7_kneser_ney, op8_sparse_product, op9_mixed_range_coder, op10_role_repair,
                                   op11_token_alignment, op12_gnat_codes, op13_fuse_dedup)}

OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def _op4_sql(depth: int = 6, support: int = 20, z: float = 2.0, weight: float = 10.0, threshold: float = 0.5) -> str:
    rest = "substr(url, strpos(url, '://') + 3)"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]) - len(r[2]))
    pick = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(v, h, p)}'" for v, h, p in longest) + " END"
    upper, lower = url_templates.UPPER, url_templates.LOWER
    out = [f"""u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{upper}', '{lower}') ELSE '' END AS host,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages)""",
           f"r AS (SELECT *, {pick(lambda v, h, p: h + p)} AS rule, {pick(lambda v, h, p: v)} AS judged FROM u)",
           """t0 AS (SELECT host, path, count(*) AS pages, count(*) FILTER (WHERE judged = 'allow') AS good, count(*) FILTER (WHERE judged = 'block') AS bad,
        string_split(regexp_replace(path, '^/', ''), '/') AS segs, '' AS template FROM r GROUP BY host, path)"""]
    for k in range(1, depth + 1):
        out += [f"s{k} AS (SELECT *, segs[{k}] AS seg FROM t{k - 1})",
                f"n{k} AS (SELECT host, template, sum(good) AS g, sum(bad) AS b FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL)",
                f"""c{k} AS (SELECT host, template, seg, sum(pages) AS pages, sum(good) AS good, sum(bad) AS bad FROM s{k}
        WHERE seg IS NOT NULL AND NOT regexp_full_match(seg, '[0-9]*') GROUP BY ALL HAVING sum(pages) >= {support})""",
                f"""k{k} AS (SELECT host, template, seg, true AS stays FROM (SELECT *, good + bad AS n, g + b - good - bad AS rest, (b + 1) / (g + b + 2) AS pooled FROM c{k} JOIN n{k} USING (host, template))
        WHERE rest = 0 OR abs((bad + 1) / (n + 2) - (b - bad + 1) / (rest + 2)) > {z} * sqrt(pooled * (1 - pooled) * (1 / (n + 2) + 1 / (rest + 2))))""",
                f"""t{k} AS (SELECT s.host, s.path, s.pages, s.good, s.bad, s.segs, s.template || CASE WHEN s.seg IS NULL THEN '' WHEN k.stays THEN '/' || s.seg ELSE '/*' END AS template
        FROM s{k} s LEFT JOIN k{k} k ON s.host = k.host AND s.template = k.template AND s.seg = k.seg)"""]
    return f"""WITH {", ".join(out)},
known AS (SELECT host, path, good, bad, template || repeat('/*', greatest(len(segs) - {depth}, 0)) AS template FROM t{depth}),
base AS (SELECT coalesce(sum(bad) / nullif(sum(good) + sum(bad), 0), 0) AS base FROM known),
hosts AS (SELECT host, (sum(bad) + {weight} * any_value(base)) / (sum(good) + sum(bad) + {weight}) AS share FROM known, base GROUP BY host),
per AS (SELECT host, template, (sum(bad) + {weight} * any_value(share)) / (sum(good) + sum(bad) + {weight}) AS bad_share FROM known JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN bad_share >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, template, bad_share
FROM r JOIN known USING (host, path) JOIN per USING (host, template)"""


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.d)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.r AS component_id FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT d, min(r) AS r FROM c GROUP BY d) m ON m.d = documents.doc_id
"""



def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    apart = "list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"""a{i} AS (SELECT n, part, first(e ORDER BY d, e) AS e, min(d) AS d FROM (SELECT p.n, p.part, c.e, {apart} AS d FROM p JOIN c{i} c USING (part)) GROUP BY n, part)"""
    out = [f"""k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
           f"""p AS (SELECT n, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS s FROM k, range({parts}) t(part))""",
           f"c0 AS (SELECT part, n AS e, s FROM p WHERE n < {entries})"]
    for i in range(rounds):
        out += [near(i), f"""m{i} AS (SELECT part, e, list(m ORDER BY i) AS s FROM (SELECT part, e, i, (t - ((t % c) + c) % c) // c AS m FROM (
        SELECT p.part, e, i, CAST(sum(p.s[i]) AS BIGINT) AS t, count(*) AS c FROM p JOIN a{i} USING (n, part), range(1, 1000) r(i) WHERE i <= len(p.s) GROUP BY ALL)) GROUP BY part, e)""",
                f"c{i + 1} AS (SELECT c.part, c.e, coalesce(m.s, c.s) AS s FROM c{i} c LEFT JOIN m{i} m USING (part, e))"]
    return f"""WITH {", ".join([*out, near(rounds)])},
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (n), h"""


OP13_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256 FROM t
"""

ORACLES: dict[str, str] = {"op1_warc_chain": OP1_SQL, "op4_url_templates": _op4_sql(), "op8_sparse_product": OP8_SQL, "op12_gnat_codes": _op12_sql(), "op13_fuse_dedup": OP13_SQL}
