"""Registered queries ``opN_<name>`` over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from typing import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capforge.llm.common import shared_path, table
from capforge.llm.divergence import divergence_audit
from capforge.llm.exact_dedup import exact_dedup
from capforge.llm.fill_middle import fill_in_middle, write_frames
from capforge.llm.licences import KNOWN, licence_table, scan_licences
from capforge.llm.mixing import mix_sources
from capforge.llm.ngram_join import ngram_jaccard
from capforge.llm.piece_codec import piece_digests
from capforge.llm.token_counts import token_counts
from capforge.llm.toxicity import toxicity
from capforge.llm.training_order import PER_SHARD, read_training_order, write_training_order
from capforge.llm.vector_dedup import near_vectors
from capforge.llm.vector_topk import exact_top_k
from capforge.llm.warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op9_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS points,
             sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""")
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@register("op7_mix_sources", r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM t GROUP BY source),
o AS (SELECT *, row_number() OVER r AS i, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
      FROM s WINDOW r AS (ORDER BY source_size / weight::DOUBLE, weight, source NULLS LAST)),
f AS (SELECT * FROM o WHERE (weight * (total - caps))::DOUBLE / weights < 3 * source_size ORDER BY i LIMIT 1),
g AS (SELECT o.source, o.source_size,
             CASE WHEN f.i IS NULL OR o.i < f.i THEN 3.0 * o.source_size::DOUBLE
                  ELSE (o.weight * (f.total - f.caps))::DOUBLE / f.weights END AS target
      FROM o LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM g),
q AS (SELECT *, target - copies * source_size AS rest FROM p),
c AS (SELECT t.source, t.hash AS cut, sum(size) OVER (PARTITION BY t.source ORDER BY t.hash) AS words FROM t
      UNION ALL SELECT source, -1, 0 FROM s),
b AS (SELECT q.source, first(c.cut ORDER BY abs(c.words - q.rest), c.words, c.cut) AS cut
      FROM q JOIN c ON q.source IS NOT DISTINCT FROM c.source WHERE q.rest > 0 GROUP BY q.source)
SELECT t.doc_id, t.size, q.source_size, q.target,
       (t.size * (q.copies + CASE WHEN t.hash <= coalesce(b.cut, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source
""")
def op7_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op1_ngram_jaccard")
def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_piece_codec")
def op6_piece_codec(spark, sf_dir):
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op10_exact_top_k", """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, [floor(256 * c::DOUBLE) for c in embedding] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len([c for c in embedding if c IS NOT NULL AND isfinite(c)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, q.r AS query_row, d.r, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
      FROM x q JOIN x d ON q.r <> d.r AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0 AND d.vec_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op10_exact_top_k(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


@register("op4_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM w
""")
def op4_warc(spark, sf_dir):
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _licence_sql() -> str:
    """The definition over single words: lines, then words, then spellings."""
    def form(text: str) -> str:
        return f"""trim(regexp_replace({spelled(f"""' ' || array_to_string([{line('l')} for l in string_split(
            replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))], ' ') || ' '""")}, ' +', ' ', 'g'))"""

    def line(l: str) -> str:
        return f"""CASE WHEN regexp_matches(lower({l}), '^[^a-z0-9]*(copyright|©|\\(c\\))[^a-z]*(\\(c\\)|©|[0-9]{{4}})') THEN ''
            ELSE regexp_replace(lower({l}), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F«»“”„‘’‚…–—·•©®™]+', ' ', 'g') END"""

    def spelled(words: str) -> str:
        out = f"regexp_replace({words}, ' +', '  ', 'g')"
        for stems, a, b in (("author|capital|categor|character|emphas|initial|maxim|minim|optim|organ|real|recogn|util",
                             "is(e|ed|es|ing|ation|ations) ", "iz\\2 "), ("behavi|col|fav|hon|lab", "our", "or"),
                            ("acknowledg|judg", "ement", "ment")):
            out = f"regexp_replace({out}, ' ({stems}){a}', ' \\1{b}', 'g')"
        out = f"regexp_replace({out}, ' +', ' ', 'g')"
        for old, new in (("licenc", "licens"), (" whilst ", " while "), (" centre ", " center "), (" catalogue ", " catalog "),
                         (" programme ", " program "), (" artefact", " artifact"), (" copyright owner", " copyright holder"),
                         (" per cent ", " percent "), (" sub licens", " sublicens"), (" non commercial ", " noncommercial "),
                         (" https ", " http ")):
            out = f"replace({out}, '{old}', '{new}')"
        return out

    known = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(KNOWN.items()))
    return f"""
WITH k AS (SELECT min(licence) AS licence, {form('text')} AS form FROM (VALUES {known}) v(licence, text) GROUP BY form),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, {form('text')} AS form FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
s AS (SELECT l.doc_id, count(DISTINCT k.licence) AS n, min(k.licence) AS first
      FROM l JOIN k ON {form('l.line')} = k.form GROUP BY l.doc_id)
SELECT f.doc_id, CASE WHEN f.form <> '' THEN sha256(f.form) END AS canonical_sha256, k.licence,
       coalesce(s.n, 0) AS n_stated, s.first AS first_stated
FROM f LEFT JOIN k ON f.form = k.form LEFT JOIN s ON f.doc_id = s.doc_id"""


@register("op2_licence_scan", _licence_sql())
def op2_licence_scan(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"), licence_table(spark))


@register("op3_training_order")
def op3_training_order(spark, sf_dir):
    path = shared_path(spark, "shards")
    n = write_training_order(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)
    if not n:
        return spark.createDataFrame([], "slot long, shard long, n_tokens long, ids_sha256 string")
    return read_training_order(spark, path, ids=False).select(
        "slot", F.floor(F.col("slot") / PER_SHARD).alias("shard"), "n_tokens", "ids_sha256")


@register("op11_vector_dedup")
def op11_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@register("op12_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
             ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
             ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
n AS (SELECT *, len(units)::BIGINT AS n FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
""")
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle(write_frames(table(spark, sf_dir, "documents")))


@register("op13_divergence_audit", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, all_n,
             (1 + 1000000000 * (coalesce(n.n, 0) + 1) // (coalesce(s.total, 0)::BIGINT + l.v))::BIGINT AS p,
             (1 + 1000000000 * (all_n + 1) // (l.total::BIGINT + l.v))::BIGINT AS q
      FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN n ON g.lang = n.lang AND g.source = n.source AND k.term = n.term),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o
QUALIFY part = 'pair' OR rank <= 200
""")
def op13_divergence_audit(spark, sf_dir):
    return divergence_audit(table(spark, sf_dir, "documents"))
