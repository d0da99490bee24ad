"""The queries of the operators, over whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers

from arcwise.llm.byte_bpe import bpe_round_trip
from arcwise.llm.decontaminate import decontamination_digest
from arcwise.llm.jaccard_join import shingle_components
from arcwise.llm.language import language_predictions
from arcwise.llm.language_model import held_out, score_texts
from arcwise.llm.line_dedup import line_digest
from arcwise.llm.secrets import secret_digest
from arcwise.llm.shared import table
from arcwise.llm.suffix_dedup import suffix_digest
from arcwise.llm.vector_index import near_duplicate_vectors
from arcwise.llm.warc import archive_round_trip

#: The vocabulary that op1 and the pipeline encode with.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN, offsets=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256")


def op2_language_id(spark, sf_dir):
    return language_predictions(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return shingle_components(table(spark, sf_dir, "documents"))


def op4_language_model(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(), RANKS, public_tokenizers.PATTERN)


def op5_suffix_dedup(spark, sf_dir):
    return suffix_digest(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return line_digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_vector_index(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_secrets(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_byte_bpe, op2_language_id, op3_jaccard_join, op4_language_model, op5_suffix_dedup, op6_line_dedup, op7_decontamination, op8_vector_index, op9_warc, op10_secrets)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS item FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
        FROM documents d JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM b)),
        f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING count(*) > 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, i FROM w JOIN f USING (s) WHERE low < doc_id)),
        n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans
            FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM c) GROUP BY doc_id),
        k AS (SELECT a.doc_id, string_agg(substr(h, 2 * a.p + 1, 2), '' ORDER BY a.p) AS kept
            FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM b JOIN n USING (doc_id)) a ANTI JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(from_hex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
        FROM b LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    # Lines by their sets of words; a similar earlier set shares one of the rarest words, so only these are joined.
    "op6_line_dedup": f"""
        WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS xs, string_split({_LOWER}, chr(10)) AS low FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(range(0, len(xs))) AS i, unnest(xs) AS x, unnest(low) AS y FROM t),
        w AS (SELECT doc_id, i, x, list_sort(list_distinct(regexp_extract_all(y, '[^\\x20\\x09-\\x0D]+'))) AS ws FROM l),
        s AS (SELECT row_number() OVER () AS id, ws, len(ws) AS n, min(doc_id * 1000000 + i) AS pos FROM w WHERE len(ws) > 0 GROUP BY ws),
        u AS (SELECT id, n, pos, unnest(ws) AS word FROM s),
        f AS (SELECT word, count(*) AS k FROM u GROUP BY word),
        p AS (SELECT id, n, pos, word FROM u JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, word) <= n - (80 * n + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.pos < b.pos AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
        g AS (SELECT DISTINCT b AS id FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
        r AS (SELECT doc_id, i, x, s.id IS NOT NULL AND (s.pos < doc_id * 1000000 + i OR g.id IS NOT NULL) AS gone FROM w LEFT JOIN s USING (ws) LEFT JOIN g ON g.id = s.id),
        k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
    "op7_decontamination": f"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
        pat AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS pattern FROM bw WHERE len(ws) > 0),
        sizes AS (SELECT DISTINCT m FROM pat),
        win AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS pattern FROM dw, sizes WHERE len(ws) >= m),
        hit AS (SELECT doc_id, i, m, item_id FROM win JOIN pat USING (m, pattern)),
        places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_vector_index": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL),
        u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
        p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
        r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON r.node = p.a)
        SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
        FROM embeddings e JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = e.vec_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, row_number() OVER () AS n FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
}
