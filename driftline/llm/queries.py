"""The queries of this subpackage over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import ann, exact_dedup, fim, licenses, maxscore, mixing, near_dedup, packing, pii, repair, token_files, toxicity, warc
from driftline.sources.tables import load_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn
    return add


@query("op1_exact_dedup", """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents, every row with its verdict."""
    return exact_dedup.exact_duplicates(load_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_toxic_severity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected toxicity grade of every document; fitted on at most 20,000 labelled ones."""
    docs = load_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, load_table(spark, sf_dir, "labels")))


@query("op3_near_dedup", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS ws
        FROM documents),
    s AS (
        SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
               ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh
        FROM w),
    t AS (SELECT sh, min(doc_id) AS u, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
    e AS (SELECT u, n, unnest(sh) AS g FROM t),
    link AS (
        SELECT a.u AS x, b.u AS y
        FROM e a JOIN e b ON a.g = b.g AND a.u < b.u AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(u, r) AS (SELECT u, u FROM t UNION SELECT reach.u, y FROM reach JOIN both_ways ON x = r),
    comp AS (SELECT u, min(r) AS c FROM reach GROUP BY u)
    SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id,
           s.doc_id = coalesce(comp.c, s.doc_id) AS kept
    FROM s LEFT JOIN t ON t.sh = s.sh LEFT JOIN comp ON comp.u = t.u""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 5-word shingles, similarity 0.85 or more."""
    return near_dedup.near_duplicates(load_table(spark, sf_dir, "documents"))


@query("op4_warc_archive", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
         n AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS top
               FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM n""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written and read back."""
    folder = warc.archive_pages(load_table(spark, sf_dir, "pages"))
    return warc.archived_pages(spark, folder)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 4096 tokens."""
    return packing.pack(load_table(spark, sf_dir, "documents"))


@query("op6_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal values replaced by format-preserving pseudonyms."""
    return pii.pseudonyms(load_table(spark, sf_dir, "documents"), key=b"driftline pseudonyms")


@query("op7_licences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    docs = load_table(spark, sf_dir, "documents")
    return licenses.document_licences(docs, licenses.train(docs))


@query("op8_nearest_vectors")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20, against all rows."""
    return ann.search(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: weights 3, 1, 2, 150 % of all words, at most two copies."""
    mixed = mixing.mix(load_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    folder = token_files.write_tokens(load_table(spark, sf_dir, "documents"))
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op11_maxscore_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id,
                      list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best integer inner products of every row whose vec_id is divisible by 100, against all rows."""
    return maxscore.search(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10, scale=1024)


@query("op12_fill_in_middle", r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x FROM documents),
         u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
                      ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
                      ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
         c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a,
                      greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
                      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
                           THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
         s AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m,
                      array_to_string(l[b + 1:n], '') AS z FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m
                            ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM s""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in the middle, and rebuilt from the outputs."""
    outputs = fim.rearranged(load_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    return fim.restored(outputs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op13_conversation_repair", r"""
    WITH RECURSIVE
    r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    -- crc32, bit by bit: a byte is mixed in, then eight shifts (-1) follow
    x AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
              string_split(key, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)) % 20 AS d FROM r),
    m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                 CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM x),
    o AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, role[1:1] AS initial,
                 row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS occ,
                 lag(role[1:1]) OVER w || role[1:1] AS pair
          FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
    f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN occ > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated'
                    ELSE 'ok' END AS fault FROM o),
    s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    -- cost to go, audit and repaired lines from the end, by state: e nothing yet, y after system, u after user, a after assistant
    g AS (SELECT conv_id, n + 1 AS pos, {'c': 0, 'a': '', 'x': ''} AS e, {'c': 6, 'a': 'II', 'x': 'user:' || chr(10) || 'assistant:' || chr(10)} AS y,
                 {'c': 3, 'a': 'I', 'x': 'assistant:' || chr(10)} AS u, {'c': 0, 'a': '', 'x': ''} AS a FROM s
          UNION ALL
          SELECT conv_id, pos, list_sort([e, {'c': u.c + 3, 'a': 'I' || u.a, 'x': 'user:' || chr(10) || u.x}])[1],
                 list_sort([y, {'c': u.c + 3, 'a': 'I' || u.a, 'x': 'user:' || chr(10) || u.x}])[1], u, a
          FROM (SELECT conv_id, pos, e, y, list_sort([u, {'c': a.c + 3, 'a': 'I' || a.a, 'x': 'assistant:' || chr(10) || a.x}])[1] AS u,
                       list_sort([a, {'c': u.c + 3, 'a': 'I' || u.a, 'x': 'user:' || chr(10) || u.x}])[1] AS a
                FROM (SELECT conv_id, pos,
                             list_sort([{'c': e.c + 4, 'a': 'D' || e.a, 'x': e.x},
                                        {'c': y.c + t + CASE initial WHEN 's' THEN 0 ELSE 999999 END, 'a': 'K' || y.a, 'x': k || y.x},
                                        {'c': u.c + t + CASE initial WHEN 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a, 'x': k || u.x},
                                        {'c': u.c + t + 3, 'a': 'R' || u.a, 'x': ru || u.x}])[1] AS e,
                             list_sort([{'c': y.c + 4, 'a': 'D' || y.a, 'x': y.x},
                                        {'c': u.c + t + CASE initial WHEN 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a, 'x': k || u.x},
                                        {'c': u.c + t + 3, 'a': 'R' || u.a, 'x': ru || u.x}])[1] AS y,
                             list_sort([{'c': u.c + 4, 'a': 'D' || u.a, 'x': u.x},
                                        {'c': a.c + t + CASE initial WHEN 'a' THEN 0 ELSE 999999 END, 'a': 'K' || a.a, 'x': k || a.x},
                                        {'c': a.c + t + 3, 'a': 'R' || a.a, 'x': ra || a.x}])[1] AS u,
                             list_sort([{'c': a.c + 4, 'a': 'D' || a.a, 'x': a.x},
                                        {'c': u.c + t + CASE initial WHEN 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a, 'x': k || u.x},
                                        {'c': u.c + t + 3, 'a': 'R' || u.a, 'x': ru || u.x}])[1] AS a
                      FROM (SELECT g.conv_id, f.pos, f.initial, e, y, u, a,
                                   CASE fault WHEN 'ok' THEN 0 WHEN 'truncated' THEN 3 ELSE 999999 END AS t,
                                   role || ':' || text || chr(10) AS k, 'user:' || text || chr(10) AS ru, 'assistant:' || text || chr(10) AS ra
                            FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.pos = g.pos - 1))))
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
           sha256(coalesce(e.x[1:len(e.x) - 1], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
         LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id AND g.pos = 1""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired at least cost: faults, cost, audit and digest of every conversation."""
    rows = repair.damaged(load_table(spark, sf_dir, "conversations"))
    return repair.report(repair.repaired(rows, gone=F.col("gone")))
