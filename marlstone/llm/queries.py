"""Queries of the problems tagged llm and the SQL they are checked against."""

from __future__ import annotations

from marlstone.llm import communities, copies, languages, leaks, nearest, packing, pieces, spellings
from marlstone.runtime import read_table


def _records(spark, d):
    return copies.job_records(read_table(spark, d, "jobs")).unionByName(copies.raw_records(read_table(spark, d, "raw_jobs")))


def p6_found(spark, d):
    return copies.found(_records(spark, d))


def p6_groups(spark, d):
    return copies.one_per_group(_records(spark, d))


def p3_found(spark, d):
    return pieces.pieces(read_table(spark, d, "embed_queue")).where("piece_no = 0").select("queue_id", "cut_level")


def p3_pieces(spark, d):
    return pieces.pieces(read_table(spark, d, "embed_queue"))


def p3_check(spark, d):
    return pieces.checked(pieces.pieces(read_table(spark, d, "embed_queue")))


def p4_found(spark, d):
    return spellings.pairs(read_table(spark, d, "jobs"), "agency")


def p4_links(spark, d):
    return spellings.linked(read_table(spark, d, "jobs"), "agency")


def p5_found(spark, d):
    return nearest.close_pairs(read_table(spark, d, "vector_index"))


def p5_neighbours(spark, d):
    return nearest.neighbours(read_table(spark, d, "vector_index"))


def p1_found(spark, d):
    return communities.wrong(read_table(spark, d, "vector_index"), read_table(spark, d, "clusters"))


def p1_communities(spark, d):
    return communities.described(communities.members(read_table(spark, d, "vector_index")))


def p1_check(spark, d):
    return communities.checked(communities.members(read_table(spark, d, "vector_index")), read_table(spark, d, "clusters"))


def p5_check(spark, d):
    return nearest.recall(read_table(spark, d, "vector_index"))


def p7_containers(spark, d):
    return packing.packed(read_table(spark, d, "documents"))


def p7_check(spark, d):
    return packing.checked(packing.packed(read_table(spark, d, "documents")))


def p8_found(spark, d):
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_found(spark, d):
    return languages.mislabelled(read_table(spark, d, "documents"))


def p9_segments(spark, d):
    return languages.segments(read_table(spark, d, "documents"))


def p9_documents(spark, d):
    return languages.documents(read_table(spark, d, "documents"))


QUERIES = {"p7_containers": p7_containers, "p7_check": p7_check, "p8_found": p8_found, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents, "p1_found": p1_found, "p1_communities": p1_communities, "p1_check": p1_check, "p5_check": p5_check, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p4_found": p4_found, "p4_links": p4_links, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_check": p3_check, "p6_found": p6_found, "p6_groups": p6_groups}

_STRIP = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_NAMED = r"CASE WHEN ltrim(payload) LIKE '{{%' THEN json_extract_string(lower(payload), '$.{0}') ELSE regexp_extract(lower(payload), '(^|\|)\s*{0}\s*=([^|]*)', 2) END"
_KEYED = f"""keyed AS (SELECT DISTINCT 'jobs' AS src, jobId AS id, {_STRIP.format('agency')} AS a, {_STRIP.format('jobTitle')} AS b, '' AS c
        FROM jobs WHERE agency IS NOT NULL AND jobTitle IS NOT NULL
        UNION ALL SELECT 'raw_jobs', raw_id, {_STRIP.format(_NAMED.format('agency'))}, {_STRIP.format(_NAMED.format('jobtitle'))}, {_STRIP.format(_NAMED.format('unit'))} FROM raw_jobs),
        firsts AS (SELECT *, min(id) OVER (PARTITION BY src, a, b, c) AS first_id FROM keyed)"""

#: White space but for the line feed, inside a character class.
_BLANK = r"\t\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SIZES = "list_max(list_transform({0}, lambda x: length(regexp_replace(x, '^[\\n{1}]+|[\\n{1}]+$', '', 'g'))))"
_PARAGRAPHS = rf"string_split_regex(text, '\n([{_BLANK}]*\n)+|\r([\n{_BLANK.replace(chr(92) + 'r', '')}]*\r)+')"
_SENTENCES = rf"flatten(list_transform({_PARAGRAPHS}, lambda p: string_split(regexp_replace(regexp_replace(p, '([.!?])([\n{_BLANK}]+|$)', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1))))"
_RUNS = rf"string_split_regex(text, '[\n{_BLANK}]+')"
_LIVE = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, doc_key ORDER BY enqueued_at DESC NULLS LAST, queue_id DESC) AS r FROM embed_queue) WHERE r = 1)"""
_DECODED = """one AS (SELECT vec_id, cluster_id, scaling_factor::DOUBLE AS f, packed_vector AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY packed_vector, scaling_factor) AS r FROM vector_index
        WHERE len(packed_vector) = 16 AND len(list_filter(packed_vector, lambda w: w IS NULL)) = 0 AND vec_id IS NOT NULL AND isfinite(scaling_factor) AND scaling_factor <> 0) WHERE r = 1),
    decoded AS (SELECT vec_id, cluster_id, list_transform(range(128), lambda i: -f * (((p[i // 8 + 1] >> (8 * (i % 8))) & 255) - 127.5)) AS v FROM one)"""

SQL = {
    "p1_found": f"""WITH {_DECODED}, near AS (SELECT d.vec_id, d.cluster_id AS stored, c.cluster_id, row_number() OVER (PARTITION BY d.vec_id ORDER BY list_distance(d.v, c.centroid::DOUBLE[]), c.cluster_id) AS r FROM decoded d, clusters c)
        SELECT vec_id, cluster_id FROM near WHERE r = 1 AND stored IS DISTINCT FROM cluster_id""",
    "p1_check": f"WITH {_DECODED} SELECT count(*) AS entries, 1 AS communities_each, true AS together, true AS apart FROM decoded",
    "p5_check": f"WITH {_DECODED} SELECT count(*) AS n_queries, true AS recall_95 FROM decoded WHERE vec_id % 50 = 0",
    "p3_found": f"""WITH {_LIVE} SELECT queue_id, CASE WHEN {_SIZES.format(_PARAGRAPHS, _BLANK)} <= 1200 THEN 'paragraph' WHEN {_SIZES.format(_SENTENCES, _BLANK)} <= 1200 THEN 'sentence'
        WHEN {_SIZES.format(_RUNS, _BLANK)} <= 1200 THEN 'word' ELSE 'none' END AS cut_level FROM live WHERE length(text) > 1200""",
    "p3_check": f"WITH {_LIVE} SELECT count(*) AS texts, sum(length(text))::BIGINT AS characters, 0 AS over_limit, 0 AS wrong_overlaps, 0 AS inside_the_next FROM live WHERE length(text) > 1200",
    "p7_check": "SELECT count(*) AS documents, 0 AS over_capacity, 0 AS split_wrongly, 0 AS unplaced, true AS little_unused, true AS steps_balanced FROM documents",
    "p6_found": f"WITH {_KEYED} SELECT src, first_id, id AS copy_id FROM firsts WHERE id <> first_id",
    "p6_groups": f"WITH {_KEYED} SELECT src, first_id, count(*) AS n_copies FROM firsts GROUP BY ALL",
}
