"""Registered queries of this subpackage: one per operator, over the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100)).select("doc_id", "n_shingles", "component_id")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest

    return digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import report

    return report(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(extra)))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_index import digest, leaks

    return digest(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, digest, repair

    rows = table(spark, sf_dir, "conversations")
    return digest(rows, repair(damaged(rows)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(chosen, lower).otherwise(F.col("text")))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_bpe": op4_bpe,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ann": op6_ann,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_decontamination": op11_decontamination,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, contains(role, ': ') OR contains(role || chr(10) || text, '###') OR contains(role || ' ' || text, '</turn>' || chr(10))
            OR regexp_matches(text, '\\[seh]') OR regexp_matches(role, '\\[sehc]') AS odd FROM turns
), coded AS (
  SELECT *, CASE WHEN odd THEN replace(replace(replace(text, '\', '\s'), '</turn>', '\e'), '###', '\h') ELSE text END AS body,
         CASE WHEN odd THEN replace(replace(replace(replace(role, '\', '\s'), '</turn>', '\e'), '###', '\h'), ':', '\c') ELSE role END AS head
  FROM marked
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""

#: Cosines of all pairs; used on the small driver tables only.
COSINES = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE {COSINES},
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM comp c
"""

ANN_SQL = f"""
WITH {COSINES}, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""

#: All pairs that share a shingle; used on the small driver tables only.
NGRAM_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, coalesce((SELECT n.n FROM n WHERE n.doc_id = a), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach GROUP BY a
"""

#: Every window of every item against every run of as many words; used on the small driver tables only.
LEAK_SQL = r"""
WITH lower AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM lower),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
runs AS (SELECT r, k, l, array_to_string(ws[k:k + l - 1], ' ') AS w FROM (SELECT d.*, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l)),
hits AS (SELECT runs.r, runs.k, runs.l, win.item_id FROM runs JOIN win USING (l, w)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + l)) FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters, bit by bit."""
    step = "list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, y: {step}, 4294967295::BIGINT), 4294967295)"


#: Row after row, the least (cost, edits) of each state; edits: K, R, D and up to two inserts before a row.
REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations
), d AS (
  SELECT id, conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE how <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, copy) AS n,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM d
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o
), r AS (
  SELECT conv_id, turn, n, role, text, initial, before, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f
), inserted(g, h, edits, said) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
    (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (3, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:'])
), moves(edit, h, role, g) AS (
  VALUES ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2), ('K', 0, '', 0), ('K', 1, '', 1), ('K', 2, '', 2), ('K', 3, '', 3),
    ('R', 0, 'user', 2), ('R', 1, 'user', 2), ('R', 2, 'assistant', 3), ('R', 3, 'user', 2), ('D', 0, '', 0), ('D', 1, '', 1), ('D', 2, '', 2), ('D', 3, '', 3)
), st AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS g, repeat('0', 12) AS k, []::VARCHAR[] AS lines FROM r
  UNION ALL
  SELECT conv_id, n, g, min(k), arg_min(lines, k) FROM (
    SELECT s.conv_id, s.n + 1 AS n, m.g, lpad((s.k[1:12]::BIGINT + 5 * len(i.edits) + CASE m.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN m.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END)::VARCHAR, 12, '0')
        || s.k[13:] || i.edits || m.edit AS k,
      list_concat(s.lines, i.said, CASE m.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [m.role || ':' || r.text] END) AS lines
    FROM st s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1 JOIN inserted i ON i.g = s.g
    JOIN moves m ON m.h = i.h AND (m.edit <> 'K' OR m.role = r.initial) AND (m.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  ) GROUP BY conv_id, n, g
), ended AS (
  SELECT conv_id, min(k) AS k, arg_min(lines, k) AS lines FROM (
    SELECT s.conv_id, lpad((s.k[1:12]::BIGINT + 5 * len(i.edits))::VARCHAR, 12, '0') || s.k[13:] || i.edits AS k, list_concat(s.lines, i.said) AS lines
    FROM st s JOIN (SELECT conv_id, max(n) AS n FROM r GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.n = s.n JOIN inserted i ON i.g = s.g WHERE i.h IN (0, 3)
  ) GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(k[1:12]::BIGINT, 0)::BIGINT AS cost, coalesce(k[13:], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def merkle_sql(levels: int = 6) -> str:
    """The manifest with its levels unrolled: enough for 16 ** levels rows a source and sources."""
    def leaf(text: str) -> str:
        part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
        return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""d AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS key, {leaf("text")} AS h,
        CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS found FROM documents)""",
            """n0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY key) AS total FROM d)"""]

    def tree(name: str) -> None:
        for k in range(levels):
            ctes.append(f"""{name}{k + 1} AS (SELECT key, idx // 16 AS idx, (total + 15) // 16 AS total, CASE WHEN total = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h
              FROM {name}{k} GROUP BY key, idx // 16, total)""")
            w = "OVER (PARTITION BY key, idx // 16 ORDER BY idx ROWS BETWEEN "
            ctes.append(f"""{name}s{k} AS (SELECT key, idx, total = 1 AS lone, coalesce(string_agg(h, '') {w}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(h, '') {w}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})""")

    tree("n")
    ctes.append(f"t0 AS (SELECT 0 AS key, key AS idx, h, count(*) OVER () AS total FROM n{levels})")
    tree("t")
    ctes.append("f0 AS (SELECT doc_id, key, idx, h AS leaf, found AS acc, '' AS proof FROM n0)")
    names = [f"n{k}" for k in range(levels)] + [f"t{k}" for k in range(levels)]
    for at, name in enumerate(names):
        k = int(name[1:])
        on = f"s.key = f.key AND s.idx = f.idx // {16 ** k}" if name[0] == "n" else f"s.idx = f.key // {16 ** k}"
        ctes.append(f"""f{at + 1} AS (SELECT f.doc_id, f.key, f.idx, f.leaf, CASE WHEN s.lone THEN acc ELSE sha256(s.l || acc || s.r) END AS acc, proof || CASE WHEN s.lone THEN '' ELSE s.l || s.r END AS proof
          FROM f{at} f JOIN {name[0]}s{k} s ON {on})""")
    return f"""WITH {", ".join(ctes)}
    SELECT doc_id, leaf, n.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified
    FROM f{len(names)} f JOIN n{levels} n ON n.key = f.key CROSS JOIN t{levels} t"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": NGRAM_SQL,
    "op5_embedding_dedup": EMBEDDING_SQL,
    "op6_ann": ANN_SQL,
    "op10_chat_format": CHAT_SQL,
    "op11_decontamination": LEAK_SQL,
    "op12_conversation_repair": REPAIR_SQL,
    "op13_merkle_manifest": merkle_sql(),
}
