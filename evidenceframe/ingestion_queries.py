"""Queries of what comes before the index: splits, formulas, segments, alignment, units, with their SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import alignment, formulas, image_units, linking, segments, splitting, structure, table_merge
from .plans.retrieval import Corpus
from .queries import CHUNKS, query, table
from .settings import DEFAULTS

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# Structural split

SPLIT = replace(DEFAULTS, hard_chars=400, hard_part_min=100, hard_overlap=40)
#: Where a part of a window ends, in code points: after the last sentence or blank line that is far enough, else a break, else a blank.
_STOP = r"""CASE WHEN start + 400 >= length(text) THEN length(text)
  WHEN length(array_to_string(regexp_extract_all(substring(text, start + 1, 400), '(?s).*?(?:[.!?。！？]?\n\n+|[.!?。！？]\s+)'), '')) >= 220 THEN start + length(array_to_string(regexp_extract_all(substring(text, start + 1, 400), '(?s).*?(?:[.!?。！？]?\n\n+|[.!?。！？]\s+)'), ''))
  WHEN 400 - strpos(reverse(substring(text, start + 1, 400)), chr(10)) >= 220 AND strpos(reverse(substring(text, start + 1, 400)), chr(10)) > 0 THEN start + 400 - strpos(reverse(substring(text, start + 1, 400)), chr(10)) + 1
  WHEN 400 - strpos(reverse(substring(text, start + 1, 400)), ' ') >= 220 AND strpos(reverse(substring(text, start + 1, 400)), ' ') > 0 THEN start + 400 - strpos(reverse(substring(text, start + 1, 400)), ' ') + 1
  ELSE start + 400 END"""
_PARTS = f"""{CHUNKS.replace("body AS (", "RECURSIVE body AS (", 1)},
kinds AS (SELECT node_id, doc_id, page, chunk_index, text, CASE WHEN chunk_index % 4 = 2 THEN 'table' ELSE 'text' END AS modality FROM nodes),
cut(node_id, text, start, stop) AS (
  SELECT node_id, text, 0 AS start, {_STOP.replace("start", "0")} FROM kinds WHERE modality = 'text' AND length(text) > 400
  UNION ALL SELECT node_id, text, start, {_STOP} FROM (SELECT node_id, text, greatest(stop - 40, start + 1) AS start FROM cut WHERE stop < length(text))),
parts AS (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY start) - 1 AS no, count(*) OVER (PARTITION BY node_id) AS n, {STRIP.format("substring(text, start + 1, stop - start)")} AS part
  FROM cut WHERE {STRIP.format("substring(text, start + 1, stop - start)")} <> ''),
split AS (SELECT k.node_id AS old, CASE WHEN p.n > 1 THEN k.node_id || ':part:' || p.no ELSE k.node_id END AS node_id, CASE WHEN p.n > 1 THEN p.no END AS no, CASE WHEN p.n > 1 THEN p.n END AS n,
  CASE WHEN p.n > 1 THEN p.part ELSE k.text END AS text, CASE WHEN p.n > 1 THEN length(k.text) END AS original FROM kinds k LEFT JOIN parts p USING (node_id))"""


def _kinds(spark, sf_dir):
    """The nodes of the corpus, of which every fourth counts as a table."""
    return Corpus(spark, sf_dir).nodes.withColumn("modality", F.when(F.col("chunk_index") % 4 == 2, "table").otherwise("text"))


@query(f"WITH {_PARTS} SELECT node_id, CASE WHEN n > 1 THEN old END AS parent_id, CAST(no AS INTEGER) AS part_index, CAST(n AS INTEGER) AS part_count, CAST(original AS INTEGER) AS original_length, text FROM split")
def chk06_split_nodes(spark, sf_dir):
    return structure.split_nodes(_kinds(spark, sf_dir), SPLIT).select("node_id", "parent_id", "part_index", "part_count", "original_length", "text")


@query(f"""WITH {_PARTS},
edges AS (
  SELECT node_id AS src, 'prev_id' AS relation, 0 AS pos, lag(node_id) OVER w AS dst FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index) QUALIFY dst IS NOT NULL
  UNION ALL SELECT node_id, 'next_id', 0, lead(node_id) OVER w AS dst FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index) QUALIFY dst IS NOT NULL
  UNION ALL SELECT a.node_id, 'same_page_node_ids', b.chunk_index, b.node_id FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND a.page = b.page AND a.node_id <> b.node_id
  UNION ALL SELECT a.node_id, 'context_prev_node_id', 0, max_by(b.node_id, b.chunk_index) FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.modality = 'text' AND b.chunk_index < a.chunk_index WHERE a.modality <> 'text' GROUP BY a.node_id
  UNION ALL SELECT a.node_id, 'context_next_node_id', 0, min_by(b.node_id, b.chunk_index) FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.modality = 'text' AND b.chunk_index > a.chunk_index WHERE a.modality <> 'text' GROUP BY a.node_id),
ids AS (SELECT old, node_id, coalesce(no, 0) AS no, coalesce(n, 1) AS n FROM split),
to_ AS (SELECT src, relation, row_number() OVER (PARTITION BY src, relation ORDER BY pos, no) - 1 AS pos, i.node_id AS dst FROM edges JOIN ids i ON i.old = dst WHERE relation LIKE '%_ids' OR i.no = 0),
outer_ AS (SELECT i.node_id AS src_id, relation, pos, dst AS dst_id FROM to_ JOIN ids i ON i.old = src WHERE NOT (relation = 'prev_id' AND i.no > 0) AND NOT (relation = 'next_id' AND i.no < i.n - 1)),
inner_ AS (SELECT a.node_id AS src_id, unnest(CASE WHEN b.no < a.no THEN ['prev_id', 'doc_prev_node_id'] ELSE ['next_id', 'doc_next_node_id'] END) AS relation, 0 AS pos, b.node_id AS dst_id FROM ids a JOIN ids b ON a.old = b.old AND abs(a.no - b.no) = 1)
SELECT src_id, relation, CAST(pos AS INTEGER) AS pos, dst_id FROM outer_ UNION ALL SELECT * FROM inner_""")
def chk06_rewritten_edges(spark, sf_dir):
    """Neighbours, nodes of the same page and text around tables, after the split."""
    nodes = _kinds(spark, sf_dir)
    near = linking.nearest_text(nodes)
    around = near.select(F.col("node_id").alias("src_id"), F.explode(F.map_from_arrays(F.array(F.lit("context_prev_node_id"), F.lit("context_next_node_id")), F.array("context_prev_node_id", "context_next_node_id"))).alias("relation", "dst_id"))
    lists = linking.same_page_edges(nodes).join(nodes.select(F.col("node_id").alias("dst_id"), F.col("chunk_index").alias("pos")), "dst_id")
    single = linking.adjacent_edges(nodes).unionByName(around.where("dst_id is not null")).withColumn("pos", F.lit(0))
    edges = single.unionByName(lists.select("src_id", "relation", "dst_id", "pos"))
    return structure.rewritten_edges(edges, structure.split_nodes(nodes, SPLIT)).select("src_id", "relation", "pos", "dst_id")


# Formulas: words of the documents by their place become formulas, lone dollars and things that look like formulas

_WORDS = (
    (17, 3, "'$' || w || '_' || i || '=2$'"), (29, 5, "'$$a=' || w || '$$' || chr(10)"), (31, 5, "'$$' || w || '$$'"), (41, 7, r"'\begin{align*}' || w || '^2\end{align*}'"),
    (43, 2, r"'\(' || w || '+1\)'"), (47, 1, "'$'"), (53, 4, "'$[3, ' || i || ']$'"), (59, 6, r"'\[' || w || '\]'"), (61, 8, "'<math>' || w || '</Math>'"), (67, 9, "'$^{1,2,*, }$'"), (71, 10, r"'\$5'"),
)
_CASE = "CASE " + " ".join(f"WHEN (i - 1) % {m} = {r} THEN {e}" for m, r, e in _WORDS) + " ELSE w END"


def _kept(body: str, kind: str) -> str:
    short = rf"regexp_replace({STRIP.format(body)}, '\s+', ' ', 'g')"
    command = rf"regexp_matches({short}, '\\[a-zA-Z]+')"
    solid = f"replace({short}, ' ', '')"
    return rf"""({short} <> '' AND NOT regexp_matches({short}, '^\[\d+(?:\s*[,，\-–]\s*\d+)*\]$') AND NOT regexp_matches({short}, '(?i)^\^\{{?[0-9,\s*\\dagger\\ddagger\\ast†‡]+\}}?$')
  AND NOT ({kind} = 'inline' AND length({short}) < 8) AND ({command} OR NOT (regexp_matches({short}, '[\x{{4e00}}-\x{{9fff}}]') OR (length({short}) > 80 AND length(regexp_replace({solid}, '[^\p{{L}}]', '', 'g'))::DOUBLE / length({solid}) > 0.65)))
  AND ({command} OR regexp_matches({short}, '[=^_+\-*/<>≤≥≈≠∑∫√∞π]')))"""


# Fixed values: (kind, expression, group of the body) of five grammars; the sixth is between single dollars.
GRAMMARS = (
    ("mathml", r"(?i:<math\b.*?</math>)", 0),
    ("environment", rf"\\begin\{{({formulas.ENVIRONMENTS})\}}.*?\\end\{{\3\}}", 0),
    ("display", r"\$\$(.+?)\$\$", 3),
    ("display", r"\\\[(.+?)\\\]", 3),
    ("inline", r"\\\((.+?)\\\)", 3),
)
#: The environment's name is spelt out, as RE2 has no references back.
_ENVIRONMENT = "|".join(rf"\\begin\{{{e}\}}.*?\\end\{{{e}\}}" for x in formulas.ENVIRONMENTS.split("|") for e in ([x.replace(r"\*?", r"\*"), x.replace(r"\*?", "")] if r"\*?" in x else [x]))
_GRAMMARS = [(kind, _ENVIRONMENT if kind == "environment" else e, body) for kind, e, body in GRAMMARS]
_CANDIDATES = " UNION ALL ".join(
    rf"""SELECT doc_id, {g} AS g, '{kind}' AS kind, CAST(sum(length(b) + length(r)) OVER w AS BIGINT) - length(r) AS start, CAST(sum(length(b) + length(r)) OVER w AS BIGINT) AS stop, body FROM (
  SELECT doc_id, unnest(regexp_extract_all(t, '(?s)(.*?)({e})', 1)) AS b, unnest(regexp_extract_all(t, '(?s)(.*?)({e})', 2)) AS r, unnest(regexp_extract_all(t, '(?s)(.*?)({e})', {body or 2})) AS body, unnest(generate_series(1, len(regexp_extract_all(t, '(?s)(.*?)({e})', 1)))) AS k FROM texts)
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)"""
    for g, (kind, e, body) in enumerate(_GRAMMARS)
)


@query(rf"""WITH RECURSIVE texts AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: {_CASE}), ' ') AS t FROM documents),
segments AS (SELECT doc_id, t, string_split(t, '$') AS s FROM texts),
dollars AS (SELECT doc_id, t, s, unnest(range(1, len(s))) AS j FROM segments),
single AS (SELECT doc_id, t, CAST(list_sum(list_transform(s[1:j], lambda x: length(x))) AS BIGINT) + j - 1 AS pos FROM dollars
  WHERE NOT (j > 1 AND s[j] = '') AND right(s[j], 1) <> '\' AND NOT (j < len(s) - 1 AND s[j + 1] = '')),
bodies AS (SELECT doc_id, pos, lead(pos) OVER w AS next, substring(t, pos + 2, lead(pos) OVER w - pos - 1) AS body, row_number() OVER w AS k FROM single WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
open_ AS (SELECT *, coalesce(next IS NOT NULL AND NOT contains(body, chr(10)) AND {_kept("body", "'inline'")}, FALSE) AS good FROM bodies),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, good ORDER BY k) AS run FROM open_),
inline_ AS (SELECT doc_id, 9 AS g, 'inline' AS kind, pos AS start, next + 1 AS stop, body FROM runs WHERE good QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY k) % 2 = 1),
found AS (SELECT * FROM ({_CANDIDATES}) WHERE {_kept("body", "kind")} UNION ALL SELECT * FROM inline_),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, g) AS i FROM found),
taken(doc_id, i, stop) AS (SELECT doc_id, i, stop FROM cand WHERE i = 1
  UNION ALL SELECT c.doc_id, min(c.i), arg_min(c.stop, c.i) FROM taken a JOIN cand c ON c.doc_id = a.doc_id AND c.start >= a.stop GROUP BY c.doc_id),
kept AS (SELECT c.* FROM taken JOIN cand c USING (doc_id, i)),
gaps AS (SELECT *, substring(t, lag(stop) OVER w + 1, start - lag(stop) OVER w) AS gap, lag(kind) OVER w AS before FROM kept JOIN texts USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
groups AS (SELECT *, sum(CASE WHEN kind = 'display' AND before = 'display' AND {STRIP.format("gap")} = '' AND length(gap) - length(replace(gap, chr(10), '')) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS grp FROM gaps)
SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", any_value(kind) AS kind, string_agg({STRIP.format("body")}, chr(10) || chr(10) ORDER BY start) AS latex, CAST(count(*) AS INTEGER) AS formulas FROM groups GROUP BY doc_id, grp""")
def ext05_formulas(spark, sf_dir):
    """Formulas in the documents' texts, some of whose words are made into formulas first."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.expr(r"transform(split(text, ' '), (w, k) -> struct(w, k + 1 as i))").alias("words"))
    word = F.expr(_CASE.replace("\\", "\\\\").replace(" w ", " x.w ").replace("(i - 1)", "(x.i - 1)").replace("|| i ||", "|| x.i ||").replace("ELSE x.w END", "ELSE x.w END").join(["array_join(transform(words, x -> ", "), ' ')"]))
    found = texts.select("doc_id", word.alias("text"))
    return found.select("doc_id", F.explode(formulas.formulas(F.col("text"), references=True, notes=True, group=True)).alias("f")).select("doc_id", "f.*")


# Logical segments: the lines of a document as its layout blocks, 1500 characters a page

_LINES = r"""lines AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
blocks AS (SELECT 'doc-' || doc_id AS source, i * 2 AS ord, doc_id || ':' || i AS block_id, CASE WHEN i % 8 = 0 THEN 'heading' WHEN i % 11 = 3 THEN 'formula' WHEN i % 13 = 6 THEN 'table' ELSE 'text' END AS type,
  line AS text, CAST(off // 1500 + 1 AS INTEGER) AS page, off % 1500 / 1.5 AS y0, least(1000.0, off % 1500 / 1.5 + length(line) / 1.5) AS y1, CASE doc_id % 3 WHEN 1 THEN 'layout' WHEN 2 THEN 'content_list' END AS source_kind FROM lines
  UNION ALL SELECT 'doc-' || doc_id, i * 2 + 1, doc_id || ':m' || i, 'table', 'x', CAST(off // 1500 + 1 AS INTEGER), 0, 1, 'model' FROM lines WHERE i % 4 = 0)"""
_SIGNED = r"regexp_replace(regexp_replace(lower({}), '[\\${{}}_^`*#>\[\]()|]', '', 'g'), '\s+', '', 'g')"


@query(rf"""WITH RECURSIVE {_LINES},
barred AS (SELECT *, sum(CASE WHEN (source_kind IS NOT DISTINCT FROM kind OR kind IS NULL) AND type IN ('heading', 'table') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord) AS barriers
  FROM (SELECT *, first_value(source_kind) OVER (PARTITION BY source ORDER BY ord) AS kind FROM blocks)),
stream AS (SELECT source, ord, block_id, type, page, y0, y1, barriers, {STRIP.format("text")} AS text, CASE WHEN type = 'heading' AND NOT starts_with({STRIP.format("text")}, '#') THEN '# ' ELSE '' END || {STRIP.format("text")} AS md,
  row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM barred
  WHERE type <> 'table' AND {STRIP.format("text")} <> '' AND NOT regexp_matches({STRIP.format("text")}, '^[0-9]{{1,4}}$')),
ends AS (SELECT *, ord = min(CASE WHEN type <> 'heading' THEN ord END) OVER (PARTITION BY source, page) AS first, ord = max(CASE WHEN type <> 'heading' THEN ord END) OVER (PARTITION BY source, page) AS last FROM stream),
pairs AS (SELECT c.source, c.k, {_SIGNED.format("b.text")} AS l, {_SIGNED.format("c.text")} AS r FROM ends c JOIN ends b ON b.source = c.source AND b.k = c.k - 1
  WHERE c.type <> 'heading' AND b.type <> 'heading' AND c.first AND b.last AND c.page = b.page + 1 AND b.y1 >= 850 AND c.y0 <= 200 AND b.barriers = c.barriers),
paras AS (SELECT 'doc-' || doc_id AS source, {_SIGNED.format("p")} AS p FROM (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n+')) AS p FROM documents)),
runs AS (SELECT DISTINCT source, k FROM pairs JOIN paras USING (source) WHERE l <> '' AND r <> '' AND (
  (strpos(p, right(l, 120)) > 0 AND strpos(p, left(r, 120)) >= strpos(p, right(l, 120))) OR (strpos(p, l) > 0 AND strpos(p, r) >= strpos(p, l)))),
kinds AS (SELECT s.source, s.k, s.block_id, s.type, s.page, s.md, r.k IS NOT NULL AS runs_on FROM stream s LEFT JOIN runs r USING (source, k)),
scan(source, k, type, page, size, bodies, segment, merged, headed) AS (
  SELECT source, k, type, page, CASE WHEN type = 'heading' THEN 0 ELSE length(md) END, CASE WHEN type = 'heading' THEN 0 ELSE 1 END, CASE WHEN type = 'heading' THEN 0 ELSE 1 END, FALSE, CASE WHEN type = 'heading' THEN k END FROM kinds WHERE k = 1
  UNION ALL SELECT c.source, c.k, c.type, c.page,
    CASE WHEN c.type = 'heading' THEN 0 WHEN b.size > 0 AND NOT brk THEN b.size + gap + length(c.md) WHEN hsize > 0 AND NOT hbrk THEN hsize + 2 + length(c.md) ELSE length(c.md) END,
    CASE WHEN c.type = 'heading' THEN 0 ELSE 1 END,
    CASE WHEN c.type = 'heading' THEN b.segment WHEN b.size > 0 THEN b.segment + CASE WHEN brk THEN 1 ELSE 0 END ELSE b.segment + 1 + CASE WHEN hsize > 0 AND hbrk THEN 1 ELSE 0 END END,
    CASE WHEN c.type = 'heading' THEN FALSE WHEN b.size > 0 AND NOT brk THEN b.merged OR c.runs_on ELSE FALSE END,
    CASE WHEN c.type <> 'heading' THEN NULL ELSE coalesce(b.headed, c.k) END
  FROM (SELECT b.*, c.md AS next, CASE WHEN c.page <> b.page THEN NOT c.runs_on ELSE b.size + 2 + length(c.md) > 900 END AS brk, CASE WHEN c.page <> b.page THEN 1 ELSE 2 END AS gap,
      CASE WHEN b.type = 'heading' AND c.type = 'text' THEN (SELECT sum(length(h.md) + 2) - 2 FROM kinds h WHERE h.source = b.source AND h.k BETWEEN b.headed AND b.k) ELSE 0 END AS hsize, c.page <> b.page AS hbrk
    FROM scan b JOIN kinds c ON c.source = b.source AND c.k = b.k + 1) b JOIN kinds c ON c.source = b.source AND c.k = b.k + 1),
numbered AS (SELECT s.source, s.k, s.type, s.segment, s.merged FROM scan s),
heads AS (SELECT h.source, h.k, min(n.k) AS body FROM kinds h JOIN kinds n ON n.source = h.source AND n.k > h.k AND n.type <> 'heading' WHERE h.type = 'heading' GROUP BY ALL),
placed AS (SELECT source, k, segment, merged FROM numbered WHERE type <> 'heading'
  UNION ALL SELECT h.source, h.k, n.segment - CASE WHEN c.page <> p.page THEN 1 ELSE 0 END, n.merged AND c.page = p.page FROM heads h JOIN numbered n ON n.source = h.source AND n.k = h.body JOIN kinds c ON c.source = h.source AND c.k = h.body JOIN kinds p ON p.source = h.source AND p.k = h.body - 1 WHERE c.type = 'text'),
joined AS (SELECT source, segment, k, block_id, b.page, b.type, md, merged, lag(b.page) OVER w AS before, lag(b.type) OVER w AS kind FROM placed JOIN kinds b USING (source, k) WINDOW w AS (PARTITION BY source, segment ORDER BY k))
SELECT source, CAST(segment - 1 AS INTEGER) AS segment, string_agg(CASE WHEN before IS NULL THEN '' WHEN before <> page AND kind <> 'heading' AND type <> 'heading' THEN ' ' ELSE chr(10) || chr(10) END || md, '' ORDER BY k) AS text,
  string_agg(block_id, ',' ORDER BY k) AS block_ids, min(page) AS first_page, max(page) AS last_page, bool_or(merged) AS cross_page_merge FROM joined GROUP BY source, segment""")
def chk08_logical_segments(spark, sf_dir):
    segments_of = segments.logical_segments(_line_blocks(spark, sf_dir), _markdown(spark, sf_dir))
    return segments_of.select("source", "segment", "text", F.array_join("block_ids", ",").alias("block_ids"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), "cross_page_merge")


def _markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.col("text").alias("markdown"))


def _numbered(batches):
    """Lines of texts with their number from 1 and the characters before them; a text's lines are in one row, so nothing is shuffled for them."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            parts = pc.split_pattern(batch.column("text"), "\n")
            owner, line = pc.list_parent_indices(parts), pc.list_flatten(parts)
            first = (parts.offsets.to_numpy() - parts.offsets[0].as_py())[:-1][owner.to_numpy()]
            n = pc.utf8_length(line).to_numpy().astype(np.int64) + 1
            before = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), pa.array((np.arange(len(n)) - first + 1).astype(np.int32)), line, pa.array(before - before[first])], names=["doc_id", "i", "line", "off"])


def _line_blocks(spark, sf_dir):
    """The lines as blocks, and a second parser's tables between them."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", "text").mapInArrow(_numbered, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, line string, off long")
    y0 = (F.col("off") % 1500) / 1.5
    i, box = F.col("i"), lambda a, b: F.array(F.lit(100.0), a.cast("double"), F.lit(900.0), b.cast("double"))
    common = [F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.expr("cast(off div 1500 + 1 as int)").alias("page")]
    own = lines.select(
        *common, (i * 2).alias("ord"), F.concat_ws(":", "doc_id", "i").alias("block_id"), F.when(i % 8 == 0, "heading").when(i % 11 == 3, "formula").when(i % 13 == 6, "table").otherwise("text").alias("type"),
        F.col("line").alias("text"), box(y0, F.least(F.lit(1000.0), y0 + F.length("line") / 1.5)).alias("box"), F.when(F.col("doc_id") % 3 == 1, "layout").when(F.col("doc_id") % 3 == 2, "content_list").alias("source_kind"),
    )
    other = lines.where(i % 4 == 0).select(*common, (i * 2 + 1).alias("ord"), F.concat(F.col("doc_id"), F.lit(":m"), F.col("i")).alias("block_id"), F.lit("table").alias("type"), F.lit("x").alias("text"), box(F.lit(0), F.lit(1)).alias("box"), F.lit("model").alias("source_kind"))
    return own.unionByName(other)


@query()
def chk08d_repaired_chunks(spark, sf_dir):
    """Chunks of the documents from a splitter of sentences, moved to whole sentences; tested against plain searches."""
    small = replace(DEFAULTS, split_tokens=120)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", splitting.sentence_parts(F.coalesce("text", F.lit("")), small).alias("chunks"))
    return segments.chunked_rows(docs).select("doc_id", F.posexplode_outer("chunks").alias("chunk", "text")).where("text is not null")


# Alignment of chunks to blocks


@query(rf"""WITH {CHUNKS}, {_LINES},
asked AS (SELECT source, node_id, regexp_replace(text, '\s+', '', 'g') AS a FROM nodes),
held AS (SELECT source, ord, block_id, regexp_replace(text, '\s+', '', 'g') AS b, CASE source_kind WHEN 'content_list' THEN 130 WHEN 'layout' THEN 105 WHEN 'model' THEN 80 ELSE 10 END AS priority FROM blocks),
pairs AS (SELECT source, node_id, block_id, ord, priority, CASE WHEN contains(b, a) OR contains(a, b) THEN least(length(a), length(b)) WHEN length(a) >= 40 AND contains(b, left(a, 40)) THEN 40 WHEN length(b) >= 40 AND contains(a, left(b, 40)) THEN 40 END AS score
  FROM asked JOIN held USING (source) WHERE b <> '')
SELECT source, node_id AS text_id, block_id, CAST(score AS INTEGER) AS score FROM pairs WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, node_id ORDER BY score DESC, priority DESC, ord) = 1""")
def ext11_alignment(spark, sf_dir):
    nodes = Corpus(spark, sf_dir).nodes
    return alignment.best_blocks(nodes.select("source", F.col("node_id").alias("text_id"), "text"), _line_blocks(spark, sf_dir))


# Tables that a document has several times: lines of an order as its tables

_TABLES = """n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i, l_returnflag AS f, l_linestatus AS s, l_quantity AS q, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem),
x AS (SELECT *, f || '/' || s || CASE WHEN q < 3 THEN '/x' ELSE '' END AS cells, q > 5 AS tabular, CASE WHEN t % 3 > 0 THEN t % 3 END AS page, t % 2 = 0 AS laid, CASE WHEN q > 45 THEN 2 END AS n FROM n)"""


def _order_tables(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumns({"i": F.row_number().over(order), "t": F.round(F.col("l_tax") * 100).cast("int"), "q": F.col("l_quantity")})
    line = F.concat(F.lit("| "), F.col("l_returnflag"), F.when(F.col("t") > 4, "  | ").otherwise(" |"), F.col("l_linestatus"), F.when(F.col("q") < 3, " | x |").otherwise(" |"))
    text = F.concat(F.when(F.col("t") % 2 == 0, "|---|:-:|\n").otherwise(""), line)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("source"), F.col("l_orderkey").alias("doc_id"), F.concat_ws(":", "l_orderkey", "i").alias("node_id"), F.col("i").alias("chunk_index"), F.when(F.col("q") > 5, "table").otherwise("text").alias("modality"),
        text.alias("text"), F.when(F.col("t") % 3 > 0, F.col("t") % 3).alias("page"), F.lit(None).cast("string").alias("section"), F.when(F.col("t") % 2 == 0, "structured").alias("page_source"), F.lit(None).cast("string").alias("source_kind"),
        F.lit(None).cast("string").alias("raw_type"), F.when(F.col("q") > 45, 2).alias("structured_duplicates"), F.col("q"), F.col("i").alias("ord"),
    )


@query(f"""WITH {_TABLES},
g AS (SELECT doc_id, CASE WHEN tabular THEN cells ELSE '#' || i END AS key, list(i ORDER BY i) AS ids, arg_max(i, (page IS NOT NULL, laid, coalesce(n, 0), -i)) AS best, max(n) AS n FROM x GROUP BY ALL)
SELECT doc_id, doc_id || ':' || best AS node_id, CAST(len(ids) AS INTEGER) AS duplicates, array_to_string(list_transform(list_filter(ids, lambda i: i <> best), lambda i: doc_id || ':' || i), ',') AS merged_ids, CAST(n AS INTEGER) AS structured_duplicates FROM g""")
def ext08_table_nodes(spark, sf_dir):
    got = table_merge.coalesced_nodes(_order_tables(spark, sf_dir))
    in_order = F.array_join(F.transform(F.array_sort(F.transform("occurrences", lambda o: F.struct(o["chunk_index"].alias("i"), o["node_id"].alias("n")))), lambda o: o["n"]), ",")
    return got.select("doc_id", "node_id", "duplicates", in_order.alias("merged_ids"), "structured_duplicates")


@query()
def ext07_table_blocks(spark, sf_dir):
    """The same tables as blocks of two parsers with boxes; tests/test_table_merge.py compares with a walk."""
    x = (F.col("q") % 4 * 100).cast("double")
    box = F.when(F.col("q") % 3 > 0, F.array(x, x, x + 90, x + 40 + F.col("q") % 2))
    blocks = _order_tables(spark, sf_dir).withColumns({"block_id": F.col("node_id"), "box": box, "source_kind": F.when(F.col("q") % 5 > 1, "layout").otherwise("model"), "raw_type": F.when(F.col("q") > 48, "chart").otherwise("table")})
    return table_merge.coalesced_blocks(blocks.drop("structured_duplicates")).withColumn("merged_ids", F.array_join("merged_ids", ","))


@query()
def ext12_image_units(spark, sf_dir):
    """Lines of the documents as images, captions and descriptions; tests/test_image_units.py has cases by hand."""
    i = F.expr("int(split(block_id, ':')[1])")
    blocks = _line_blocks(spark, sf_dir).where("source_kind is null or source_kind <> 'model'").withColumn("i", i)
    kind = F.when(F.col("i") % 6 == 2, "image").when(F.col("i") % 6 == 3, "image_caption").when(F.col("i") % 11 == 4, "image_caption").when(F.col("i") % 13 == 5, "image_semantic").otherwise(F.col("type"))
    text = F.when(kind == "image_caption", F.concat(F.lit("Figure "), (F.col("i") % 5).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    path = F.when(F.col("i") % 6 == 2, F.concat(F.lit("images/"), (F.col("i") % 4).cast("string"), F.lit(".png")))
    lists = ("caption_ids", "semantic_ids", "image_ids")
    return image_units.image_units(blocks.withColumns({"text": text, "type": kind, "image_path": path})).withColumns({c: F.array_join(c, ",") for c in lists})
