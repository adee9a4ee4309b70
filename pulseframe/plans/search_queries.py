"""Text, index and search queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import search as S
from ..session import pinned, spread
from . import bindings as B
from .registry import Registry

R = Registry()

SRC_SQL = "'docs/' || source || '/Camada-0' || (doc_id % 9) || '_v' || (doc_id % 3) || '.' || (doc_id % 10) || CASE WHEN doc_id % 11 = 0 THEN '.dat' ELSE '.md' END"


def docs(spark, sf):
    i = F.col("doc_id")
    path = F.concat(F.lit("docs/"), "source", F.lit("/Camada-0"), (i % 9).cast("string"), F.lit("_v"), (i % 3).cast("string"), F.lit("."), (i % 10).cast("string"),
                    F.when(i % 11 == 0, ".dat").otherwise(".md"))
    return spread(B.table(spark, sf, "documents").select("doc_id", path.alias("path"), "text", "source"))


def _like_any(keys) -> str:
    return " OR ".join("contains(lower(text), '" + k.lower() + "')" for k in keys)


@R.add("p10_p11_paths", f"""WITH d AS (SELECT doc_id, {SRC_SQL} AS path FROM documents)
SELECT doc_id, path LIKE '%.dat' AS forbidden, 'C0' || (doc_id % 9) AS layer, 'v' || (doc_id % 3) || '.' || (doc_id % 10) AS version FROM d WHERE doc_id % 9 <> 0
UNION ALL SELECT doc_id, path LIKE '%.dat', 'GENERAL', 'v' || (doc_id % 3) || '.' || (doc_id % 10) FROM d WHERE doc_id % 9 = 0""")
def p10(spark, sf):
    p = F.col("path")
    return docs(spark, sf).select("doc_id", TX.is_forbidden(p).alias("forbidden"), TX.layer(p).alias("layer"), TX.version(p).alias("version"))


@R.add("p12_tags", "SELECT doc_id, list_aggregate(list_filter([" + ", ".join(f"CASE WHEN {_like_any(TX.TAG_KEYWORDS[t])} THEN '{t}' END" for t in sorted(TX.TAG_KEYWORDS)) + "], lambda x: x IS NOT NULL), 'string_agg', ',') AS tags FROM documents")
def p12(spark, sf):
    t = TX.tags(F.col("text"))
    return B.table(spark, sf, "documents").select("doc_id", F.when(F.size(t) > 0, F.array_join(t, ",")).alias("tags"))


PII_SQL = "list_concat(" * 3 + f"regexp_extract_all(text, '{TX.PII_PATTERNS[0]}')" + "".join(f", regexp_extract_all(text, '{p}'))" for p in TX.PII_PATTERNS[1:])


@R.add("p13_personal_data", f"SELECT doc_id, CAST(len({PII_SQL}) AS INTEGER) AS n_matches, array_to_string({PII_SQL}, ';') AS matches FROM documents WHERE len({PII_SQL}) > 0")
def p13(spark, sf):
    x = B.table(spark, sf, "documents").select("doc_id", TX.pii(F.col("text")).alias("m")).filter(F.size("m") > 0)
    return x.select("doc_id", F.size("m").alias("n_matches"), F.array_join("m", ";").alias("matches"))


@R.add("p14_front_matter", """SELECT doc_id, 'doc ' || doc_id AS title, lang AS lang, CAST(2 AS INTEGER) AS n_keys FROM documents""")
def p14(spark, sf):
    t = F.concat(F.lit("---\ntitle: doc "), F.col("doc_id"), F.lit("\nlang: "), F.col("lang"), F.lit("\n---\n"), F.col("text"))
    x = B.table(spark, sf, "documents").select("doc_id", TX.front_matter(t).alias("m"))
    return x.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["lang"].alias("lang"), F.size("m").alias("n_keys"))


@R.add("p15_metadata", """SELECT doc_id, 'e' || (doc_id % 17) AS experiment_id, 'stage' || (doc_id % 2 + 1) AS stage, CASE WHEN doc_id % 2 = 0 THEN source || ';x' ELSE '' END AS tags FROM documents""")
def p15(spark, sf):
    i = F.col("doc_id")
    t = F.concat(F.col("text"), F.lit("\n- **experiment_id:** e"), (i % 17).cast("string"), F.lit("\n- **tags:** "), F.when(i % 2 == 0, F.concat("source", F.lit(", x"))).otherwise(""), F.lit("\n"))
    m = TX.metadata(F.concat(F.lit("data/stage"), (i % 2 + 1).cast("string"), F.lit("_2026.md")), t)
    x = B.table(spark, sf, "documents").select("doc_id", m.alias("m"))
    return x.select("doc_id", "m.experiment_id", "m.stage", F.array_join("m.tags", ";").alias("tags"))


def pieces_sql(text: str, size: int) -> str:
    """A list of pieces of at most `size` characters."""
    got = f"[{text}]"
    for sep in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
        split = f"list_filter(list_transform(string_split(a, {sep}), lambda p, i: CASE WHEN i < len(string_split(a, {sep})) THEN p || {sep} ELSE p END), lambda p: p <> '')"
        got = f"flatten(list_transform({got}, lambda a: CASE WHEN length(a) <= {size} THEN [a] ELSE {split} END))"
    cut = f"list_transform(range(CAST((length(a) - 1) // {size} + 1 AS BIGINT)), lambda i: substring(a, CAST(i * {size} + 1 AS BIGINT), {size}))"
    return f"flatten(list_transform({got}, lambda a: CASE WHEN length(a) <= {size} THEN [a] ELSE {cut} END))"


BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def chunks_sql(text: str, size: int = 512, overlap: int = 64) -> str:
    """The pieces merged into chunks that begin with the last words of the one before."""
    room, full = f"least({overlap}, {size} - length(a.c))", f"s.c <> '' AND length(s.c) + length(a.c) > {size}"
    tail = (f"CASE WHEN {room} <= 0 THEN '' WHEN length(s.c) <= {room} OR contains({BLANK}, substring(s.c, CAST(length(s.c) - {room} AS BIGINT), 1)) THEN right(s.c, CAST({room} AS BIGINT)) "
            f"ELSE regexp_replace(right(s.c, CAST({room} AS BIGINT)), '^[^ \\t\\n\\r]+', '') END")
    merged = (f"list_reduce(list_transform({pieces_sql(text, size)}, lambda a: {{'o': []::VARCHAR[], 'c': a}}), lambda s, a: CASE WHEN {full} THEN {{'o': list_append(s.o, s.c), 'c': {tail} || a.c}} "
              f"ELSE {{'o': s.o, 'c': s.c || a.c}} END, {{'o': []::VARCHAR[], 'c': ''}})")
    return f"list_filter(list_transform(list_transform([{merged}], lambda s: list_append(s.o, s.c))[1], lambda c: trim(c, {BLANK})), lambda c: c <> '')"


def chunk_sql(src: str, whole: str, text: str = "text") -> str:
    """CTE `ch`: rows of `src` with part, n_parts and content."""
    return f"""cs AS MATERIALIZED (SELECT *, CASE WHEN length({text}) <= {whole} THEN list_filter([trim({text}, {BLANK})], lambda c: c <> '') ELSE {chunks_sql(text)} END AS l FROM {src}),
 ch AS (SELECT * EXCLUDE (l), unnest(range(len(l))) AS part, len(l) AS n_parts, unnest(l) AS content FROM cs)"""


@R.add("p16_chunks", f"WITH {chunk_sql('documents', '0')} SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(length(content) AS INTEGER) AS n, md5(content) AS digest FROM ch")
def p16(spark, sf):
    return TX.chunk(spread(B.table(spark, sf, "documents").select("doc_id", "text")), "text").select("doc_id", "part", F.length("content").alias("n"), F.md5("content").alias("digest"))


@R.add("p17_html_strip", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS INTEGER) AS n, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def p17(spark, sf):
    t = TX.strip_html(F.col("html"))
    return B.table(spark, sf, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


@R.add("p18_clean_query", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS query FROM conversations")
def p18(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", TX.clean_query(F.col("text")).alias("query"))


MD_SQL = r"""md AS (SELECT page_id, regexp_replace(regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g'), '<[^>]*>', '', 'g') AS text FROM pages)"""


def _markdown(spark, sf):
    t = TX.strip_html(F.regexp_replace("html", "<h[1-6][^>]*>", "\n# "))
    return B.table(spark, sf, "pages").select("page_id", t.alias("text"))


@R.add("s10_markdown_sections", f"""WITH {MD_SQL}, p AS (SELECT page_id, unnest(range(0, len(string_split(text, chr(10) || '# ')))) AS section, unnest(string_split(text, chr(10) || '# ')) AS p FROM md),
 h AS (SELECT *, section > 0 OR starts_with(ltrim(p, ' '), '#') AS headed FROM p)
SELECT page_id, CAST(section AS INTEGER) AS section, CASE WHEN headed THEN trim(regexp_replace(string_split(p, chr(10))[1], '^[# ]+', ''), ' ') END AS header_1,
 md5(CASE WHEN headed THEN CASE WHEN contains(p, chr(10)) THEN regexp_replace(p, '^[^\\n]*\\n', '') ELSE '' END ELSE p END) AS digest FROM h""")
def s10(spark, sf):
    return TX.split_markdown(_markdown(spark, sf), "text").select("page_id", "section", "header_1", F.md5("body").alias("digest"))


@R.add("s11_part_headers", f"WITH {chunk_sql('documents', '1024')} SELECT doc_id, CAST(part AS INTEGER) AS part, CASE WHEN n_parts > 1 THEN 'parte_' || (part + 1) END AS header_2 FROM ch")
def s11(spark, sf):
    x = TX.chunk(spread(B.table(spark, sf, "documents").select("doc_id", "text")), "text", keep_whole=TX.MAX_CHUNK_CHARS)
    return x.select("doc_id", "part", TX.part_header(F.col("part"), F.col("n_parts")).alias("header_2"))


# The corpus of the index: every 7th document is the summary of an experiment, every 13th is code, the first word of a line heads a section in every other one of the rest.
KIND_SQL = "CASE WHEN doc_id % 7 = 3 THEN 's' WHEN doc_id % 13 = 5 THEN 'c' WHEN doc_id % 2 = 0 THEN 'm' ELSE 'p' END"
CORPUS_SQL = rf"""src AS (SELECT doc_id, {KIND_SQL} AS k, CASE k WHEN 's' THEN 'data/lineage/experiments/stage' || (doc_id % 2 + 1) || '_' || doc_id || '.md' WHEN 'c' THEN 'src/' || source || '/m' || doc_id || '.py' ELSE {SRC_SQL} END AS path,
  CASE k WHEN 's' THEN '# Run ' || doc_id || chr(10) || '- **experiment_id:** e' || (doc_id % 17) || chr(10) || '- **tags:** ' || source || ', x' || chr(10) || text
    WHEN 'm' THEN regexp_replace(text, '\n([^ \n]+) ', chr(10) || '# \1' || chr(10), 'g') ELSE text END AS text FROM documents),
 sec AS (SELECT doc_id, k, path, unnest(range(len(string_split(text, chr(10) || '# ')))) AS section, unnest(string_split(text, chr(10) || '# ')) AS p, true AS md FROM src WHERE k IN ('m', 'p') AND NOT path LIKE '%.dat'
  UNION ALL SELECT doc_id, k, path, 0, text, false FROM src WHERE k IN ('s', 'c')),
 hd AS (SELECT *, md AND (section > 0 OR starts_with(ltrim(p, ' '), '#')) AS headed FROM sec),
 bodies AS (SELECT doc_id, k, path, section, CASE WHEN headed OR (k = 's' AND starts_with(p, '# ')) THEN trim(regexp_replace(string_split(p, chr(10))[1], '^[# ]+', ''), ' ') END AS header_1,
  CASE WHEN headed THEN CASE WHEN contains(p, chr(10)) THEN substring(p, instr(p, chr(10)) + 1) ELSE '' END ELSE p END AS text FROM hd)"""


def corpus(spark, sf):
    i, t = F.col("doc_id"), F.col("text")
    kind = F.when(i % 7 == 3, "s").when(i % 13 == 5, "c").when(i % 2 == 0, "m").otherwise("p")
    path = F.when(kind == "s", F.concat(F.lit("data/lineage/experiments/stage"), (i % 2 + 1).cast("string"), F.lit("_"), i.cast("string"), F.lit(".md")))
    path = path.when(kind == "c", F.concat(F.lit("src/"), "source", F.lit("/m"), i.cast("string"), F.lit(".py"))).otherwise(F.col("path"))
    bullets = F.concat(F.lit("# Run "), i, F.lit("\n- **experiment_id:** e"), (i % 17).cast("string"), F.lit("\n- **tags:** "), "source", F.lit(", x\n"), t)
    text = F.when(kind == "s", bullets).when(kind == "m", F.regexp_replace(t, "\n([^ \n]+) ", "\n# $1\n")).otherwise(t)
    return docs(spark, sf).select("doc_id", path.alias("path"), text.alias("text"))


def _index(spark, sf):
    return S.build_index(corpus(spark, sf), "path", "text", ["doc_id"])


INDEX_SQL = f"""WITH {CORPUS_SQL}, {chunk_sql('bodies', "(CASE WHEN k = 'c' THEN 0 ELSE 1024 END)")},
 c AS (SELECT *, substr(sha256(path || ':' || content), 1, 16) AS chunk_id, {PII_SQL.replace('text', 'content')} AS m, CASE WHEN k = 's' AND n_parts > 1 THEN 'parte_' || (part + 1) END AS header_2,
  CASE WHEN k = 's' THEN 'SIMULATION' WHEN k = 'c' OR doc_id % 9 = 0 THEN 'GENERAL' ELSE 'C0' || (doc_id % 9) END AS layer, CASE WHEN k IN ('s', 'c') THEN 'unversioned' ELSE 'v' || (doc_id % 3) || '.' || (doc_id % 10) END AS version FROM ch),
 r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, section, part) AS rn FROM c WHERE len(m) = 0)"""
# A summary is tagged from the pieces that hold the bullets; the others know their stage only.
SUMMARY_TAGS_SQL = r"array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(string_split(regexp_extract(content, '- \*\*tags:\*\*([^\n]*)', 1), ','), lambda t: trim(t)), lambda t: t <> ''), ['experimento', 'stage' || (doc_id % 2 + 1)]))), ',')"
TAGS_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_like_any(TX.TAG_KEYWORDS[t]).replace('text', 'content')} THEN '{t}' END" for t in sorted(TX.TAG_KEYWORDS)) + "], lambda x: x IS NOT NULL), ',')"


@R.add("x1_index", f"""{INDEX_SQL} SELECT chunk_id, path AS source, layer, version, CASE WHEN k = 's' THEN {SUMMARY_TAGS_SQL} ELSE {TAGS_SQL} END AS tags, doc_id, CAST(section AS INTEGER) AS section, CAST(part AS INTEGER) AS part, header_1, header_2, md5(content) AS digest FROM r WHERE rn = 1""")
def x1(spark, sf):
    return _index(spark, sf)[0].select("chunk_id", "source", "layer", "version", F.array_join("tags", ",").alias("tags"), "doc_id", "section", "part", "header_1", "header_2", F.md5("content").alias("digest"))


@R.add("x1_rejects_u2", f"""{INDEX_SQL} SELECT 'PII_DETECTED' AS reason, path AS source, chunk_id, CAST(len(m) AS INTEGER) AS n_matches FROM c WHERE len(m) > 0 UNION ALL SELECT 'DUPLICATE_CHUNK_ID', path, chunk_id, 0 FROM r WHERE rn > 1""")
def x1r(spark, sf):
    return _index(spark, sf)[1]


@R.add("a44_index_lineage", f"""{INDEX_SQL} SELECT count(DISTINCT path) AS n_files, count(*) AS n_chunks, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM r WHERE rn = 1""")
def a44(spark, sf):
    return S.index_lineage(_index(spark, sf)[0])


@R.add("q14_index_checks", f"""{INDEX_SQL} SELECT 'NOT_EMPTY' AS code, true AS passed, count(*) AS count FROM r WHERE rn = 1 UNION ALL SELECT 'LAYERS_PRESENT', true, count(DISTINCT layer) FROM r WHERE rn = 1""")
def q14(spark, sf):
    return S.index_checks(_index(spark, sf)[0])


# Documents repeat passages of the benchmark items, which act as queries.
BM_SQL = r"""WITH tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS term FROM documents),
 ix AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM ix GROUP BY 1), ln AS (SELECT id, sum(tf) AS len FROM ix GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS al FROM ln),
 q AS (SELECT qid, term, count(*) AS qf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: t <> '')) AS term FROM benchmark) GROUP BY ALL),
 nq AS (SELECT qid, count(*) AS nt FROM q GROUP BY 1),
 s AS (SELECT q.qid, ix.id, count(*) AS m, sum(qf * greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM q JOIN ix USING (term) JOIN dfs USING (term) JOIN ln ON ln.id = ix.id CROSS JOIN st GROUP BY ALL),
 bm AS (SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s JOIN nq USING (qid) WHERE m = nt QUALIFY rank <= 10)"""


def _bm(spark, sf, stemmed=False, k=10):
    ix = pinned(S.postings(spread(B.table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", stemmed))  # the index is a stored table
    return S.bm25(ix, B.table(spark, sf, "benchmark"), "item_id", "text", k, stemmed)


@R.add("x2_bm25", f"{BM_SQL} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm")
def x2(spark, sf):
    return _bm(spark, sf).withColumn("score", F.round("score", 6))


@R.add("x2_bm25_stemmed")
def x2s(spark, sf):
    return _bm(spark, sf, True).withColumn("score", F.round("score", 6))


KNN_SQL = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
 s AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS ql, b.label AS l, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a CROSS JOIN e b {where}),
 k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def _emb(spark, sf):
    return B.table(spark, sf, "embeddings").withColumn("tags", F.when(F.col("label") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array(F.lit("odd"), F.lit("x"))))


@R.add("j10_x3_vector_knn", KNN_SQL.format(where="", k=10) + " SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k")
def j10(spark, sf):
    e = _emb(spark, sf)
    return S.knn(e, e, 10, "vec_id", "embedding", "vec_id").withColumn("score", F.round("score", 6))


@R.add("w12_tagged_knn", KNN_SQL.format(where="WHERE b.label < 7", k=20) + ", f AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r2 FROM k WHERE l % 2 = 0 QUALIFY r2 <= 5) SELECT qid, id, round(score, 6) AS score, CAST(r2 AS INTEGER) AS rank FROM f")
def w12(spark, sf):
    e = _emb(spark, sf)
    h = S.knn(e, e, 20, "vec_id", "embedding", "vec_id", where=F.col("label") < 7)
    return S.filter_tags(h, e, ["even", "x"], 5, "vec_id").select("qid", "id", F.round("score", 6).alias("score"), "rank")


@R.add("t6_source_chunks", KNN_SQL.format(where="WHERE b.label = 3", k=5) + " SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k")
def t6(spark, sf):
    e = _emb(spark, sf)
    h = S.knn(e, e, 5, "vec_id", "embedding", "vec_id", where=F.col("label") == 3)
    return h.withColumn("score", F.round("score", 6))


HYB_SQL = BM_SQL.replace("rank <= 10", "rank <= 40") + """, dv AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), qv AS (SELECT item_id AS qid, v FROM benchmark JOIN dv ON dv.id = item_id),
 vs AS (SELECT qid, dv.id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(qv.v, dv.v), 9) DESC, dv.id) AS rank FROM qv CROSS JOIN dv QUALIFY rank <= 40),
 fu AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT qid, id, rank FROM bm UNION ALL SELECT qid, id, rank FROM vs) GROUP BY ALL),
 fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= 20),
 hy AS (SELECT fr.qid, fr.id, fr.score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fr.id) AS r2 FROM fr JOIN documents d ON d.doc_id = fr.id WHERE d.lang = 'en' QUALIFY r2 <= 5)"""


def _hybrid(spark, sf):
    d = B.table(spark, sf, "documents")
    e = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = B.table(spark, sf, "benchmark").join(e, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("qid"), "embedding")
    v = S.knn(e, q, 5 * S.LIST_DEPTH)
    return v, S.hybrid(v, _bm(spark, sf, k=5 * S.LIST_DEPTH), d, 5, F.col("lang") == "en", "doc_id")


@R.add("j11_x4_hybrid_search", f"{HYB_SQL} SELECT qid, id, round(score, 9) AS score, CAST(r2 AS INTEGER) AS rank FROM hy")
def j11(spark, sf):
    return _hybrid(spark, sf)[1].withColumn("score", F.round("score", 9))


@R.add("x5_context_block", f"""{HYB_SQL} SELECT qid, string_agg('[' || r2 || '] Fonte: ' || d.source || ' | Camada: GENERAL | Versão: unversioned | Tags: ' || d.lang || ', doc' || chr(10) || d.text || chr(10), chr(10) || '---' || chr(10) ORDER BY r2) AS context
 FROM hy JOIN documents d ON d.doc_id = hy.id GROUP BY 1""")
def x5(spark, sf):
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("GENERAL").alias("layer"), F.lit("unversioned").alias("version"),
                                               F.array(F.col("lang"), F.lit("doc")).alias("tags"), F.col("text").alias("content"))
    hits = pinned(_hybrid(spark, sf)[1])  # five per query; the texts stay where they are
    return S.context_block((F.broadcast(hits) if hits.count() <= S.BROADCAST_TERMS else hits).join(d, "id"))


@R.add("a42_retrieval_quality", KNN_SQL.format(where="WHERE a.vec_id <> b.vec_id", k=5) + """, p AS (SELECT qid, min(CASE WHEN l = ql THEN rank END) AS f, count(*) FILTER (l = ql) AS h, count(*) AS n FROM k GROUP BY 1), x AS (SELECT a.vec_id AS qid, (SELECT count(*) FROM e b WHERE b.label = a.label) - 1 AS ne FROM e a)
SELECT round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, round(avg(h::DOUBLE / n), 6) AS precision, round(avg(CASE WHEN ne > 0 THEN h::DOUBLE / ne END), 6) AS recall, count(*) AS n_queries FROM x LEFT JOIN p USING (qid)""")
def a42(spark, sf):
    e = _emb(spark, sf)
    lab = e.select(F.col("vec_id").alias("id"), F.col("label").alias("l"))
    h = S.knn(e, e, 6, "vec_id", "embedding", "vec_id").filter("qid <> id").drop("rank")
    h = S.top_k(h, ["qid"], [F.desc("score"), F.col("id")], 5, "id").join(lab, "id").join(lab.select(F.col("id").alias("qid"), F.col("l").alias("ql")), "qid")
    n = e.groupBy("label").agg((F.count("*") - 1).alias("n_expected"))
    exp = e.join(n, "label").select(F.col("vec_id").alias("qid"), "n_expected")
    x = S.retrieval_quality(h, F.col("l") == F.col("ql"), exp)
    return x.withColumns({c: F.round(c, 6) for c in ("mrr", "precision", "recall")})


@R.add("a42_token_overlap", r"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s.,]', ' ', 'g'), '\s+'), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')), lambda x: x <> '')) AS k FROM conversations),
 x AS (SELECT len(a.k) AS nt, len(b.k) AS nc, len(list_intersect(a.k, b.k)) AS ni FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE len(a.k) > 0 AND len(b.k) > 0)
SELECT round(avg(ni::DOUBLE / nc), 6) AS context_precision, round(avg(ni::DOUBLE / nt), 6) AS context_recall, count(*) AS n, (avg(ni::DOUBLE / nc) >= 0.8 AND avg(ni::DOUBLE / nt) >= 0.85) AS passed FROM x""")
def a42t(spark, sf):
    c = B.table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    x = S.token_overlap(c.join(nxt, ["conv_id", "turn"]), "text", "context")
    return x.withColumns({k: F.round(k, 6) for k in ("context_precision", "context_recall")})
