"""Document index, keyword, vector and fused search, retrieval quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from ..session import pinned
from .neighbours import nearest_rows
from .ordering import top_k

# ---- index ------------------------------------------------------------------------------


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """First row per key and the remaining ones, without collecting the copies of a key."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_f"))
    x = df.join(first, key).withColumn("_own", F.struct(*order))
    return x.filter("_own = _f").drop("_f", "_own"), x.filter("_own <> _f").drop("_f", "_own")


def build_index(
    docs: DataFrame, source: str, text: str, order: Sequence[str], embed: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chunks with ids, layer, version, tags and headers; and the rejects with their reason.

    `docs` holds whole texts. Summaries of experiments form a layer of their own, tagged from their metadata, and
    their pieces are numbered in `header_2`. `embed` is a user function (for instance a pandas_udf) of the
    content column.
    """
    allowed = docs.filter(~TX.is_forbidden(F.col(source)))
    parts = TX.chunk(TX.documents(allowed, source, text), "body", keep_whole=F.col("keep_whole"))
    x = parts.withColumn("matches", TX.pii(F.col("content")))
    name = F.regexp_extract(F.col(source), r"([^/]*)$", 1)
    meta = TX.metadata(F.col(source), F.col("content"))
    own = F.array_sort(F.array_distinct(F.array_compact(F.concat(meta["tags"], F.array(F.lit("experimento"), meta["stage"])))))
    x = x.withColumn("header_2", F.when(F.col("is_summary"), TX.part_header(F.col("part"), F.col("n_parts"))))
    clean = x.filter(F.size("matches") == 0).select(
        TX.chunk_id(F.col(source), F.col("content")).alias("chunk_id"), F.col(source).alias("source"), F.when(F.col("is_summary"), "SIMULATION").otherwise(TX.layer(name)).alias("layer"),
        TX.version(name).alias("version"), F.when(F.col("is_summary"), own).otherwise(TX.tags(F.col("content"))).alias("tags"), *[c for c in order if c != source],
        "section", "part", "header_1", "header_2", "content")
    # equal ids mean equal source and content, so one aggregate gives the first row and the
    # number of copies; copies are combined on the map side and never meet in one list
    first = [*[c for c in order if c in clean.columns], "section", "part"]
    cols = [*first, *[c for c in clean.columns if c not in (*first, "chunk_id")]]
    g = clean.groupBy("chunk_id").agg(F.min(F.struct(*cols)).alias("_f"), F.count("*").alias("_n"))
    kept = g.select("chunk_id", "_f.*").select(*clean.columns)
    if embed is not None:
        kept = kept.withColumn("embedding", embed(F.col("content")))
    # texts are chunked once for both reasons: equal ids hold equally many matches, so a count tells how many rows to give
    r = x.select(F.col(source).alias("source"), TX.chunk_id(F.col(source), F.col("content")).alias("chunk_id"), F.size("matches").alias("n_matches"))
    r = r.groupBy("chunk_id", "source", "n_matches").agg(F.count("*").alias("_n"))
    r = r.withColumn("_n", F.when(F.col("n_matches") > 0, F.col("_n")).otherwise(F.col("_n") - 1)).filter("_n > 0")
    reason = F.when(F.col("n_matches") > 0, "PII_DETECTED").otherwise("DUPLICATE_CHUNK_ID")
    rejects = r.select(reason.alias("reason"), "source", "chunk_id", "n_matches", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_c")).drop("_c")
    return kept, rejects


def index_lineage(chunks: DataFrame) -> DataFrame:
    """Files, chunks, layers and versions of an index."""
    return chunks.agg(
        F.countDistinct("source").alias("n_files"), F.count("*").alias("n_chunks"),
        F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"),
        F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))


# ---- keyword search ---------------------------------------------------------------------

# Words of queries are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame, id_: str, text: str, stemmed: bool = False) -> DataFrame:
    """Inverted index: (id, term, tf). Texts are dealt by id, so that their words, which take more room, are counted where they are."""
    t = docs.select(F.col(id_).alias("id"), F.col(text).alias("_t")).repartition("id").select("id", F.explode(TX.words(F.col("_t"))).alias("term"))
    n = t.groupBy("id", "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return n
    return n.withColumn("term", TX.stem("term")).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, qid: str, text: str, n: int, stemmed: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 top n per query; a document must hold every term of the query.

    Only postings of words in queries are joined; the rest of the index counts for lengths alone. Candidates come from
    the rarest term of each query only; the other terms are looked up by (id, term), so common words never expand to
    their full posting lists.
    """
    q = queries.select(F.col(qid).alias("qid"), F.explode(TX.words(F.col(text))).alias("term"))
    if stemmed:
        q = q.withColumn("term", TX.stem("term"))
    q = pinned(q.groupBy("qid", "term").agg(F.count("*").alias("qf")))
    asked = q.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    length = index.groupBy("id").agg(F.sum("tf").alias("len"))
    index = pinned(index.join(asked, "term", "left_semi"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    stats = length.agg(F.count("*").alias("N"), F.avg("len").alias("avg_len"))
    qt = q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = qt.groupBy("qid").agg(F.min(F.struct("df", "term")).alias("m"), F.count("*").alias("n_terms")).filter("m.df > 0")
    cand = rare.select("qid", "n_terms", F.col("m.term").alias("term")).join(index.select("id", "term"), "term").drop("term")
    hits = cand.join(qt, "qid").join(index, ["id", "term"]).join(length, "id").join(F.broadcast(stats))  # stats is one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg_len")))
    s = hits.groupBy("qid", "id").agg(F.sum(part).alias("score"), F.count("*").alias("_m"), F.max("n_terms").alias("_n")).filter("_m = _n")
    return top_k(s.select("qid", "id", F.round("score", 9).alias("score")), ["qid"], [F.desc("score"), F.col("id")], n, "id")


# ---- vector search ----------------------------------------------------------------------

# Vectors in one block; a task holds a block of queries and one block of rows at a time.
QUERY_BLOCK, CHUNK_BLOCK = 16384, 8192


def knn(chunks: DataFrame, queries: DataFrame, fetch_k: int, id_: str = "id", vec: str = "embedding", qid: str = "qid", qvec: str = "embedding", where: Column | None = None) -> DataFrame:
    """Cosine top `fetch_k` chunks per query, ties by id."""
    src = (chunks if where is None else chunks.filter(where)).select(F.col(id_).alias("id"), F.col(vec).alias("v"))
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("v"))
    return top_k(nearest_rows(q, src, fetch_k, (QUERY_BLOCK, CHUNK_BLOCK)), ["qid"], [F.desc("score"), F.col("id")], fetch_k, "id")


def filter_tags(hits: DataFrame, chunks: DataFrame, tags: Sequence[str], k: int, id_: str = "id") -> DataFrame:
    """Keep hits that carry all tags, then the first k, ranked from 1."""
    meta = chunks.select(F.col(id_).alias("id"), "tags")
    need = F.size(F.array_intersect("tags", F.array(*[F.lit(t) for t in tags]))) == len(tags) if tags else F.lit(True)
    x = hits.drop("rank").join(meta, "id").filter(need).drop("tags")
    return top_k(x, ["qid"], [F.desc("score"), F.col("id")], k, "id")


def fuse(lists: Sequence[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of any ranked lists (qid, id, rank)."""
    u = None
    for x in lists:
        r = x.select("qid", "id", (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("w"))
        u = r if u is None else u.unionByName(r)
    s = u.groupBy("qid", "id").agg(F.round(F.sum("w"), 12).alias("score"))
    return top_k(s, ["qid"], [F.desc("score"), F.col("id")], k, "id")


LIST_DEPTH = 8  # each list is this many times k deep before fusion


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, chunks: DataFrame, k: int, where: Column | None = None, id_: str = "id") -> DataFrame:
    """Fuse to 4k, drop hits that fail the metadata predicate, cut to k. The lists should be LIST_DEPTH * k deep."""
    x = fuse([vector_hits, keyword_hits], k * 4)
    meta = chunks.withColumnRenamed(id_, "id") if id_ != "id" else chunks
    ok = meta.select("id") if where is None else meta.filter(where).select("id")
    return top_k(x.drop("rank").join(ok, "id", "left_semi"), ["qid"], [F.desc("score"), F.col("id")], k, "id")


def context_block(hits: DataFrame) -> DataFrame:
    """One formatted text per query from its ranked hits (at most k per query)."""
    # Fixed value: the line format of a context block.
    line = F.format_string("[%d] Fonte: %s | Camada: %s | Versão: %s | Tags: %s\n%s\n", "rank", "source", "layer", "version", F.array_join("tags", ", "), "content")
    g = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
    return g.select("qid", F.array_join(F.transform("l", lambda v: v["t"]), "\n---\n").alias("context"))


# ---- quality ----------------------------------------------------------------------------

def retrieval_quality(hits: DataFrame, relevant: Column, expected: DataFrame) -> DataFrame:
    """MRR, precision and recall; `expected` has (qid, n_expected)."""
    h = hits.withColumn("_ok", relevant)
    per = h.groupBy("qid").agg(F.min(F.when(F.col("_ok"), F.col("rank"))).alias("_first"), F.count_if("_ok").alias("_hit"), F.count("*").alias("_n"))
    x = expected.join(per, "qid", "left")
    return x.agg(
        F.avg(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.col("_hit") / F.col("_n")).alias("precision"),
        F.avg(F.when(F.col("n_expected") > 0, F.coalesce("_hit", F.lit(0)) / F.col("n_expected"))).alias("recall"),
        F.count("*").alias("n_queries"))


def token_overlap(pairs: DataFrame, truth: str, context: str) -> DataFrame:
    """Mean token precision and recall of contexts against the truth, and the gate.

    Fixed values: precision 0.80, recall 0.85.
    """
    t, c = TX.overlap_tokens(F.col(truth)), TX.overlap_tokens(F.col(context))
    x = pairs.select(F.size(t).alias("nt"), F.size(c).alias("nc"), F.size(F.array_intersect(t, c)).alias("ni")).filter("nt > 0 and nc > 0")
    a = x.agg(F.avg(F.col("ni") / F.col("nc")).alias("context_precision"), F.avg(F.col("ni") / F.col("nt")).alias("context_recall"), F.count("*").alias("n"))
    return a.withColumn("passed", (F.col("context_precision") >= 0.80) & (F.col("context_recall") >= 0.85))


def index_checks(chunks: DataFrame) -> DataFrame:
    """Q14: the index is not empty and has layers."""
    a = chunks.agg(F.count("*").alias("n"), F.countDistinct("layer").alias("l"))
    return a.select(F.inline(F.array(
        F.struct(F.lit("NOT_EMPTY").alias("code"), (F.col("n") > 0).alias("passed"), F.col("n").alias("count")),
        F.struct(F.lit("LAYERS_PRESENT").alias("code"), (F.col("l") > 0).alias("passed"), F.col("l").alias("count")))))
