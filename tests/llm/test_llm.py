"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import byte_bpe, chat, exact_dedup, html_extract, language_id, minhash_dedup, packing, quality, toxicity
from pulseframe.llm.common import bounded_sample, components, crc_mod
from pulseframe.llm.embedding_dedup import link_embeddings
from pulseframe.llm.pretokens import regular
from pulseframe.session import pinned

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, digest string, n long, id string, rep_text string, file string"
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, rows):
    """Rows (id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", None, "f") for i, t in rows], DOCS)


def union_find(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(200, [e for e in edges if None not in e])
    ends = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert got == {i: want[i] for i in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact deduplication


def exact_by_hand(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (5, ""), (6, "A"), (7, "ä" * 5000), (8, "ä" * 5000), (None, "z"), (None, "z"), (None, "a"), (9, "a ")]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs_of(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == exact_by_hand(ROWS)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_exact_dedup_tells_equal_digests_apart(spark):
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", "c", "b", "a", "", None])]
    weak = lambda text: F.lpad(F.hex(F.length(F.coalesce(text, F.lit("")))), 4, "0")
    got = exact_dedup.exact_dedup(docs_of(spark, rows), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in exact_by_hand(rows))


def test_state_is_kept_between_runs(spark, tmp_path):
    src, ck = f"{tmp_path}/in", f"{tmp_path}/state"
    one = spark.createDataFrame([(1, b"d", "f1"), (2, b"e", "f1")], "id long, digest binary, file string")
    one.write.parquet(src)
    exact_dedup.ingest(src, one.schema, ck, spark)
    spark.createDataFrame([(9, b"d", "f2")], one.schema).write.mode("append").parquet(src)
    exact_dedup.ingest(src, one.schema, ck, spark)
    got = {bytes(r.digest): (r.n, r.keep_id, r.keep_file) for r in exact_dedup.read_state(spark, ck).collect()}
    assert got == {b"d": (2, 9, "f2"), b"e": (1, 2, "f1")}


def test_keep_exact_keeps_columns_and_null_ids(spark):
    d = docs_of(spark, ROWS)
    kept = exact_dedup.keep_exact(d)
    assert kept.columns == d.columns
    assert sorted((repr(r.doc_id), (r.text or "")[:3]) for r in kept.collect()) == sorted((repr(i), (t or "")[:3]) for i, t in [(2, "a"), (3, "b"), (5, ""), (5, ""), (6, "A"), (8, "ä" * 5000), (None, "z"), (None, "z"), (9, "a ")])


# ---- byte-level BPE


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    alpha = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "中", "1", "²", "'s", "'ll", "!", "\xa0", "\x1c", "😀", "\0", "A", " the", "\r\n", "e\u0301", "<|endoftext|>"]
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_byte_bpe_equals_tiktoken():
    enc, tk = byte_bpe.encoder(MULTI, P.PATTERN), tiktoken_encoding()
    texts = odd_texts(3000) + ["", "a" * 30_000, "ab" * 9000, "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000)), "plain words, in a row.\nNext line"]
    for t, packed in zip(texts, enc.encode_packed(texts)):
        ids = tk.encode_ordinary(t)
        assert list(np.frombuffer(packed, "<u4")) == ids, t[:50]
        assert enc.decode(ids) == t.encode()


def test_regular_white_space():
    assert regular("a b\nc") and regular("ein Wört")
    assert not any(map(regular, ["a  b", " a", "a\n", "a\n\nb", "a \nb", "a\tb", "a\xa0b", "a\0b", "a\u2003b"]))


def test_bitmap_merge_equals_lowest_rank_first():
    """Random and repetitive tokens against a plain scan for the lowest rank; the buckets are kept for the next token and must be empty between two."""
    import random

    enc, r = byte_bpe.encoder(MULTI, P.PATTERN), random.Random(5)
    for _ in range(400):
        token = r.choice([bytes(r.randrange(256) for _ in range(r.randrange(40))), bytes(r.choice(b"ab e") for _ in range(r.randrange(80))), b"a" * r.randrange(60)])
        parts = [token[i : i + 1] for i in range(len(token))] if token not in enc.ranks else [token]
        while len(parts) > 1:
            rank, i = min((enc.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert enc.merge(token) == [enc.ranks[x] for x in parts]
        assert not any(enc._buckets) and not any(enc._low) and not any(enc._mid)


def test_byte_bpe_operator(spark):
    tk = tiktoken_encoding()
    rows = [(1, "some text\nhere"), (1, "some text\nhere"), (None, "x"), (2, None), (3, ""), (4, "w" * 70_000)]
    got = byte_bpe.encode_documents(docs_of(spark, rows), MULTI, P.PATTERN).collect()
    assert len(got) == 6 and all(r.exact for r in got)
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, next(t for i, t in rows if i == r.doc_id))))):
        ids = tk.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs_of(spark, []), MULTI, P.PATTERN).count() == 0


# ---- MinHash near-duplicates


def near_by_hand(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    label = union_find(len(rows), edges)
    low = {}
    for i, l in enumerate(label):
        low[l] = min(low.get(l, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[label[i]], rows[i][0] == low[label[i]]) for i in range(len(rows)))


def test_near_duplicates_by_hand(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "ONE"), (105, "one two three"), (106, "one  two\tthree"), (107, "One two thrée")]
    for g in range(12):  # chains of edits: neighbours are near, the ends need not be
        text = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows) + 200, " ".join(text)))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    got = minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == near_by_hand(rows, 4, 4, 5)


def test_near_duplicates_of_a_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = minhash_dedup.near_duplicates(d, width=5).collect()
    assert sorted(map(tuple, got)) == near_by_hand(rows, 5, 4, 5)


def test_near_duplicates_dense_region_and_second_pass(spark):
    """A crowd of near copies, more than a block, and outliers linked to members that head no region."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(base)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    far = list(base)
    for k in range(5):
        far[3 + 24 * k] = f"far{k}"
    rows += [(500, " ".join(far)), (501, " ".join(far + ["tail"])), (502, " ".join(far[:100]))]
    got = minhash_dedup.near_duplicates(docs_of(spark, rows), block=16).collect()
    assert sorted(map(tuple, got)) == near_by_hand(rows, 4, 4, 5)


def test_near_duplicates_edges(spark):
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    got = minhash_dedup.near_duplicates(docs_of(spark, [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (0, "q")])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, None, False), (1, 1, 1, True), (1, 1, 1, True), (0, 1, 0, True)], key=repr)
    kept = minhash_dedup.keep_one_of_each(docs_of(spark, [(None, "a b"), (1, "a b"), (2, "a b")]))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "None"]


# ---- embeddings


def test_embeddings_by_hand(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    vecs = [list(map(float, c + rng.normal(size=16) * s)) for c in centre for s in (0, 0, 0.1, 0.2, 0.3, 0.4)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1e300] * 16]
    rows = [(i, v, "x") for i, v in enumerate(vecs + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = sorted(map(tuple, link_embeddings(df, per_cell=10, block=7, margin=0.6).collect()))
    unit = lambda v: np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v)))
    good = [(i, unit(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    edges = [(i, j) for (i, x), (j, y) in itertools.combinations(good, 2) if len(x) == len(y) and x @ y >= 0.9]
    label, n = union_find(len(rows), edges), np.bincount([i for e in edges for i in e], minlength=len(rows))
    assert got == [(i, n[i], label[i], label[i] == i) for i in range(len(rows))]
    assert link_embeddings(spark.createDataFrame([], df.schema)).count() == 0
    again = link_embeddings(spark.createDataFrame([(3, [1.0, 0.0], ""), (3, [1.0, 0.0], ""), (None, [1.0, 0.0], "")], df.schema)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted([(3, 1, 3, True), (3, 1, 3, True), (None, 0, None, False)], key=repr)


def test_embeddings_on_a_circle_across_cells(spark):
    """Neighbours along a curve cross the border of two cells head-on; none may be lost."""
    from pulseframe.llm.embedding_dedup import visited

    a = np.random.default_rng(3).uniform(0, 2 * np.pi, 120)
    x = np.stack([np.cos(a), np.sin(a), np.zeros(120)], axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in link_embeddings(df, per_cell=30).collect()}
    assert [got[i] for i in range(120)] == ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    # 25.8 degrees apart, each 12.9 from the border of two centroids at right angles
    pair = np.radians([45 - 12.9, 45 + 12.9])
    home, cells = visited(np.stack([np.cos(pair), np.sin(pair)], axis=1), np.eye(2), 0.9)
    assert home.tolist() == [0, 1] and [v.tolist() for v in cells] == [[1], [0]]


def test_embeddings_of_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    got = {r.vec_id: r.n_links for r in link_embeddings(df).collect()}
    assert [got[r.vec_id] for r in rows] == (near.sum(1) - 1).tolist()


def shuffled(spark):
    """Bytes written to shuffles and spilled to disk so far."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


def test_embeddings_are_not_shuffled_once_a_visited_cell(spark):
    """in many dimensions a vector visits most cells; what is shuffled follows neither the visits nor the blocks."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[2000:2400] = x[:400] + 0.2 * rng.normal(size=(400, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    before = shuffled(spark)
    got = {r.vec_id: r.n_links for r in link_embeddings(df, per_cell=100, block=16).collect()}
    assert shuffled(spark) - before < 20 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [got[i] for i in range(4000)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_embeddings_in_many_groups(spark):
    """Cells in parts, more groups than cells, one dense group, and pairs that only double precision tells from the threshold."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1, 3)) + 0.15 * rng.normal(size=(150, 3)), rng.normal(size=(150, 3))])
    turn = np.arccos(0.9) + 1e-9 * np.array([-1, 1])
    edge = [[1e3, 0.0, 0.0, 0.0, 0.0], *([float(np.cos(b)), float(np.sin(b)), 0.0, 0.0, 0.0] for b in turn)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, v) for i, v in enumerate(edge)]
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=60, block=16, group_bytes=24 * 20).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    edges = list(zip(*np.nonzero(np.triu(near, 1)))) + [(300, 301), (301, 302)]
    label, n = union_find(303, edges), np.bincount(np.array(edges).ravel(), minlength=303)
    assert sorted(map(tuple, got)) == [(i, n[i], label[i], label[i] == i) for i in range(303)]


# ---- language


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    held = crc_mod("doc_id", 4) == 2
    model = language_id.fit(d, "lang", "text", ~held)
    got = language_id.identify(d, model).join(d, "doc_id").filter(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.98
    odd = language_id.identify(docs_of(spark, [(1, None), (2, ""), (3, "12 !?"), (None, "the of and"), (4, "ß" * 3_000_000)]), model)
    out = {r.doc_id: r for r in odd.collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[None].lang_pred in model.languages and 0 <= out[4].score <= 1
    assert language_id.identify(docs_of(spark, []), model).count() == 0
    assert language_id.fit(d, "lang", "text", F.lit(False)) is None
    assert language_id.identify(docs_of(spark, [(1, "a")]), None).first().lang_pred == "und"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c}) == n and (abs(c.sum(0)) < n).all()


def test_bounded_sample(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3900, "a").otherwise("b").alias("k"))
    got = {r.k: r["count"] for r in bounded_sample(rows, "k", "id", 500).groupBy("k").count().collect()}
    assert got["b"] == 100 and 400 < got["a"] < 600
    many = spark.range(6000).select("id", (F.col("id") % 1500).cast("string").alias("k"))
    assert bounded_sample(many, "k", "id", 50).select("k").distinct().count() == 1500
    same = spark.range(5000).select(F.when(F.col("id") < 4990, "one text").otherwise(F.concat(F.lit("word "), "id")).alias("t"), F.lit("en").alias("l"))
    assert language_id.fit(same, "l", "t", F.lit(True)) is not None


# ---- quality


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    sizes, step = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    score = rng.normal(size=(8, 2))
    p, pairs, z = quality.marginals(score, step, sizes)
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(sizes):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(score[at + t, s] for t, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        assert np.isclose(z[k], np.log(w.sum()))
        for t in range(n):
            assert np.isclose(p[at + t, 1], w[[path[t] == 1 for path in paths]].sum() / w.sum())
        for path, v in zip(paths, w / w.sum()):
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += v
        at += n
    assert np.allclose(pairs, want_pairs)
    weight = np.repeat([0.5, 0.2, 2.0], sizes)
    one = [quality.marginals(score[a : a + n], step, np.array([n]))[1] for a, n in zip((0, 1, 5), sizes)]
    assert np.allclose(quality.marginals(score, step, sizes, weight)[1], 0.5 * one[0] + 0.2 * one[1] + 2.0 * one[2])


def test_line_numbers_by_hand():
    x, size = quality.line_numbers("Ab ab ab!!\n\nx | 1")
    assert size.tolist() == [10, 0, 5] and len(x) == 3
    assert np.isclose(x[0, 1], 6 / 10) and np.isclose(x[0, 2], 1 / 6) and np.isclose(x[0, 12], 1.0) and np.isclose(x[2, 5], 10 / 5)
    assert len(quality.line_numbers("")[0]) == 1
    for long in ("word " * 300_000, "x" * 524_288 + "\n", "x" * 700_000, "ab\n" * 300_000, "x" * 600_000 + "\n\n" + "y" * 600_000 + "\nz", "\n" * 524_289):
        size = quality.line_numbers(long)[1]
        assert size.tolist() == [len(v) for v in long.split("\n")]


def test_labels_join_under_names_of_their_own(spark):
    """Documents with columns called label, _id, text and share do not clash with the labels."""
    rows = [(i, f"clean words number {i}. more of them" if i % 2 else f"||| {i} ||| !!! foulword {i}", "l", 1.0, 3, 4) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string, _share double, _id int, _label int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(80)], "doc_id long, quality int, toxic int, text string")
    q, t = quality.fit(d, labels, F.lit(True)), toxicity.fit(d, labels, F.lit(True))
    good = quality.keep_good(d, q)
    assert good.columns == d.columns and good.count() == 40
    assert toxicity.score(d, t).filter("predicted = 1").count() == 40 and toxicity.keep_clean(d, t).count() == 40


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = crc_mod("doc_id", 3) == 1
    model = quality.fit(d, labels, ~held)
    right = quality.score(d, model).join(labels, "doc_id").filter(held).agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.97
    rows = [(1, None), (2, ""), (None, "x y"), (3, "\n" * 2000), (4, "a " * 400_000), (3, "\n" * 2000)]
    got = quality.score(docs_of(spark, rows), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score(docs_of(spark, []), model).count() == 0
    assert quality.fit(d, labels.filter("doc_id < 0"), F.lit(True)) is None
    assert quality.score(docs_of(spark, [(1, "a")]), None).first().score == 0.5


# ---- toxicity


def test_toxicity_bags(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            k = rng.randrange(len(sentences))
            sentences[k] += " zzyxfoul" + rng.choice(["er", "ish", ""])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    d, l = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert sum(got[i].predicted == y for i, y in labels) >= 396
    for i, t in rows[::4]:
        if got[i].predicted:
            assert all("zzyxfoul" in t[s.start : s.end] for s in got[i].offending)
    s, p = model.score("bad zzyxfouler. fine words! more")
    assert len(p) == 3 and np.isclose(s, 1 - np.prod(1 - p), atol=1e-6)
    odd = toxicity.score(docs_of(spark, [(1, None), (2, ""), (None, "..."), (3, "word " * 500_000), (1, None)]), model).collect()
    assert len(odd) == 5 and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs_of(spark, []), model).count() == 0
    assert toxicity.fit(d, l.filter("toxic = 0"), F.lit(True)) is None
    assert toxicity.score(docs_of(spark, [(1, "a")]), None).first().score == 0.0
    assert {r.doc_id for r in toxicity.keep_clean(d, model).collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_long_clean_text_is_not_toxic(spark):
    """Toxic documents that no n-gram explains must not make sentences of clean documents suspicious."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        foul = " zzyxfouler" if i % 4 == 0 and i % 40 else ""  # one toxic document in ten looks like a clean one
        rows.append((i, ". ".join(" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 8))) + foul))
        labels.append((i, int(i % 4 == 0)))
    d, l = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l, F.lit(True))
    clean = ". ".join(t for i, t in rows if i % 4)
    long = ". ".join([clean] * (100_000 // clean.count(".") + 1))
    table = docs_of(spark, [(1, long), (2, long + ". a zzyxfouler. " + clean), (3, "name " + "." * 100_000 + " 3.14")])
    got = {r.doc_id: (r.predicted, len(r.offending), r.n_sentences >= 100_000) for r in toxicity.score(table, model).collect()}
    assert got == {1: (0, 0, True), 2: (1, 1, True), 3: (0, 0, True)}
    assert sorted(r.doc_id for r in toxicity.keep_clean(table, model).collect()) == [1, 3]


def test_sentence_grams_over_segments(monkeypatch):
    text = "some words here. and more! with an end\nand a last one"
    whole = sorted(zip(*(np.concatenate(c).tolist() for c in zip(*toxicity.sentence_grams(text)))))
    monkeypatch.setattr(toxicity, "SEGMENT", 7)
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*toxicity.sentence_grams(text))))) == whole


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    alpha = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[", "<", " ", "\n", "x", "[SYS]", "[/SYS]", "é"]
    rows, want = [], {}
    for c in [None, *range(60)]:
        turns = [(c, t, rng.choice(["user", "assistant", "system", "[/SYS]", None]), rng.choice([None, "".join(rng.choice(alpha) for _ in range(rng.randint(0, 12)))])) for t in range(rng.randint(1, 6))]
        rows += turns
        said = [(r or "", x or "") for _, _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        want[c] = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id int")
    got = {r[0]: tuple(r)[1:] for r in chat.conversation_digests(df).collect()}
    assert {k: v[:4] for k, v in got.items()} == want
    texts = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for k, r in texts.items():
        assert len(r.text) == got[k][4]
        loss = "".join(chat.unescape(r.text[a:b]) for a, b in r.loss_spans)
        assert hashlib.sha256(loss.encode()).hexdigest() == want[k][3]
    assert chat.conversation_digests(spark.createDataFrame([], df.schema)).count() == 0


def test_template_language():
    show = lambda t, **v: "".join(x for x, _ in chat.compile_template(t)(v, False))
    assert show("{% for m in xs %}{{ loop.index }}{% if loop.last %}.{% else %},{% endif %}{% endfor %}", xs=iter("abc")) == "1,2,3."
    assert show("{{ a.b['c'] | upper ~ '!' if a else 'none' }}", a={"b": {"c": "x"}}) == "X!"
    assert show("{% set q a + 1 %}{{ q }}{{ missing }}", a=2) == "3"
    assert list(chat.compile_template("a{% generation %}b{% endgeneration %}c")({}, False)) == [("a", False), ("b", True), ("c", False)]
    assert chat.fold(chat.parse("a{{ 'x' ~ 1 }}{% if 1 == 2 %}no{% else %}yes{% endif %}")) == [("text", "ax1yes")]
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ x | system }}", "{% for x %}", "{% if a %}", "{{ f(1) }}", "{% import os %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("\\<[s/]INT> \n") for _ in range(rng.randint(0, 20)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e.replace("\\<", "").replace("\\[", "") for c in chat.CONTROLS)


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">X</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout-with-sidebar"><article><h1>Head &amp; line</h1><p>One <b>bold</b>
 word&nbsp;here &#233;<p>Unclosed<br>break<aside>Not this</aside><ul><li>item <a href=x>link</a></li></ul>
<form>name <input name=q></form><div class="ad">Buy</div><!-- no --><p>Last.</p>
<section id="comments"><p>I liked it</p></section></article></div><div class="comment">also</div><footer>&copy; 2020</footer></body>"""


def test_page_by_hand(spark):
    want = "Head & line\n\nOne bold word here é\n\nUnclosed break\n\nitem link\n\nLast."
    assert html_extract.extract(PAGE) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "v", "<p>just text, long enough to stand alone</p>"), (4, "w", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_pages(df, carry=["url"]).collect()
    assert sorted(((repr(r.page_id), r.url, r.n_chars) for r in got), key=repr) == sorted([("1", "u", len(want))] * 2 + [("2", None, 0), ("3", "", 0), ("None", "v", len("just text, long enough to stand alone")), ("4", "w", 999_999)], key=repr)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(spark.createDataFrame([], df.schema)).count() == 0


def test_pages_of_a_table(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_extract.extract(r.html) == "\n\n".join(b for b in blocks if b)


def test_tree_fits_its_table():
    assert all(html_extract.is_main(html_extract.tree(), list(r[:-1])) == bool(r[-1]) for r in html_extract.LABELLED)


# ---- packing


def test_cuts():
    for n in range(0, 5000):
        c = packing.cuts(n, 2048, 32)
        assert sum(c) == n and all(0 < p <= 2048 for p in c)
        assert all(2048 - (2048 // p) * p <= 32 + 2048 // p for p in c)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate([None, "", "word " * 3000, "<|endoftext|> é", "z" * 9000] + odd_texts(150, 9))] + [(0, "again"), (None, "no id")]
    extra = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(1000 + r.doc_id, r.text) for r in extra]
    got = packing.pack(docs_of(spark, rows).repartition(3), path, P.PATTERN, ids=True).collect()
    docs, seqs = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        if sum(j == i for j, _ in rows) == 1:
            ids, at = t.encode(text or "", add_special_tokens=False).ids + [1], 0
            for r in sorted(docs[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == ids[at : at + r.length]
                at += r.length
            assert at == len(ids)
    pad = used = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used += at
        pad += 0 if at & (at - 1) == 0 else 2048 - at
    assert pad < 0.02 * used
    assert packing.pack(docs_of(spark, []), path, P.PATTERN).count() == 0


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = pinned(stage(spark, docs, SF))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.items() <= before.items()
        if name == "quality":
            known = [(labels[i].quality, i in after) for i in before if i in labels]
            assert sum(bool(q) == kept for q, kept in known) >= 0.97 * len(known)
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                last[t] = max(i, last.get(t, i))
            assert set(after) == set(last.values())
        if name == "minhash_dedup":
            assert set(after) == {r[0] for r in near_by_hand(list(before.items()), 5, 4, 5) if r[3]}
        docs = out


def test_cached_pieces_are_bounded_and_words_in_one_call_equal_single_ones(monkeypatch):
    """op10: the packer's encoder against the library; no more than `at_once` characters are held."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from pulseframe.llm import common, packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = packing.text_encoder(path, public_tokenizers.PATTERN)
    monkeypatch.setattr(packing, "JOINT", 3)
    monkeypatch.setattr(tok, "_at_once", 40)
    held = []
    monkeypatch.setattr(tok, "_encode_group", lambda g, f=tok._encode_group: held.append(sum(map(len, g))) or f(g))
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = ["word anything été's 1st", "a\nb c don't\n\nx", "", "naïve Straße, Ɐ wörter", "\nlead", "x y z w v u t s", "plain words of one space and letters only", "words words\nwords"]
    assert [[*memoryview(b).cast("I")] for b in tok.encode_many(texts * 3)] == [e.ids for e in lib.encode_batch(texts * 3, add_special_tokens=False)]
    assert max(held) < 40 + max(map(len, texts))
    # pipeline: a worker drops the cache of the step before when it starts on another
    common.release("packing")
    assert packing.text_encoder.cache_info().currsize == 1
    common.release("other")
    assert packing.text_encoder.cache_info().currsize == 0


def test_words_with_a_mark_do_not_reach_the_pattern(monkeypatch):
    """op10: one call of the pattern a piece was a tenth of the time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from pulseframe.llm import common, packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = packing.text_encoder(path, public_tokenizers.PATTERN)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    split = []
    monkeypatch.setattr(tok, "_split", lambda s, f=tok._split: split.append(s) or f(s))
    texts = ["Zqu", "first zquiv, élan. straße; naïve: oh! so? zquiv. , a,, it's, x1, 1, ª. ʼn, ɐb. " + "long" * 40 + ", end.\nzquiv, " + "y" * 101, "zquiv, élan. " + "y" * 101]
    for _ in range(2):
        for some in (texts, texts[::-1], texts[1:2]):
            assert [[*memoryview(b).cast("I")] for b in tok.encode_many(some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
    assert len(split) == len(set(split)) and not {" zquiv,", " élan.", " straße;", " naïve:", " oh!", " so?"}.intersection(split)
    assert not any(len(k) > 100 for k in tok._seen)
    common.release("other")
