"""Facts that SQL doesn't cover: functions, ingestion, approximate search, filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed, stemming
from lodestone.functions import text as X
from lodestone.operators import facets, lists, postings, ranking, search, splits
from lodestone.plans import catalogue
from lodestone.sources import corpus, index
from lodestone.streaming.ingest import ConcurrentWriter, SplitWriter, ingest_batch, stream_into


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, X.ngrams(F.lit("A-b!C aaaa ab"))) == ["abc", "aaa"]
    assert one(spark, X.gram_key(F.lit("abc"))) == 6382179
    assert one(spark, X.words(F.lit("GPT-4 and BERT"))) == ["gpt", "4", "and", "bert"]
    assert one(spark, X.normalize_id(F.lit("café 978-0"))) == "CAF9780"
    assert one(spark, X.fnv1a(F.lit("a").cast("binary"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, X.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_ingest_lifecycle(spark, tmp_path):
    w = SplitWriter(spark, str(tmp_path))
    assert w.flush() is None
    w.add(spark.createDataFrame([(1, "a b"), (2, "")], "k long, text string"), "k")
    assert (w.flush()["lo"], w.next_doc) == (0, 2)
    w.delete(0)
    assert w.flush()["n"] == 0
    again = SplitWriter(spark, str(tmp_path))
    assert again.next_doc == 2 and [r.doc for r in again.read().collect()] == [1]
    again.compact([s["name"] for s in again.splits()])
    assert len(again.splits()) == 1 and [r.doc for r in again.tombstones().collect()] == [0] and [r.doc for r in again.read().collect()] == [1]
    with pytest.raises(ValueError):
        again.compact(["none"])


def test_ingest_replay_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("add", 1, "a b", None), ("add", 2, "c", None)], "op string, k long, text string, doc long")
    gone = spark.createDataFrame([("delete", None, None, 1)], "op string, k long, text string, doc long")
    path = str(tmp_path)
    assert ingest_batch(rows, 0, path, "k") and not ingest_batch(rows, 0, path, "k")
    assert ingest_batch(gone, 1, path, "k") and not ingest_batch(gone, 1, path, "k") and not ingest_batch(rows, 0, path, "k")
    assert ingest_batch(rows, 0, path, "k", source="other")
    assert [r.doc for r in SplitWriter(spark, path).read().orderBy("doc").collect()] == [0, 2, 3]


def test_stream_of_micro_batches(spark, tmp_path):
    schema = "op string, k long, text string, doc long"
    spark.createDataFrame([("add", 5, "late", None), ("add", 3, "early", None)], schema).write.json(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream_into(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/set", "k", f"{tmp_path}/check").awaitTermination()
        assert [(r.doc, r.text) for r in SplitWriter(spark, f"{tmp_path}/set").read().orderBy("doc").collect()] == [(0, "early"), (1, "late")]


def test_concurrent_writers_and_memtable(spark, tmp_path):
    a, b = SplitWriter(spark, str(tmp_path)), SplitWriter(spark, str(tmp_path), flush_bytes=4)
    one = spark.createDataFrame([(1, "text")], "k long, text string")
    a.add(one, "k")
    assert a.pending_docs == 1 and a.flush()["n"] == 1
    with pytest.raises(ConcurrentWriter):
        b.add(one, "k")  # it is large enough to be flushed at once
    c = SplitWriter(spark, str(tmp_path), flush_bytes=4)
    c.add(one, "k")
    assert c.pending_docs == 0 and len(SplitWriter(spark, str(tmp_path)).splits()) == 2


def test_ranks_of_ties_nulls_and_many_partitions(spark):
    rows = [(i, None if i % 7 == 0 else i % 3, f"n{i}") for i in range(500)]
    got = postings.assign_ranks(spark.createDataFrame(rows, "k long, r int, __at string").repartition(9), "r", "k")
    want = [k for k, *_ in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert [r.k for r in got.orderBy("doc").collect()] == want and got.columns == ["k", "r", "__at", "doc"]
    assert [r.doc for r in got.select("doc").orderBy("doc").collect()] == list(range(500))
    assert postings.assign_ranks(spark.createDataFrame([], "k long, r int"), "r", "k").count() == 0


def test_index_round_trip_and_pruned_plan(spark, tmp_path):
    docs = postings.assign_ranks(spark.createDataFrame([(1, "alpha beta", 5), (2, "beta Gamma", 9), (3, None, 1)], "k long, text string, n long"), "n", "k")
    ix = index.build(docs, f"{tmp_path}/ix", {"size": F.when(F.col("n") > 4, "big")})
    assert index.Index(spark, f"{tmp_path}/ix").complete() and not index.Index(spark, f"{tmp_path}/none").complete()
    assert [tuple(r) for r in ix.terms().select("term", "doc", "tf").orderBy("term", "doc").collect()] == [("alpha", 1, 1), ("beta", 0, 1), ("beta", 1, 1), ("gamma", 0, 1)]
    assert {r.gram for r in ix.grams().where("doc = 0").collect()} == {"bet", "eta", "gam", "amm", "mma"}
    assert [tuple(r) for r in ix.table("facet_dict").collect()] == [("size", "big", 2)] and ix.table("records").count() == 3
    plan = ix.grams(["bet"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(gram,bet)" in plan.replace("In(gram, [bet])", "EqualTo(gram,bet)")
    with pytest.raises(Exception):
        index.build(docs, f"{tmp_path}/ix", {})
    with pytest.raises(ValueError):
        ix.table("other")


def test_column_values_are_checked(spark):
    docs = spark.range(5).selectExpr("id as doc", "id * 2 as x")
    assert sorted(r.value for r in ranking.column_values(docs, [3, 1], "x").collect()) == [2, 6]
    with pytest.raises(ValueError):
        ranking.column_values(docs, [5], "x")


def test_cursor_pages_without_gaps(spark):
    c = search.Cursor(spark.range(7).withColumnRenamed("id", "doc"))
    assert (c.next(3), c.next(3), c.next(3), c.next(3), c.loaded) == ([0, 1, 2], [3, 4, 5], [6], [], 7)
    assert [r.doc for r in c.page(2, 2).collect()] == [2, 3]


def test_min_match_strict_and_lenient(spark):
    p = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "term string, doc long")
    d = postings.dictionary(p, "term")
    of = lambda keys, n: {r.doc for r in search.min_match(p, d, "term", keys, n).collect()}
    assert of(["a", "b", "x"], 3) == {1} and of(["a", "x"], 2) == {1, 2} and of(["x", "y"], 1) == set() and of(["a"], 0) == {1, 2}
    assert search.query_postings(p, d, "term", ["a", "x"]).count() == 0 and search.query_postings(p, d, "term", ["a", "x"], strict=False).count() == 2
    assert tuple(search.prefix_truncated(d, "", 1).first()) == (1, True)


def test_stemmers_languages_and_stop_words(spark):
    known = {"english": "running run relational relat happiness happi hopping hop hoping hope generously generous flies fli dying die news news abilities abil conspicuously conspicu controlling control", "danish": "løbende løb", "norwegian": "løpende løp", "swedish": "springande spring", "dutch": "lopende lopend"}
    for lang, pairs in known.items():
        w = pairs.split()
        got = spark.createDataFrame([(x,) for x in w[::2]], "t string").select(stemming.stem(F.col("t"), lang).alias("s")).collect()
        assert [r.s for r in got] == w[1::2]
    with pytest.raises(ValueError):
        stemming.stem_word("x", "tamil")
    assert X.language(" EN ") == (1, "english") and X.language("Turkish") == (18, "turkish")
    with pytest.raises(ValueError):
        X.language("xx")
    assert {"und", "der"} <= set(stemming.stop_words("german")) and "le" in stemming.stop_words("french")
    rows = postings.term_postings(spark.createDataFrame([(1, "Running the runs")], "doc long, text string"), stop=X.ENGLISH, stem=lambda t: stemming.stem(t))
    assert [tuple(r) for r in rows.collect()] == [("run", 1, 2)]


def test_facet_keys_and_case(spark):
    h = 0xCBF29CE484222325
    for b in b"lang\x1fen":
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert one(spark, X.facet_key(F.lit("Lang"), F.lit("EN"))) % (1 << 64) == h
    assert one(spark, X.ngrams(F.lit("AbCd"), 3, True)) == ["AbC", "bCd"]


def test_ivfpq_recall_of_the_registered_queries(spark):
    """Every query of the stated set, by the parameters that are registered: at least 0.9 of the exact neighbours."""
    for sf in ("0.01", "0.1"):
        d = f"/root/testdata/sf{sf}"
        exact = {tuple(r) for r in catalogue.QUERIES["vector_exact_all"](spark, d).select("q", "doc").collect()}
        for name in ("ivfpq_search", "ivfpq_rerank"):
            found = {tuple(r) for r in catalogue.QUERIES[name](spark, d).select("q", "doc").collect()}
            assert len(exact & found) / len(exact) >= 0.9, (name, sf)


def test_ivfpq_parts_are_checked(spark):
    with pytest.raises(ValueError):
        ranking.Ivfpq(np.zeros((2, 4)), np.zeros((2, 3, 3)))
    with pytest.raises(ValueError):
        ranking.Ivfpq(np.full((2, 4), np.nan), np.zeros((2, 3, 2)))
    ix = ranking.Ivfpq(np.zeros((2, 4)), np.zeros((2, 3, 2)), "l2")
    with pytest.raises(ValueError):
        ix.take(spark.createDataFrame([(5, 1, [0, 0])], "cluster int, doc long, code array<smallint>"))


def test_split_family(spark):
    m = lambda *r: spark.createDataFrame(r, "split long, doc_lo long, doc_hi long, doc_count long")
    both = splits.merged([m((0, 0, 4, 5), (1, 5, 9, 5)), m((0, 10, 12, 3))])
    assert [r.split for r in both.orderBy("doc_lo").collect()] == [0, 1, 2]
    assert [tuple(r) for r in splits.locate(spark.createDataFrame([(0,), (9,), (12,), (99,)], "doc long"), both).orderBy("doc").collect()] == [(0, 0, 0), (9, 1, 4), (12, 2, 2)]
    with pytest.raises(ValueError):
        splits.merged([m((0, 0, 4, 5)), m((0, 4, 6, 3))])
    docs = spark.createDataFrame([(i, i // 5) for i in range(13)], "doc long, split long")
    assert splits.verify(docs, both).count() == 0
    bad = {(r.split, r.problem) for r in splits.verify(docs, m((0, 0, 5, 5), (1, 5, 9, 4), (7, 20, 21, 2))).collect()}
    assert bad == {(0, "range"), (0, "overlap"), (1, "count"), (2, "not in the manifest"), (7, "no documents")}
    with pytest.raises(ValueError):
        splits.search_filtered(None, None, None, None, "gram", ["a"], [], 5, exclude=[("a", "b")])
    keys = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(40)], "doc long, keys array<string>")
    got = splits.seal(keys, 400, 800, band=10).orderBy("doc").collect()
    assert [r.split for r in got] == sorted(r.split for r in got) and {r.doc for r in got if r.tier == 0} >= {0, 10, 20, 30}


def test_works_loader(spark, tmp_path):
    lines = ['{"id":"https://x.org/W1","display_name":"A title","abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":"X"}},{"author":{"display_name":"Y"}}],"publication_year":1999,"concepts":[{"display_name":"C"}],"doi":"https://doi.org/10.1/Z"}', '{"id":"W2","display_name":""}', "not json"]
    (tmp_path / "w.jsonl").write_text("\n".join(lines))
    got = corpus.load_works(spark, f"{tmp_path}/w.jsonl").collect()
    assert [(r.id, r.title, r.abstract, r.authors, r.topic, r.year, r.cited, r.doi) for r in got] == [("W1", "A title", "a b a", "X; Y", "C", 1999, 0, "10.1/z")]
    assert corpus.table(spark, f"{tmp_path}/none", "a int").count() == 0


def test_fusion_filters_and_sealing(spark):
    a, b = (spark.createDataFrame(x, "doc long, rank int") for x in ([(10, 1), (20, 2), (30, 3)], [(30, 1), (40, 2), (10, 3)]))
    assert [r.doc for r in ranking.fuse([a, b]).orderBy(F.desc("score"), "doc").collect()] == [10, 30, 20, 40]
    with pytest.raises(ValueError):
        ranking.fuse([a, b], weights=[1.0])
    with pytest.raises(ValueError):
        facets.parse_filter([("lang",)])
    keys = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(20)], "doc long, keys array<string>")
    got = splits.seal(keys, 400, 800).orderBy("doc").collect()
    assert got[-1].split > 0 and [r.split for r in got] == sorted(r.split for r in got)


def test_word_piece_embedding(spark):
    pieces = ["[UNK]", "run", "##ning", "cafe", "!", "漢", "##n"]
    codes = np.arange(14).reshape(7, 2)
    rows = [(i, p, c.tolist(), 0.5) for i, (p, c) in enumerate(zip(pieces, codes))]
    m = embed.load(spark.createDataFrame(rows, "id int, piece string, code array<int>, scale double"))
    assert m.words("Run\u0000ning, Café!漢x") == ["running", ",", "cafe", "!", "漢", "x"]
    assert m.pieces("running") == [1, 2] and m.pieces("runx") == [0] and m.pieces("r" * 101) == [0]
    mean = codes[[1, 2]].mean(axis=0)
    got = spark.createDataFrame([("running",), ("",), (None,)], "t string").select(m.column(spark, F.col("t")).alias("v")).collect()
    assert np.allclose(got[0].v, mean / np.linalg.norm(mean)) and list(got[1].v) == [0, 0] == list(got[2].v)
    with pytest.raises(ValueError):
        embed.WordPieces(["a"], codes[:1], np.ones(1))


def test_rerank_vectors_in_bfloat16(spark, tmp_path):
    x = np.array([1.0, 1.00390625, 1.01171875, -3.1415927, 0.0, np.nan], np.float32)
    assert np.array_equal(embed.round_bf16(x)[:5], np.array([1.0, 1.0, 1.015625, -3.140625, 0.0], np.float32)) and np.isnan(embed.round_bf16(x)[5])
    v = corpus.embeddings(spark, "/root/testdata/sf0.001")
    dim = len(v.first().v)
    embed.write_rerank(v, dim, f"{tmp_path}/rr")
    stored, query = spark.read.parquet(f"{tmp_path}/rr"), [float(c) for c in v.where("doc = 3").first().v]
    exact = {r.doc for r in ranking.exact_knn(v.select("doc", X.l2_normalize(F.col("v")).alias("v")), query, 20).collect()}
    assert len(exact & {r.doc for r in ranking.exact_knn(stored, query, 20).collect()}) >= 19
    with pytest.raises(ValueError):
        embed.write_rerank(v, dim + 1, f"{tmp_path}/bad")


def test_lists_cut_the_same_keys_as_text_functions(spark, monkeypatch):
    """grams and terms cut from whole texts are those of the text functions, across rows, pieces and lists."""
    texts = ["A-b!C aaaa ab", "", None, "İstanbul ΣΑΣ ΟΔΟΣ. ⅷ ②x x̱y ﬁn Straße", "a😀b 𝒳𝒴𝒵𝒳𝒴𝒵 नमस्ते 漢字仮名", "x" * 5000 + "abc", "the the the the\u000bthe\tandanding and and", *[f"word{i % 7} the" for i in range(700)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    monkeypatch.setattr(lists, "PIECE", 997)
    for n, case in ((3, False), (3, True), (2, False), (4, False)):
        want = docs.select(F.explode(X.ngrams(F.col("text"), n, case)).alias("gram"), "doc")
        assert sorted(map(tuple, postings.gram_postings(docs, n, case_sensitive=case).collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, postings.gram_df(docs, n, case).collect())) == sorted(map(tuple, want.groupBy("gram").count().collect()))
    want = docs.select(F.explode(X.words(F.col("text"))).alias("term"), "doc").groupBy("term", "doc").count()
    assert sorted(map(tuple, postings.term_postings(docs).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, postings.term_df(docs).collect())) == sorted(map(tuple, want.groupBy("term").count().collect()))
    assert {r.doc: r.n_kept for r in postings.kept_lengths(docs).where("doc < 8").collect()}.get(6) == 1


def test_an_index_makes_what_is_asked_for_only(spark, tmp_path):
    """Each query used to build every relation of the index."""
    docs = spark.createDataFrame([(0, "alpha beta", 5), (1, "Beta", 9), (2, None, 1)], "doc long, text string, n long")
    ix = index.Index(spark, f"{tmp_path}/ix", index.Recipe(lambda: docs, lambda: docs, {"size": F.when(F.col("n") > 4, "big")}))
    made = lambda: {n for n in (*index.TABLES, "counts") if ix.made(n)}
    assert [r.df for r in ix.dictionary("term", ["beta"]).collect()] == [2] and made() == {"term_dict"}
    assert ix.grams(["bet"]).count() == 2 and made() == {"term_dict", "docs", "grams"}
    assert [(r.n, r.avgdl) for r in ix.table("stats").collect()] == [(3, 1.0)] and not ix.complete()
    assert ix.terms(["beta"]).count() == 2 and not ix.made("facets")


def test_forms_keep_to_what_is_asked_about(spark):
    """a corpus with further words of the same stem gave documents that the stated forms don't."""
    words = spark.createDataFrame([("and",), ("andly",), ("anding",), ("band",)], "term string")
    assert search.forms(words, "anding") == ["and", "anding", "andly"]
    assert search.forms(words.where(F.col("term").isin(*stemming.FAMILY)), "anding") == ["and", "anding"]


def test_stemmed_search_keeps_to_the_stated_forms(spark, tmp_path):
    """a document whose only form is none of the stated ones came back too."""
    rows = [(0, "Sand, anding", "en", "a", 9), (1, "andly band", "en", "a", 8), (2, "this AND that", "de", "b", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc for r in catalogue.QUERIES["stemmed_search"](spark, str(tmp_path)).collect()) == [0, 2]


def test_vectors_in_blocks_of_queries_and_lists(spark, monkeypatch):
    """A task holds some queries and some vectors; however many blocks there are, the answer is that of one block."""
    x = np.random.default_rng(3).integers(-3, 4, (300, 8)).astype(float)  # many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc long, v array<double>")
    asked = v.where("doc % 7 = 0").withColumnRenamed("doc", "q")
    of = lambda df: sorted((r.q, r.doc, round(r.score, 9)) for r in df.collect())
    parts = ranking.Ivfpq(x[:4], x[:64].reshape(64, 4, 2).transpose(1, 0, 2).copy(), "l2")
    whole = [of(ranking.exact_all(v, asked, 5, m)) for m in ("ip", "l2")] + [of(parts.search_all(parts.encode(v), asked, 5, 3))]
    for m, s in zip(whole, (x @ x.T, -((x[:, None] - x) ** 2).sum(2))):
        assert m == sorted((q, int(d), s[q, d]) for q in range(0, 300, 7) for d in np.lexsort([np.arange(300), -s[q]])[:5])
    monkeypatch.setattr(ranking, "ASKED", 10)
    monkeypatch.setattr(ranking, "AT_ONCE", 17)
    assert [of(ranking.exact_all(v, asked, 5, m, block=40)) for m in ("ip", "l2")] + [of(parts.search_all(parts.encode(v), asked, 5, 3, block=40))] == whole


def test_a_large_row_group_is_spread_among_tasks(spark, tmp_path):
    """what counts documents read them as they lie, so one row group was cut by one task."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(600)]
    spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spread = corpus.texts(spark, str(tmp_path))
    assert spread.count() == 602 and spread.columns == ["text"] and sorted(r.text for r in spread.where("text <> ''").collect()) == sorted(texts)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        assert spread.select(F.length("text"), F.spark_partition_id().alias("p")).select("p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", kept)


def test_ranks_evaluate_texts_once_and_even_out_their_lengths(spark, monkeypatch):
    """The range sort's sample evaluated whole rows, twice where they lie in one row group, so one task read all texts three times."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return "x" * (n or 0)

    monkeypatch.setattr(postings, "PART_ROWS", 8)
    rows = [(i if i % 11 else None, None if i % 7 == 0 else 900 if i < 20 else i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, r int").coalesce(1)
    got = postings.assign_ranks(df.withColumn("text", text("r")), "r", "k", weight="r")
    assert seen.value == 400
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0] is not None, x[0] or 0))
    assert [(r.k, r.r, len(r.text)) for r in got.orderBy("doc").collect()] == [(k, r, r or 0) for k, r in want]
    assert [r.doc for r in got.select("doc").orderBy("doc").collect()] == list(range(400)) and seen.value == 400
    cuts = postings._borders(df, "r", "k", "r")
    assert len(cuts) == 3 and all(r == 900 for r, _ in cuts)  # by weight; by rows the long ones would lie in one part
    assert postings.assign_ranks(df, None, "k").count() == 400
    days = spark.sql("select date_add(date'2020-01-01', cast(id % 50 as int)) as d, concat('k', id) as k, id % 5 as n from range(300)")
    order = [(r.d, r.k) for r in postings.assign_ranks(days, "d", "k").orderBy("doc").collect()]
    assert order == sorted(((r.d, r.k) for r in days.collect()), key=lambda x: (-x[0].toordinal(), x[1]))
