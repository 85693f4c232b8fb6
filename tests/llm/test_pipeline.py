"""The pipeline's stages on planted, messy and empty documents, and against a plain version."""

import re

import pyarrow as pa

import corpus_pipeline
from lodestone.llm import _tokens, decontam, lines, minhash, quality_rules

from .helpers import LABELS, SCHEMA, docs, messy, prose
from .test_operators import runs_by_brute_force, sequences


def folder(spark, tmp_path, documents, labels=(), items=()):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def stages(spark, sf):
    """What each stage but the last leaves."""
    table, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, table, sf).write.parquet(f"{sf}/out{k}")
        table = spark.read.parquet(f"{sf}/out{k}")
        out.append(table)
    return out


def test_pipeline_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    item, passage = prose(900, 40), prose(901, 80)
    texts = [(i, prose(i, 120)) for i in range(30)]
    texts += [(40, "the *** !! " * 40), (41, None), (42, prose(500, 60) + " " + item + " " + prose(501, 60))]
    texts += [(50, prose(600, 100) + " " + passage), (51, prose(601, 100) + " " + passage)]
    sf = folder(spark, tmp_path, docs(spark, texts), [(i, 1, 0) for i in range(20)], [(1, item)])
    got = stages(spark, sf)
    assert all(t.schema.simpleString() == docs(spark, []).schema.simpleString() and len(SCHEMA) > 0 for t in got)
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in got]
    clean = set(range(30))
    assert ids[0] == clean | {42, 50, 51} and ids[1] == ids[0] and ids[2] == ids[0] and ids[3] == clean | {50, 51}
    final = {r.doc_id: r for r in got[3].collect()}
    middle = " ".join(passage.split()[20:60])
    assert middle in final[50].text and middle not in final[51].text and final[51].n_chars == len(final[51].text)
    back, _ = sequences(corpus_pipeline.run(spark, sf))
    enc = _tokens.encoder().encode_ordinary
    assert {i: sum((t for _, t, _ in p), []) for i, p in back.items()} == {i: enc(r.text) for i, r in final.items()}


def test_near_copies_leave_no_stumps(spark, tmp_path):
    """Of each group of near copies one document is left, whole; line dedup doesn't hide the others from near-dedup."""
    texts = []
    for g in range(20):
        base = prose(g, 150).split()
        for c in range(4):
            w = list(base)
            for k in range(c * (1 + g % 3)):
                w[(k * 37 + g) % len(w)] = f"new{c}{k}"
            texts.append((g * 10 + c, " ".join(w)))
    got = stages(spark, folder(spark, tmp_path, docs(spark, texts), [(i, 1, 0) for i, _ in texts]))
    left = {r.doc_id: r.text for r in got[2].collect()}
    assert set(left) >= {g * 10 for g in range(20)} and len(left) <= 23  # 95 % of the 60 copies
    assert all(left[i] == t for i, t in texts if i % 10 == 0)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Every stage but the packing on documents of sf0.001, by definition; near-dedup's candidates are approximate."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    sf = folder(spark, tmp_path, table, labels, bench)
    got = [{r.doc_id: r.text for r in t.collect()} for t in stages(spark, sf)]
    texts = {r.doc_id: r.text for r in table.collect()}
    ratio = quality_rules.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    n, score = quality_rules.score_texts(pa.array(list(texts.values()), pa.string()), ratio)
    assert got[0] == {i: t for (i, t), k, s in zip(texts.items(), n, score) if k and round(s, 9) >= quality_rules.THRESHOLD}
    # Only runs of MIN_WORDS words are deleted; a document that has one goes whole if more than MOST of its words is covered.
    runs = runs_by_brute_force(sorted(got[0].items()))
    cut = {i for i, n in runs.items() if max(n) >= lines.MIN_WORDS}
    words = {i: lines.Lines(pa.array([t], pa.large_string())).words.sum() for i, t in got[0].items()}
    assert set(got[0]) - set(got[1]) == {i for i in cut if sum(runs[i]) > lines.MOST * words[i]}
    assert {i for i, t in got[1].items() if t != got[0][i]} == cut & set(got[1])

    def shingles(t):
        w = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", t.lower())
        return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t in got[1].items()}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= minhash.THRESHOLD * len(sets[a] | sets[b])}
    gone = set(got[1]) - set(got[2])
    assert gone <= {b for _, b in near} and sum(b in gone or a in gone for a, b in near) >= 0.9 * len(near)
    index = decontam.Index(bench)
    found = {i for i, t in got[2].items() if len(index.search([decontam.plain(t)])[0])}
    assert set(got[3]) == set(got[2]) - found and all(got[3][i] == got[2][i] for i in got[3])


def test_pipeline_messy_and_empty(spark, tmp_path):
    back, _ = sequences(corpus_pipeline.run(spark, folder(spark, tmp_path / "messy", messy(spark), [(5, 1, 0)])))
    assert set(back) == {None, 4, 5, 7, 8} and len(back[5]) == 2
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "empty", docs(spark, []))).count() == 0
