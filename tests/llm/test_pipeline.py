import random

import corpus_pipeline
import pytest

from stratagraph.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with planted cases: toxic texts, copies, repeated passages and a benchmark leak."""
    r = random.Random(9)
    plain, vile = ["w%d" % i for i in range(800)], ["scum%d" % i for i in range(6)]
    text = lambda n: [r.choice(plain) for _ in range(n)]
    docs, labels = [], []
    for i in range(300):
        t = text(r.randint(30, 120))
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(vile))
        docs.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    item = text(30)
    shared = text(60)
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, docs[1][1].upper(), "en", "s", 0), (1002, " ".join(text(20) + shared), "en", "s", 0), (1003, " ".join(text(25) + shared + text(9)), "en", "s", 0), (1004, " ".join(text(20) + item[3:20] + text(9)), "en", "s", 0), (1005, None, None, None, None), (1006, "", "en", "s", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "a b")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
    tox, near, sub, leak, packed = seen
    assert sum(i % 3 == 0 and i < 300 for i in tox) <= 5 and sum(i % 3 > 0 and i < 300 for i in tox) >= 195
    assert {1000, 1001}.isdisjoint(near) and {1, 1002, 1003, 1004} <= set(near)
    assert len(sub) == len(near) and len(sub[1003].text.split()) == 34 and sub[1003].n_chars == len(sub[1003].text)
    assert sub[1002].text == near[1002].text
    assert set(sub) - set(leak) == {1004}
    assert set(packed) == set(leak)


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(got.columns) and got.count() > 0


def test_run_on_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """No documents; then documents with columns named like the operators' own, no labels and no benchmark; folders are cleared."""
    import os

    text = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], text).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as n_words", "2 as sg_d", "3 as x", "4 as items", "text as t", "doc_id as d")
    docs.union(docs.where("doc_id = 1")).write.parquet(f"{tmp_path}/b/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").write.parquet(f"{tmp_path}/b/{t}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/b")
    ids = {r.doc_id for r in got.collect()}
    assert ids == {r.doc_id for r in docs.collect()} - {1000, 1001}
    from urllib.parse import urlparse

    left = urlparse(spark.sparkContext.getCheckpointDir()).path
    assert not [x for x in os.listdir(left) if x.startswith("table-")]


def test_other_frames_live_through_a_run(spark, folder):
    """Frames built before a run, on working tables of their own, still count after it."""
    sf = "/root/testdata/sf0.001"
    alive = {n: queries.QUERIES[n](spark, sf) for n in ("op2_jaccard_join", "op3_substring_dedup", "op4_nearest_neighbours", "op12_mix_sources")}
    corpus_pipeline.run(spark, folder)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {k: f.count() for k, f in alive.items() if k != "op4_nearest_neighbours"} == {"op2_jaccard_join": n, "op3_substring_dedup": n, "op12_mix_sources": n}
    assert alive["op4_nearest_neighbours"].count() > 0


def test_queries_have_their_columns(spark):
    want = {
        "op2_jaccard_join": ["doc_id", "n_shingles", "component_id", "class_id", "n_links"],
        "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op4_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
        "op6_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op9_html_text": ["page_id", "url", "text", "n_chars"],
        "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
        "op13_repair_conversations": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    }
    for n, cols in want.items():
        assert queries.QUERIES[n](spark, "/root/testdata/sf0.001").columns == cols, n
