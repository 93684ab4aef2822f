"""The pipeline's stages against the operators' own decisions, on planted rows."""

import random

import corpus_pipeline
from leafmill.llm import near_dup, weak_quality, wu_manber
from leafmill.tables import table


def planted():
    r = random.Random(12)
    v = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    prose = lambda n: [r.choice(v) + r.choice(["", "", "", ",", "."]) for _ in range(n)]
    passage = prose(20)
    rows = [(k, " ".join(prose(120))) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(300 + k, rows[10 + k][1] + " extra") for k in range(5)]  # near copies
    rows += [(400 + k, " ".join([*prose(60), *passage, *prose(60)])) for k in range(5)]  # benchmark passages
    rows += [(500 + k, " ".join(w + "###" for w in prose(90))) for k in range(30)]  # junk
    rows += [(600, " ".join(prose(60)) + " mail ann@x.example.com"), (601, None), (602, "")]
    return rows, [(1, " ".join(passage))]


def test_pipeline(spark, tmp_path):
    rows, items = planted()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    ids = set(out)
    assert set(range(150)) <= ids
    assert not ids & {*range(200, 205), *range(300, 305), *range(400, 405), *range(500, 530), 601, 602}
    assert out[600].text.endswith("mail <EMAIL>")
    assert len({(r.slot, r.place) for r in out.values()}) == len(out)

    docs = table(spark, str(tmp_path), "documents")
    docs = docs.join(weak_quality.classify(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    docs = docs.join(near_dup.components_of(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    clean = wu_manber.find_contamination(docs, table(spark, str(tmp_path), "benchmark")).where("not contaminated")
    assert {r.doc_id for r in clean.select("doc_id").collect()} == ids


def test_first_stage_drops_toxic_documents(spark, tmp_path):
    rows, _ = planted()
    rows += [(700 + k, rows[k][1].replace(" ", " idiot ", 2) + " Worthless scum!") for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert set(range(150)) <= ids
    assert not ids & set(range(700, 720))
