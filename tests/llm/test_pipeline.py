"""The pipeline against its stages done plainly, one after the other."""

import corpus_pipeline as pipeline
from fixtures import SF, contaminated, edge, near_duplicate_classes

from curatorium.llm import pieces, quality, registry, secrets, store
from tools.check import connect

registry.load_all()


def test_rows_equal_plain_stages(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cur = connect(SF).execute(quality.ORACLE)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    good = [r[at["doc_id"]] for r in cur.fetchall() if r[at["kept"]]]
    classes = near_duplicate_classes([(i, docs[i]["text"]) for i in good])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [i for i in good if classes[i] == i and not contaminated(docs[i]["text"], items)]
    encode = pieces.encoder(pieces.vocabulary())
    want = {i: encode(secrets.mask(docs[i]["text"], secrets.scan(docs[i]["text"]))).tolist() for i in kept}
    got = pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want)
    assert all(r["n_pieces"] == len(r["ids"]) and r["lang"] == docs[r["doc_id"]]["lang"] for r in got)


def test_stages_keep_columns_on_awkward_rows(spark):
    store.ship(spark)
    for name, stage in pipeline.STAGES[:-1]:
        for rows in (edge(spark), edge(spark).limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
    assert pipeline.STAGES[-1][1](spark, edge(spark), SF).count() == edge(spark).count()


def test_one_row_of_each_group_stays(spark):
    kept = pipeline.near_dedup(spark, edge(spark), SF).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(8) == 0 and ids.count(7) == 1 and ids.count(None) == 2 and {1, 2, 3, 4, 5} <= set(ids)


def test_texts_of_one_id_are_decided_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(7, a), (8, a), (8, b), (8, b), (None, b), (9, a + " more"), (7, a)], "doc_id long, text string")
    store.ship(spark)
    assert sorted(pipeline.near_dedup(spark, docs, SF).collect(), key=str) == sorted([(7, a), (8, b), (None, b)], key=str)


def test_columns_named_like_those_in_use(spark):
    """Columns with the names that stages use inside stay as they are; repeated rows and masked texts among them."""
    store.ship(spark)
    names = ["doc", "key", "text_key", "again", "slot", "kept", "spans", "redacted", "others", "body", "broken", "place", "label", "words", "c0"]
    text = " ".join(f"the word{i} of" for i in range(60)) + ' db_pwd = "Zx81kd9Qm"'
    rows = [(1, text, *names), (1, text, *names), (2, text, *names), (3, None, *names), (None, "short", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all([r[n] for n in names] == names for r in found), name
    assert len(pipeline.near_dedup(spark, docs, SF).collect()) == 3
    assert "Zx81kd9Qm" not in str(pipeline.secret_scan(spark, docs, SF).collect())
    assert pipeline.STAGES[-1][1](spark, docs.selectExpr("*", "'en' as lang", "'s' as source"), SF).count() == 5
