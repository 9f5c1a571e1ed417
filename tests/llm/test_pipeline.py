import corpus_pipeline as p
import pytest

from skein.llm import exact_dedup, minhash, mixing, packing, quality_model


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory, make):
    import random

    rng = random.Random(8)
    syl = ["th", "er", "on", "an", "re", "he", "in", "st"]
    prose = lambda n: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."
    rows = [(i, prose(rng.randrange(60, 300)), "en", f"s{i % 4}") for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(20)]
    rows += [(300 + i, rows[i][1] + " tail", "en", "s2") for i in range(20)]
    rows += [(400 + i, "### ".join(prose(80).split()), "en", "s3") for i in range(30)] + [(500, None, None, None), (501, "", "en", "s1")]
    d = tmp_path_factory.mktemp("sf")
    make(rows).drop("kept", "words").write.parquet(str(d / "documents.parquet"))
    labels = [(i, int(i < 400)) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_stages_do_what_their_operators_say(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    labels = spark.read.parquet(f"{table}/labels.parquet")
    judged = [
        lambda x: quality_model.classify(x, labels).where("kept"), lambda x: exact_dedup.dedup(x).where("kept"),
        lambda x: minhash.near_dedup(x, k=5).where("kept"), lambda x: mixing.mix(x).where("selected"),
    ]
    for (name, stage), verdict in zip(p.STAGES, judged):
        want = {r[0] for r in verdict(docs).select("doc_id").collect()}
        out = stage(spark, docs, table)
        assert out.columns == p.COLUMNS, name
        assert {r[0] for r in out.select("doc_id").collect()} == want, name
        docs = p.materialize(out, name)
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert not ids & set(range(200, 220)) and not ids & set(range(300, 320)) and not ids & set(range(400, 430))
    packed = p.run(spark, table).collect()
    assert {r["doc_id"] for r in packed} == ids
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(r["length"] for r in packed) // packing.CAPACITY) + 1


@pytest.fixture
def small(spark, tmp_path, make):
    """A table of documents, written and read as the stages get it."""

    def of(rows):
        make(rows).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        return spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)

    return of


def test_verdicts_belong_to_rows(spark, small):
    """Repeated and null ids: one row of each group of texts stays, and no other text is lost."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "dup text"), (5, "only copy of A"), (5, "dup text"), (7, "same"), (7, "same"), (None, "none"), (None, "none"), (None, "dup text"), (8, None), (9, ""), (2, words + " x"), (None, words + " y"), (3, words)]
    docs, d = small(rows)
    for name, stage in p.STAGES[1:3]:
        docs = p.materialize(stage(spark, docs, d), name)
        assert docs.columns == p.COLUMNS
        left = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        if name == "exact_dedup":
            assert left == sorted([(1, "dup text"), (5, "only copy of A"), (7, "same"), (None, "none"), (8, None), (2, words + " x"), (None, words + " y"), (3, words)], key=str)
    assert left == sorted([(1, "dup text"), (5, "only copy of A"), (7, "same"), (None, "none"), (8, None), (2, words + " x")], key=str)


def test_every_stage_takes_nothing(spark, small):
    docs, d = small([])
    for _, stage in p.STAGES:
        assert stage(spark, docs, d).count() == 0
    assert p.run(spark, d).count() == 0


def test_frames_that_are_not_read_from_files(spark, make, small):
    """A stage also takes a made frame; columns with clashing names are dropped."""
    _, d = small([])
    docs = make([(1, "a b c"), (2, "a b c"), (3, "other")])
    assert sorted(r["doc_id"] for r in p.exact_duplicates(spark, docs, d).collect()) == [1, 3]
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, d).collect()) == [1, 3]
    assert p.quality_classifier(spark, docs, d).count() == 3


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(e.oracle_sql()) <= names
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES][0] == "quality_classifier"
