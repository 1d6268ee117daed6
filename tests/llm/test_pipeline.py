"""All queries beside their SQL, and the stages on planted cases."""

import pytest

import __spark_entry__
import corpus_pipeline
from plumbline.llm.queries import ORACLES, QUERIES
from scripts.compare import duck, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).select("doc_id").collect()
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in want)


def test_entry_points_offer_the_queries():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert [f"op{n}_" for n in range(1, 14)] == sorted({q.split("_")[0] + "_" for q in QUERIES}, key=lambda q: int(q[2:-1]))


def test_stages_on_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    clean = "\n".join(" ".join(f"w{i}x{j}y" for j in range(20)) for i in range(6)).translate(str.maketrans("0123456789", "abcdefghij"))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 100").first().text
    junk = "### ".join(clean.split())
    planted = [
        (10_001, clean, "en", "src0"), (10_002, clean, "en", "src0"), (10_003, clean.replace("wax", "new", 1), "en", "src1"),
        (10_004, junk, "en", "src0"), (10_005, clean[::-1] + "\n" + item, "en", "src2"), (10_006, None, "en", "src0"), (10_007, "", None, None),
    ]
    docs = docs.unionByName(spark.createDataFrame([(*p, len(p[1] or "")) for p in planted], docs.schema))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left[name] = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
    first, lines, near, decontaminated, mixed = left.values()
    assert {10_001, 10_002, 10_003, 10_005} <= set(first)
    assert not {10_004, 10_006, 10_007} & set(first)
    assert lines[10_001].text == clean and set(lines) == set(first)
    assert {10_001, 10_002, 10_003} & set(near) == {10_001}
    assert 10_005 in near and 10_005 not in decontaminated and 10_001 in decontaminated
    assert set(mixed) <= set(decontaminated) and all(1 <= r.copies <= 3 for r in mixed.values())


def test_pipeline_runs_in_one_go(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
