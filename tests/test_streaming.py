"""Row rules on a stream give the rows they give on the table."""

from plumbline.operators import rules as rule_ops
from plumbline.streaming import checks as stream_checks
from queries.checking import ROW_RULES
from queries.predicates import lines


def test_violations_of_a_stream(spark, sf_dir, tmp_path):
    batch = lines(spark, sf_dir)
    source = str(tmp_path / "lines")
    batch.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(source)
    out, checkpoint = str(tmp_path / "bad"), str(tmp_path / "checkpoint")
    for _ in range(2):  # a restart reads nothing twice
        stream_checks.write_violations(stream, ROW_RULES, out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    want = rule_ops.failing_rules(batch, ROW_RULES).where("size(failed) > 0")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
