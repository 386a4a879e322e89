from tidemill.llm.common import bound_batches

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_where_nobody_set_a_size(spark):
    other = spark.newSession()
    bound_batches(other)
    assert other.conf.get(CONF) == "8MB"


def test_a_size_that_was_set_stays(spark):
    other = spark.newSession()
    other.conf.set(CONF, "16MB")
    bound_batches(other)
    assert other.conf.get(CONF) == "16MB"
