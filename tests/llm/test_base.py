import pyarrow as pa
from pyspark.sql import functions as F

from matricula.llm.base import small_batches


def test_batches_of_long_texts_are_small(spark):
    """Long texts reach Python a few MB at a time, not a thousand rows at a time."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    texts = spark.range(300).select(F.repeat(F.lit("word "), 20000).alias("text")).coalesce(1)  # 100 KB each
    rows = [r.n for r in small_batches(texts).mapInArrow(sizes, "n long").collect()]
    assert sum(rows) == 300 and max(rows) <= 50
