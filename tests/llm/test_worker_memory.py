import pyarrow as pa
from pyspark.sql import functions as F

from anchorage.llm import tokens
from anchorage.llm.common import frugal, ready
from anchorage.llm.queries import vocabulary


def test_arrow_batches_are_cut_by_bytes(spark):
    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    long = ready(spark).range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    got = long.mapInArrow(told, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 40 and max(r["bytes"] for r in got) < 10 << 20


def test_other_steps_do_not_keep_the_encoder_of_a_worker():
    def held(batches):
        yield from batches
        yield tokens.encoder.cache_info().currsize

    path = vocabulary("byte_bpe_50k.json")
    assert tokens.encoder(path) is tokens.encoder(path)
    assert list(held([])) == [1] and list(frugal(held)([])) == [0]
