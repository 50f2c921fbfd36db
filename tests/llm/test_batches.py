"""What a Python worker holds: batches bounded in bytes, words that are forgotten when a task ends."""

import pyarrow as pa
from pyspark.sql import functions as F

from sketchloom.llm.common import KNOWN_WORDS, per_batch
from sketchloom.llm.neardup import Shingler
from sketchloom.llm.quality import Featurizer
from sketchloom.shipping import BATCH_BYTES, tune


def test_long_texts_come_in_batches_of_bounded_bytes(spark):
    tune(spark)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    rows = per_batch(texts, sizes, "n long, bytes long").collect()
    assert sum(r[0] for r in rows) == 40
    assert max(r[1] for r in rows) <= BATCH_BYTES + (2 << 20)


def test_a_smaller_limit_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    tune(spark)
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1m")
        tune(spark)
        assert spark.conf.get(name) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.set(name, before)


class Caught:
    """In place of a table: gives the function that would run in a task."""

    def mapInArrow(self, run, schema):
        return run


def test_words_are_forgotten_when_a_task_ends():
    shingler = Shingler()
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f"])], names=["text"])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        shingler.shingles(b.column(0)[0].as_py())
        return b

    run = per_batch(Caught(), fn, "text string", shingler.known)
    made = run(iter([batch, batch]))
    next(made)
    assert len(shingler.known) == 6
    assert len(list(made)) == 1 and not shingler.known


def test_remembered_words_are_few():
    assert Shingler().most == Featurizer().most == KNOWN_WORDS <= 100_000
    small, large = Shingler(5), Shingler()
    for t in ("a b c d e f g h", "i j k l m n", "a b c d e x y"):
        assert small.shingles(t).tolist() == large.shingles(t).tolist()
