"""What a worker keeps from one task to the next."""

from quern.llm import bpe
from quern.llm.arrow import begin


class Shared:
    value = {bytes([i]): i for i in range(256)}


def test_coder_goes_when_another_operator_begins():
    from quern.llm import arrow

    shared = Shared()
    start = lambda: bpe.coder(shared, bpe.SPACED)
    first = begin(start)
    assert begin(start) is first  # from one task to the next
    begin(lambda: list)
    assert not arrow._KEPT and begin(start) is not first


def test_sample_holds_copies_once(spark):
    from quern.llm import ordinal

    rows = [(1, "one two two")] * 50 + [(2, "three four"), (2, "five"), (3, None)]
    docs, grades = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, grade int")
    features, y, _ = ordinal.sampled(docs, grades, "doc_id", "text")
    assert y.tolist() == [2, 0, 0, 1] and [len(f) for f in features] == [len(ordinal.Features().of_text(t)) for t in ("one two two", *sorted(("three four", "five"), key=lambda t: docs.where(docs.text == t).selectExpr("xxhash64(text)").first()[0]), None)]


def test_worker_gives_back_what_a_task_has_left_free(spark):
    """Large and small pieces by turns: what is left free lies between what stays."""
    import os

    import pyarrow as pa

    from quern.llm.arrow import tidy

    def held() -> int:
        with open(f"/proc/{os.getpid()}/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def run(batches):
        pieces = [bytes(range(256)) * 8 for _ in range(100_000)]
        stay.extend(pieces[::1000])
        yield from batches

    stay: list = []
    before = held()
    assert list(tidy(run)([pa.record_batch({"x": [1]})])) and held() - before < 100
