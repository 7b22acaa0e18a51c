"""Chunks leave a worker in parts, and texts reach it in small batches."""

from quern.operators import chunks
from quern.runtime import BATCH


def test_parts(spark, monkeypatch):
    rows = [(i, ("Word number %d. " % i) * 200) for i in range(40)] + [(40, None), (41, ""), (None, "a b. c d")]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    monkeypatch.setattr(chunks, "PART", 3000)
    made = chunks.chunk(spark.createDataFrame(rows, "doc_id int, text string"), chunks.cut_text)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH
    want = {(k, i, a, b, t[a:b]) for k, t in rows if t for i, (a, b) in enumerate(chunks.cut_text(t))}
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and len(got) == len(want) and made.schema["doc_id"].dataType.simpleString() == "int"
