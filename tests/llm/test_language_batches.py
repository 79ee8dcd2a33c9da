"""Language identification turns a bounded number of texts of a batch into Python strings at a time."""

import pyarrow as pa
import pytest

pytest.importorskip("zstandard")
from cohortry.llm import language_id

CONTENT = {"de": b"der die das und ist nicht ein eine mit von zu haben " * 20, "en": b"the and is not a with of to have you that it " * 20}


def test_batches_are_cut(spark, monkeypatch):
    rows = [(i, "the house is not with you " * (i % 3)) for i in range(600)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    functions, planned = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *rest: functions.append(f) or planned(df, f, *rest))
    model = language_id.Identifier(CONTENT)
    wanted = [(i, t, *model.predict(t)) for i, t in rows]
    assert [tuple(r) for r in language_id.identify(docs, CONTENT).collect()] == wanted
    whole = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    cut = list(functions[0](iter([whole])))
    assert max(b.num_rows for b in cut) <= 256
    assert [tuple(r.values()) for b in cut for r in b.to_pylist()] == wanted
