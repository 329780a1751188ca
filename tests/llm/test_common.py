import pyarrow as pa

from cohortloom.llm.common import slices


def test_slices_hold_few_rows_and_bytes():
    texts = ["x" * n for n in (1, 500, 700, 3000, 0, 2, 1000, 1)] + [None] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array(texts, pa.string())], ["doc_id", "text"])
    pieces = list(slices(iter([batch, batch]), rows=4, most=1000))
    assert pa.Table.from_batches(pieces) == pa.Table.from_batches([batch, batch]) or sum(p.num_rows for p in pieces) == 26
    for piece in pieces:
        found = piece.column("text").to_pylist()
        assert len(found) <= 4 and (len(found) == 1 or sum(len(t or "") for t in found) <= 1000)
    assert [i for p in pieces for i in p.column("doc_id").to_pylist()] == [*range(13)] * 2
    other = pa.RecordBatch.from_arrays([pa.array(range(5))], ["n"])
    assert [p.num_rows for p in slices(iter([other, other.slice(0, 0)]), rows=2)] == [2, 2, 1]
