"""op9: ids are decoded a column at a time, with the results of the decoding row by row."""

import pyarrow as pa
import pytest
import public_tokenizers

from tickwise.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_columns_decode_like_rows(monkeypatch):
    rows = [[1, 2, 300], None, [], [40_000] * 5, *[[i, i + 7] for i in range(600)]]
    want = [b"" if r is None else bpe.decode_ids(r, PATH) for r in rows]
    monkeypatch.setattr(bpe, "decode_ids", None)       # before: a call for every row
    column = pa.array(rows, pa.list_(pa.int32()))
    assert bpe.decode_lists(column, PATH).to_pylist() == want
    assert bpe.decode_lists(column.slice(3, 300), PATH).to_pylist() == want[3:303]
    assert bpe.decode_lists(column.slice(0, 0), PATH).to_pylist() == []
    for bad in ([10_000_000], [None]):
        with pytest.raises((IndexError, ValueError)):
            bpe.decode_lists(pa.array([bad], pa.list_(pa.int32())), PATH)
