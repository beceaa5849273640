"""Python objects exist for a small part of an Arrow batch at a time."""

import pyarrow as pa
import pytest

from lexmill.functions import pieces
from lexmill.operators import chunking, structured


def test_slices_hold_few_rows_and_bytes():
    texts = ["x" * n for n in (5, 3_000_000, 0, 400_000, 700_000, 9) + (10,) * 500]
    cut = list(pieces.slices(iter([pa.record_batch({"t": texts}), pa.record_batch({"t": texts[:2]})])))
    assert [t for b in cut for t in b.column("t").to_pylist()] == texts + texts[:2]
    assert all(b.num_rows <= pieces.SLICE_ROWS and (b.num_rows == 1 or b.nbytes <= pieces.SLICE_BYTES) for b in cut)


@pytest.mark.parametrize("used", [chunking, structured])
def test_chunkers_cut_batches(used):
    assert used.slices is pieces.slices
