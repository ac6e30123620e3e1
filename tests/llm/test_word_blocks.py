"""Blocks of text and the tables behind their hashes stay as small as asked; hashes do not hang on them."""

import numpy as np
import pyarrow as pa

from seqlab.llm import words as W


def test_small_blocks_keep_tables_small_and_hashes_equal():
    texts = [f"word{i} and others {i * i} " * (1 + i % 50) for i in range(4000)] + ["x " * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    hashes = {}
    for size in (W.SMALL_BLOCK_BYTES, W.BLOCK_BYTES):
        W._powers.clear()
        found, rows = [], 0
        for part, data, offsets in W.blocks(iter([batch]), size=size):
            assert len(data) <= size or part.num_rows == 1
            found.append(W.Words(data, offsets, W.NOT_SPACE).hashes())
            rows += part.num_rows
            if len(data) <= W.SMALL_BLOCK_BYTES:
                assert len(W._powers[0]) <= W.SMALL_BLOCK_BYTES + 1 or size == W.BLOCK_BYTES
        assert rows == len(texts)
        hashes[size] = np.concatenate(found)
    assert np.array_equal(*hashes.values())
