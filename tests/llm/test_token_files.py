import numpy as np
import pytest

tokencount = pytest.importorskip("gristmill.llm.tokencount")


@pytest.mark.parametrize("width,eos", [(2, 50256), (4, 100_000)])
def test_flat_files_are_counted_across_blocks(spark, tmp_path, width, eos):
    rng = np.random.default_rng(width)
    want = {}
    for f in range(3):
        lengths = [int(x) for x in rng.integers(0, 40, 50)]
        tail = f * 3  # ids after the last separator are a document of their own
        flat = [x for n in lengths for x in (*rng.integers(0, eos, n), eos)] + [7] * tail
        np.array(flat, tokencount.id_type(width)).tofile(tmp_path / f"t{f}.bin")
        want |= {(f"t{f}.bin", i): n for i, n in enumerate(lengths + [tail] * (tail > 0))}
    (tmp_path / "empty.bin").touch()
    blocks = tokencount.read_token_files(spark, str(tmp_path), 16, width)
    got = {(r.file.rsplit("/", 1)[1], r.ordinal): r.n_tokens for r in tokencount.document_lengths(blocks, eos, width).collect()}
    assert got == want


def test_ids_of_other_widths_are_refused(spark):
    with pytest.raises(ValueError, match="2 or 4"):
        tokencount.read_token_files(spark, "/tmp", width=3)
