"""The token budget on all documents against brute force."""

import pathlib

import pytest

from gristmill import catalog

SF = pathlib.Path("/root/testdata/sf0.001")


def packed(text, most):
    if len(text.encode()) <= most:
        return text
    out = b""
    for line in text.removesuffix("\n").encode().split(b"\n"):
        if not out and len(line) > most:
            out = line[:most].decode("utf-8", "replace").encode()
            break
        if out and len(out) + 1 + len(line) > most:
            break
        out = out + b"\n" + line if out else line
    return out.decode().rstrip(" \t\n\v\f\r")


@pytest.mark.skipif(not SF.exists(), reason="no driver tables")
def test_all_documents_are_packed(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(SF / "documents.parquet")).collect()}
    got = catalog.QUERIES["token_budget_all"](spark, str(SF)).collect()
    assert {r.doc_id: (r.kept, r.tokens) for r in got} == {i: (k := packed(t, 400), max(1, -(-len(k.encode()) // 4))) for i, t in texts.items()}
    assert len(got) == len(texts) and any(len(t.split("\n")[0].encode()) > 400 for t in texts.values())
