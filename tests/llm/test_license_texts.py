import pathlib
import random
import textwrap

import pytest

licenses = pytest.importorskip("gristmill.llm.licenses")
KNOWN = licenses._known(licenses.SENTENCES)
FILLER = "Some other words stand here. They are of no licence at all.\n\nfor x in range(9): print(x)"


def scan(text):
    return [(m[0], m[1]) for m in licenses.scan_text(text, KNOWN, licenses.RULES, 2)]


@pytest.mark.parametrize("rule", licenses.RULES, ids=lambda r: r[0])
def test_every_rule_is_found_however_its_text_is_wrapped_and_marked(rule):
    name, licence, ids = rule
    rng = random.Random(name)
    for prefix in ("", "# ", " * ", "// ", "; ", "> ", "<!-- ", "% ", "    ", "-" * 30 + " "):
        width = rng.randint(40, 120) + len(prefix)
        parts = [textwrap.wrap(licenses.SENTENCES[i], width, break_long_words=False, break_on_hyphens=False) for i in ids]
        gap = rng.choice([[""], ["", "Foreign words here.", ""]])
        lines = [x for part in parts for x in (*part, *gap)]
        text = FILLER + "\n\n" + "\n".join(prefix + x for x in lines) + "\n\n" + FILLER
        assert scan(text) == [(licence, name)], prefix


def test_numbered_conditions_and_whole_texts():
    text = "\n".join(["{}", "", "1. {}", "2. {}", "3. {}", "", "{}"]).format(*(licenses.SENTENCES[f"bsd-{i}"] for i in range(1, 6)))
    assert scan(text) == [("BSD-3-Clause", "bsd3-whole")]
    two = "\n".join(["{}", "", "1. {}", "2. {}", "", "{}"]).format(*(licenses.SENTENCES[f"bsd-{i}"] for i in (1, 2, 3, 5)))
    assert scan(two + "\n\n" + text) == [("BSD-2-Clause", "bsd2-whole"), ("BSD-3-Clause", "bsd3-whole")]


def test_documents_hold_what_a_search_of_the_whole_normalised_text_finds(spark):
    sf = pathlib.Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no driver tables")
    single = {licenses.normalise(licenses.SENTENCES[r[2][0]]): r[1] for r in licenses.RULES if len(r[2]) == 1}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        whole = f" {licenses.normalise(r.text or '')} "
        want |= {(r.doc_id, licence) for sentence, licence in single.items() if f" {sentence} " in whole}
    got = {(r.doc_id, r.license) for r in licenses.op9_license_scan(spark, str(sf)).collect()}
    assert got == want and want
