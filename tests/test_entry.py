import re

import __spark_entry__ as entry


def test_every_expected_result_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 55


def test_flagship(spark):
    rows = {r.lang: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"es", "fr", "de"} and all(0 < r.coverage < 1 for r in rows.values())


def test_nothing_else_needs_the_corpus_operators():
    """No module outside the subpackage names it."""
    from pathlib import Path

    root = Path(__file__).parent.parent
    for p in (root / "wordloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text())
