import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_and_modules():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p3_found", "p4_found", "p5_found", "p6_found"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_optional_package():
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent / "siltstone"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path
