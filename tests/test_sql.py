import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

import __spark_entry__ as entry
from trigrove.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
NOTHING = {"lookup_nothing", "lookup_number_is_ignored"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows_as_sql(spark, name):
    n = compare(spark, queries()[name], oracle_sql()[name], SF)
    assert n or name in NOTHING or name == "fuzzy_with_keyword_filter"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and {"_doc_id", "_score", "_rank"} <= set(df.columns)
    assert set(queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """Neither corpus_pipeline nor the subpackage there: the searches are."""
    top = Path(entry.__file__).parent
    (tmp_path / "trigrove").mkdir()
    for p in (top / "trigrove").iterdir():
        if p.name != "llm":
            (tmp_path / "trigrove" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((top / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert said.stdout.split() == [str(len(queries())), "False", str(len(oracle_sql()))]
