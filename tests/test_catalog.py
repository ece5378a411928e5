import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from castline.plans import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def names_without(tmp_path, lost, code=""):
    """The names of the queries of a copy of the repository from which some paths are gone."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for path in lost:
        shutil.rmtree(copy / path) if (copy / path).is_dir() else (copy / path).unlink()
    run = f"{code}\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    done = subprocess.run([sys.executable, "-c", run], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    return done.returncode, set(done.stdout.split())


@pytest.mark.parametrize("lost", [("castline/llm", "tests/llm"), ("castline/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, lost):
    if not all((Path(__file__).resolve().parent.parent / path).exists() for path in lost):
        pytest.skip("it is gone already")
    assert names_without(tmp_path, lost) == (0, set(catalog.QUERIES))


def test_entry_without_a_third_party_module(tmp_path):
    import __spark_entry__ as e

    code, names = names_without(tmp_path, (), "import sys\nsys.modules['xxhash'] = None")
    assert code == 0 and set(catalog.QUERIES) <= names <= set(e.queries())


def test_entry_with_a_broken_subpackage(tmp_path):
    path = Path(__file__).resolve().parent.parent / "castline/llm/components.py"
    if path.exists():
        assert names_without(tmp_path, ("castline/llm/components.py",))[0] != 0
