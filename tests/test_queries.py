import collections
import re
import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from tatterloom import queries
from tatterloom.operators import schemas


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(name, spark):
    oracle.same(queries.QUERIES[name], queries.SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(name, spark):
    assert queries.QUERIES[name](spark, oracle.SF).count() > 0


def test_clusters_of_known_names(spark):
    found = {frozenset(r.headers.split("|")): r for r in queries.header_clusters(spark, oracle.SF).collect()}
    for names in ({"Month", "mon", "місяць"}, {"City", "town", "місто"}, {"Age", "years"}):
        assert found[frozenset(names)].confidence >= 0.7 and not found[frozenset(names)].needs_review
    assert all(r.needs_review for names, r in found.items() if len(names) == 1)


def test_schemas_are_the_first_fits(spark):
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    orders = spark.read.parquet(f"{oracle.SF}/orders.parquet").selectExpr("o_orderkey AS ord", f"{queries.LINE} AS raw").orderBy("ord").collect()
    first, size = {}, collections.Counter()
    for ord_, raw in orders:
        if raw:
            names = [re.sub("[^a-z0-9_]", "", re.sub(r"\d+", "id", c).strip().lower().replace(" ", "_")) or "column" for c in raw.split(",")]
            founders = first.setdefault(len(names), [])
            fit = next((o for h, o in founders if ratio(h, "|".join(names)) >= schemas.HEADER_ALIKE), None)
            if fit is None:
                founders.append(("|".join(names), ord_))
            size[ord_ if fit is None else fit] += 1
    found = {r.schema_ord: r.blocks for r in queries.schema_cluster(spark, oracle.SF).collect()}
    assert found == size


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "tatterloom").mkdir()
    for part in root.joinpath("tatterloom").iterdir():
        if part.name != "llm":
            (tmp_path / "tatterloom" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not [k for k in n if k[:2] == 'op' and k[2].isdigit() or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
