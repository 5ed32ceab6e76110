"""The driver's contract, and the catalogue against DuckDB on the smallest tables."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from framesieve.__main__ import main
from framesieve.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = os.path.join(SF, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_catalogue(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.oracle_sql():
        want = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "part" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_llm_operators():
    code = "import sys; import framesieve.plans.catalog, framesieve.plans.session, framesieve.__main__; print(any('framesieve.llm' in m for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert out.stdout.strip() == "False", out.stderr


def test_command_line(tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert main(["config", "init"]) == 0
    with pytest.raises(FileExistsError):
        main(["config", "init"])
    main(["config", "init", "--force"])
    main(["config", "show"])
    assert json.loads(capsys.readouterr().out)["config"] == {"startMode": "manual"}
    main(["recover", str(tmp_path)])
    assert json.loads(capsys.readouterr().out)["discovered"] == 0


def test_channel_parts_cover_the_whole_table(spark):
    """32 frames of two channels a vector, none left out, and no part of more than 4096."""
    got = catalog.queries()["channel_sample_parts"](spark, SF).collect()
    frames = 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert frames > 1600 and {c: sum(r.n for r in got if r.channel == c) for c in (0, 1)} == {0: frames, 1: frames}
    assert max(r.n for r in got) <= 4096
