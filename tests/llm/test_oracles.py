import os

import duckdb
import pytest

from quern.llm import queries

SF = "/root/testdata/sf0.001"


def check(spark, name, con, folder):
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = queries.queries()[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    check(spark, name, con, SF)


def test_licences_with_lines_and_inheritance(spark, tmp_path):
    texts = [
        "MIT License\n\nCopyright (c) zyx\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software", "plain words\r\nSPDX-License-Identifier: ISC \rmore words of it",
        "nothing here", "", None, "Licensed under CC BY-SA 4.0.", "one\n \t\nReleased under the MIT License.\nand a line below it\n\ntwo", "a licence to print money",
    ]
    rows = [(1000 * (i // 4) + i, t, None if i == 3 else "en", f"s{i % 2}") for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    check(spark, "op8_licences", con, tmp_path)
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() == len(rows)
