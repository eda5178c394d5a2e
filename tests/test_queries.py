import duckdb
import pytest

from polyweave.plans import queries as Q


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_against_sql(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name not in Q.ORACLES:
        assert got
        return
    assert sorted(con.sql(Q.ORACLES[name]).columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(tuple(map(str, r)) for r in con.sql(f"select {names} from ({Q.ORACLES[name]})").fetchall())


def test_mean_pool_signs_and_halves(spark, tmp_path):
    """Means that round to zero keep their sign, halves go away from it, as in SQL."""
    values = (-1e-7, -0.0, 1e-7, 0.0000005, -0.0000005, 0.0234375, -1.0000015, 3e7)
    spark.createDataFrame([(k, [v] * 64, 0) for k in range(1, 4) for v in values[k - 1 :: 3]], "vec_id long, embedding array<float>, label int").selectExpr("monotonically_increasing_id() * 9 + vec_id as vec_id", "embedding", "label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r.vec_id, str(r.pooled)) for r in Q.QUERIES["q_mean_pool"](spark, str(tmp_path)).collect())
    assert got == sorted((k, str(v)) for k, v in con.sql(Q.ORACLES["q_mean_pool"]).fetchall()) and "-0.0," in str(got)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_split_strict", "q_split_buffered"])
def test_texts_are_cut_once(spark, sf, name):
    """The optimizer doesn't cut texts once more to filter them by the number of their sentences."""
    assert plan(Q.QUERIES[name](spark, sf)).count("regexp_extract_all(") == 1


def test_sentence_table_cuts_once(spark, sf):
    assert plan(Q.QUERIES["q_sentence_table"](spark, sf)).count("regexp_extract_all(") == 2  # the strict way and the buffered one, of which a row takes one


@pytest.mark.parametrize("name", ["q_weak_leading", "q_trailing_fragments"])
def test_parts_are_cut_once(spark, sf, name):
    """And not once more for each part."""
    assert plan(Q.QUERIES[name](spark, sf)).count("split(") == 1
