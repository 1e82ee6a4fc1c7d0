"""Values at a border, where one rounding more decides."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from readweave import plans
from readweave.operators import leftovers as lo
from readweave.registry import ORACLES, QUERIES

plans.load()


def test_run_of_exactly_the_share_is_not_longer(spark):
    """63 of 90 bases are 0.7 of them, though 0.7 * 90 is below 63 in double precision."""
    exact, more = ("C" * 20 + "AAAAACCCAA" * 8 + last for last in ("AACCCAAAAA", "AACCAAAAAA"))
    rows = [(i, s + "C" * 30, f"{len(s)}S30M") for i, s in enumerate((exact, more))]
    run = spark.createDataFrame([(exact,)], "s string").select(lo.best_run(F.col("s"), "A").alias("r")).first()["r"]
    assert (run["n"], run["last"] - run["first"]) == (63, 90)
    got = lo.split_internal_polya(spark.createDataFrame(rows, "id int, seq string, cigar string"), "id", 8, 6, 0.7).collect()
    assert {r["read_id"]: r["seq"] for r in got} == {"0": rows[0][1], "1.L": more, "1.R": "C" * 30}


def test_qualities_are_multiplied_in_double_precision(spark, tmp_path):
    """A component just below 0.18 has 17 whole hundredths; a product in single precision is rounded up to 18."""
    near = [0.17999999225139618, -0.17999999225139618, 0.18000000715255737, 0.5]
    pq.write_table(pa.table({"vec_id": pa.array([1]), "embedding": pa.array([near], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = {(r["x"], r["n"]) for r in QUERIES["quality_profile"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert got == set(con.execute(ORACLES["quality_profile"]).fetchall()) == {(17, 2), (18, 1), (50, 1)}
