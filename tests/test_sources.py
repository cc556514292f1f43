import pandas as pd
import pyarrow as pa

from barloom.sources import readers


def test_csv_types_and_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,x,x,,flag,word,n\n2024-01-01,1,1.5,a,true,NA,\n2024-01-02,2,nan,b,False,z,7\n2024-01-03,,2,c,,y,8\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), parse_dates=["day"])
    assert dict(df.dtypes) == {"day": "timestamp", "x": "bigint", "x.1": "double", "Unnamed: 3": "string", "flag": "boolean", "word": "string", "n": "bigint"}
    rows = df.orderBy("day").collect()
    assert [r["x"] for r in rows] == [1, 2, None] and [r["flag"] for r in rows] == [True, False, None] and rows[0]["word"] is None and [r["n"] for r in rows] == [None, 7, 8]


def test_csv_round_trip(spark, tmp_path):
    df = readers.from_dict(spark, {"a": [1, 2], "b": [0.5, None], "c": ["x", "y"]}, "a long, b double, c string")
    readers.write_csv(df, str(tmp_path / "out"), float_format="%.2f")
    back = readers.read_csv(spark, str(tmp_path / "out"), schema={"a": "long", "b": "double", "c": "string"})
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.5, "x"), (2, None, "y")]


def test_memory_sources(spark):
    assert readers.from_arrow(spark, pa.table({"a": [1, 2]})).count() == 2
    named = pd.DataFrame({"a": [1.0]}, index=pd.Index([5], name="ts"))
    frame = readers.bar_frame(readers.from_pandas(spark, named))
    assert frame.columns == ["ts", "a"] and frame.to_numpy(["a"]).tolist() == [[1.0]] and frame.to_arrow().num_rows == 1
