import pytest

from cadence.operators import runs

BIG = 2 ** 53 + 1


def _function(kind):
    """Nested, so that it is pickled by value: the workers cannot import tests."""
    import pandas as pd

    def frame(pdf):
        return pd.DataFrame({"user": [pdf["user"].iloc[0]], "run_id": [pdf["run_id"].iloc[0]], "ids": [",".join(str(int(i)) for i in pdf["id"])],
                             "total": [pdf["v"].fillna(0.0).sum()], "rows": [len(pdf)]})

    def arrays(run):
        assert isinstance(run, dict)
        return {"user": run["user"][0], "run_id": run["run_id"][0], "ids": ",".join(str(int(i)) for i in run["id"]),
                "total": float(pd.Series(run["v"]).fillna(0.0).sum()), "rows": len(run["id"])}

    return {"frame": frame, "arrays": arrays, "row": lambda pdf: frame(pdf).iloc[0].to_dict() | {"user": pdf["user"].iloc[0]}}[kind]


def _expected(rows):
    out, count = {}, {}
    for user in {r[1] for r in rows}:
        last = None
        for i, u, t, kind, v in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            if last is None or kind != last:
                count[user] = count.get(user, -1) + 1
            last = kind
            key = (user, count[user])
            ids, total, n = out.get(key, ("", 0.0, 0))
            out[key] = (f"{ids},{i}".strip(","), total + (v or 0.0), n + 1)
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("kind", ["frame", "arrays", "row"])
def test_each_run_comes_once_and_whole_in_order(spark, batch, kind):
    rows = [(i, user, i // 3, "ab"[(i // 11) % 2] if user != 3 else "a", None if i % 5 == 0 else float(i))
            for k, user in enumerate((1, 2, 3, None, BIG)) for i in range(k * 40, k * 40 + 40)]
    df = spark.createDataFrame(rows, "id long, user long, ts long, kind string, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = runs.custom_run_features(df, _function(kind), "user long, run_id long, ids string, total double, rows long", ["kind"],
                                         ["ts", "id"], partition_by=["user"], bucket=100, runs_per_group=2, arrays=kind == "arrays").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["user"], r["run_id"]): (r["ids"], r["total"], r["rows"]) for r in found} == _expected(rows)
    assert len(found) == len(_expected(rows)) > 12
