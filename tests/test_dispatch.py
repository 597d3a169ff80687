"""Tools by name and action records."""

import pytest

from tessera.operators import dispatch, stats


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, float(i % 7), float(i % 5) if i % 9 else None, "xy"[i % 2], "pqr"[i % 3]) for i in range(60)],
                                 "k long, a double, b double, g string, h string")


def test_arguments_are_typed():
    cols = ["a", "b", "g", "h"]
    assert dispatch.parse("CorrelationAnalysis", " a , b ,spearman", cols) == {"cols": ["a", "b"], "method": "spearman"}
    assert dispatch.parse("CorrelationAnalysis", "a,b", cols)["method"] == "pearson"
    assert dispatch.parse("HandleMissingValues", "median,a,b", cols) == {"strategy": "median", "columns": ["a", "b"]}
    assert dispatch.parse("TTest", "a", cols) == {"column1": "a", "column2": ""}
    assert dispatch.parse("LoadData", " /x,y/z.csv ", cols) == {"path": "/x,y/z.csv"}
    assert dispatch.parse("DescriptiveStatistics", "run", cols) == {}
    for name, text, why in [("ANOVA", "g", "missing"), ("ANOVA", "g,a,b", "too many"), ("TTest", "zz", "no column zz"), ("LinearRegression", "a", "1 or more"),
                            ("HandleMissingValues", "wild", "none of"), ("Nothing", "", "unknown tool"), ("CorrelationAnalysis", "a", "2 or more")]:
        with pytest.raises(ValueError, match=why):
            dispatch.parse(name, text, cols)


def test_tools_give_their_operators_tables(df, tmp_path):
    assert dispatch.run("CorrelationAnalysis", df, "a,b").collect() == stats.correlation(df, ["a", "b"]).collect()
    assert dispatch.run("HandleMissingValues", df, "mean,b").where("b IS NULL").isEmpty()
    assert [r["term"] for r in dispatch.run("LinearRegression", df, "a,b").collect()] == ["const", "b"]
    for name, text in [("TTest", "a,b"), ("TTest", "a"), ("ChiSquareTest", "g,h"), ("ANOVA", "g,a"), ("DescriptiveStatistics", "")]:
        assert dispatch.run(name, df, text).count() >= 1
    (tmp_path / "t.csv").write_text("p,q\n1,2\n")
    assert dispatch.run("LoadData", df, str(tmp_path / "t.csv")).collect()[0]["q"] == 2


def test_action_records(df, tmp_path):
    actions = [("statistics", {"analysis_type": "anova", "target_columns": ["g", "a"]}), ("statistics", '{"analysis_type": "t_test"}'),
               ("visualization", {"chart_type": "scatter", "x_col": "a", "y_col": "b"}), ("data_preview", {"n": 3}), ("nowhere", None),
               ("variable_analysis", None), ("visualization", {"colour": "red"}), ("statistics", "[1"),
               ("psi_monitoring", {"split": "k < 30", "columns": ["a"]}),
               ("ml", {"target_col": "g", "key": "k", "model_name": "naive_bayes", "feature_cols": ["a", "h"]})]
    log = dispatch.run_actions(df, actions, str(tmp_path)).orderBy("step").collect()
    assert [r["status"] for r in log] == ["ok", "failed", "ok", "ok", "failed", "ok", "failed", "failed", "ok", "ok"]
    assert log[3]["rows"] == 3 and log[5]["rows"] == 5 and "needs 1 columns" in log[1]["error"] and "unknown module" in log[4]["error"]
    assert df.sparkSession.read.parquet(f"{tmp_path}/step=3").count() == 3
