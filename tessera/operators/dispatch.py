"""The callable surface: operators by name, with typed comma-list arguments, and action records.

``run("CorrelationAnalysis", df, "a,b,spearman")`` parses the text against the tool's argument
list (columns must exist, choices must be known) and returns the operator's DataFrame.
``run_actions`` runs structured records {module, params} in order, each as its operator's Spark
job, and logs one row a record; a record that fails does not stop the others. Replies and charts are
not drawn here: a tool's answer is its table. Arguments (names of columns, numbers) are small by
nature; tables stay distributed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chartdata, clean, models, profile, scorecard, stats


@dataclass(frozen=True)
class Arg:
    """kind: column, columns (the rest of the list), choice, or text (the whole input)."""
    name: str
    kind: str = "column"
    choices: tuple[str, ...] = ()
    default: str | None = None
    least: int = 0


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    args: tuple[Arg, ...] = ()

    @property
    def usage(self) -> str:
        show = {"columns": "{0}1,{0}2,...", "choice": "[{0}]"}
        return ",".join(show.get(a.kind, "[{0}]" if a.default == "" else "{0}").format(a.name) for a in self.args) or "(no argument)"


def _ttest(df: DataFrame, column1: str, column2: str = "") -> DataFrame:
    return stats.ttest_ind(df, column1, column2) if column2 else stats.ttest_1samp(df, column1)


#: fixed values: the tools' names
TOOLS: dict[str, Tool] = {
    "LoadData": Tool(lambda df, path: _load(df, path), (Arg("path", "text"),)),
    "DescriptiveStatistics": Tool(lambda df: profile.describe_numeric(df)),
    "HandleMissingValues": Tool(lambda df, strategy, columns: clean.fill_missing(df, strategy, columns or None),
                                (Arg("strategy", "choice", ("mean", "median", "mode", "drop"), "mean"), Arg("columns", "columns"))),
    "TTest": Tool(_ttest, (Arg("column1"), Arg("column2", default=""))),
    "LinearRegression": Tool(lambda df, target, features: stats.ols(df, target, features)[0], (Arg("target"), Arg("features", "columns", least=1))),
    "ChiSquareTest": Tool(stats.chi_square, (Arg("a"), Arg("b"))),
    "ANOVA": Tool(stats.anova, (Arg("group"), Arg("value"))),
    "CorrelationAnalysis": Tool(stats.correlation, (Arg("cols", "columns", least=2), Arg("method", "choice", ("pearson", "spearman", "kendall"), "pearson"))),
}


def _load(df: DataFrame, path: str) -> DataFrame:
    from ..sources.readers import read_table
    return read_table(df.sparkSession, path)


def parse(name: str, text: str, columns: Sequence[str]) -> dict:
    """Arguments of a tool from a comma list; ValueError tells what is wrong and the usage."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool '{name}'; choose from {sorted(TOOLS)}")
    tool, out = TOOLS[name], {}

    def wrong(why: str) -> ValueError:
        return ValueError(f"{name}: {why}; usage: {tool.usage}")

    if [a.kind for a in tool.args] == ["text"]:
        if not text.strip():
            raise wrong("an argument is missing")
        return {tool.args[0].name: text.strip()}
    parts = [p.strip() for p in text.split(",") if p.strip()] if tool.args else []
    args = list(tool.args)
    if args and args[-1].kind == "choice":  # a choice at the end may be left out
        last = args.pop()
        out[last.name] = parts.pop() if parts and parts[-1] in last.choices else last.default
    for a in args:
        if a.kind == "columns":
            out[a.name], parts = parts, []
            if len(out[a.name]) < a.least:
                raise wrong(f"{a.least} or more columns are needed for '{a.name}'")
        elif parts:
            out[a.name] = parts.pop(0)
        elif a.default is not None:
            out[a.name] = a.default
        else:
            raise wrong(f"'{a.name}' is missing")
        if a.kind == "choice" and out[a.name] not in a.choices:
            raise wrong(f"'{out[a.name]}' is none of {', '.join(a.choices)}")
        named = out[a.name] if a.kind == "columns" else [out[a.name]] if a.kind == "column" and out[a.name] else []
        if unknown := [c for c in named if c not in columns]:
            raise wrong(f"no column {', '.join(unknown)}")
    if parts:
        raise wrong(f"too many arguments: {', '.join(parts)}")
    return out


def run(name: str, df: DataFrame, text: str = "") -> DataFrame:
    args = parse(name, text, df.columns)
    return TOOLS[name].run(df, **args)


def _statistics(df: DataFrame, analysis_type: str = "describe", target_columns: Sequence[str] = (), method: str = "pearson") -> DataFrame:
    cols = list(target_columns)
    need = {"t_test": 1, "chi_square": 2, "anova": 2, "correlation": 2, "regression": 2}.get(analysis_type, 0)
    if len(cols) < need:
        raise ValueError(f"{analysis_type} needs {need} columns")
    calls = {"describe": lambda: profile.describe_numeric(df, cols or None), "t_test": lambda: _ttest(df, *cols[:2]),
             "chi_square": lambda: stats.chi_square(df, *cols[:2]), "anova": lambda: stats.anova(df, *cols[:2]),
             "correlation": lambda: stats.correlation(df, cols, method), "regression": lambda: stats.ols(df, cols[0], cols[1:])[0]}
    if analysis_type not in calls:
        raise ValueError(f"unknown analysis '{analysis_type}'; choose from {sorted(calls)}")
    return calls[analysis_type]()


def _ml(df: DataFrame, target_col: str, key: str, model_name: str = "random_forest", task_type: str = "classification",
        feature_cols: Sequence[str] = ()) -> DataFrame:
    """Scores of a model on a held-out fifth; features default to all other columns, numbers and the rest."""
    used = list(feature_cols) or [c for c in df.columns if c not in (target_col, key)]
    numbers = [c for c in used if df.schema[c].dataType.typeName() in ("long", "integer", "double", "float", "short", "byte") or df.schema[c].dataType.typeName().startswith("decimal")]
    rest = [c for c in used if c not in numbers]
    rows = models.prepare_data(df, numbers, rest, target_col, key, task_type)
    return models.compare_models(task_type, rows.where("split = 'train'"), rows.where("split = 'test'"), numbers, rest, target_col, [model_name])


def _chart(df: DataFrame, chart_type: str = "scatter", x_col: str | None = None, y_col: str | None = None, color_col: str | None = None) -> DataFrame:
    from .smooth import density_curve, lowess
    calls = {"scatter": lambda: chartdata.scatter_trend(df, x_col, y_col, color_col), "lowess": lambda: lowess(df, x_col, y_col),
             "box": lambda: chartdata.box_stats(df, y_col or x_col, x_col if y_col else None),
             "histogram": lambda: profile.histogram(df, x_col, group=color_col), "density": lambda: density_curve(df, x_col, color_col),
             "bar": lambda: profile.value_counts(df, x_col, None), "heatmap": lambda: stats.correlation(df)}
    if chart_type not in calls:
        raise ValueError(f"unknown chart '{chart_type}'; choose from {sorted(calls)}")
    if chart_type != "heatmap" and x_col is None or chart_type in ("scatter", "lowess") and y_col is None:
        raise ValueError(f"{chart_type}: columns are missing")
    return calls[chart_type]()


#: modules of action records and their operators
MODULES: dict[str, Callable[..., DataFrame]] = {
    "statistics": _statistics, "ml": _ml, "visualization": _chart, "variable_analysis": lambda df: profile.column_overview(df),
    "data_preview": lambda df, n=10: df.limit(int(n)),
    "psi_monitoring": lambda df, split, columns=(): scorecard.psi_report(df.where(F.expr(split)), df.where(~F.expr(split)), list(columns) or None),
}


def run_action(df: DataFrame, module: str, params: dict | str | None = None) -> DataFrame:
    """One action record: parameters as a dict or a JSON object."""
    if module not in MODULES:
        raise ValueError(f"unknown module '{module}'; choose from {sorted(MODULES)}")
    params = json.loads(params) if isinstance(params, str) else dict(params or {})
    if not isinstance(params, dict):
        raise ValueError("parameters must be an object")
    try:
        return MODULES[module](df, **params)
    except TypeError as e:
        raise ValueError(f"{module}: {e}") from e


def run_actions(df: DataFrame, actions: Sequence[tuple[str, dict | str | None]], save_to: str | None = None) -> DataFrame:
    """Run records in order; one row each: step, module, params (JSON), status, rows, error. ``save_to``: a folder in which
    every result is kept as Parquet, by step."""
    log = []
    for step, (module, params) in enumerate(actions):
        shown = params if isinstance(params, str) else json.dumps(params or {}, sort_keys=True)
        try:
            out = run_action(df, module, params)
            if save_to:
                out.write.mode("overwrite").parquet(f"{save_to}/step={step}")
                out = df.sparkSession.read.parquet(f"{save_to}/step={step}")
            log.append((step, module, shown, "ok", out.count(), None))
        except Exception as e:  # noqa: BLE001 - the record says what went wrong
            log.append((step, module, shown, "failed", None, str(e)[:500]))
    return df.sparkSession.createDataFrame(log, "step int, module string, params string, status string, rows long, error string")
