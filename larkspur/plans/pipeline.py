"""Versioned pipelines: named steps with alternatives, expanded to versions, each run in order with snapshots and a run log."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.files import checkpoint, restore


@dataclass(frozen=True)
class Step:
    """A step has alternatives by name: a Transformer, an Estimator, or a function of a DataFrame.

    source: "$step" or "#name" to read instead of the last result. frames: parameters that are DataFrames, by name, each of
    "$step" or "#name"; a function gets them by keyword, a stage as attributes. outputs: attributes of the fitted stage that are
    kept as results under "step.name". paths_to_log: parameters, also of stages within, such as "a.b.c", that the log shows.
    """

    name: str
    choices: Mapping[str, Any]
    source: str | None = None
    select: Sequence[str] | None = None
    drop: Sequence[str] = ()
    rename: Mapping[str, str] = field(default_factory=dict)
    repartition: int | None = None
    cache: bool = False
    snapshot: bool = False
    reuse_snapshot: bool = False
    frames: Mapping[str, str] = field(default_factory=dict)
    outputs: Sequence[str] = ()
    paths_to_log: Sequence[str] = ()
    show: bool = False


@dataclass(frozen=True)
class Version:
    """Which alternative each step runs."""

    choices: tuple[tuple[str, str], ...]
    note: str = ""
    params: tuple[tuple[str, Any], ...] = ()
    logs: tuple[tuple[str, Any], ...] = ()

    def step(self, name: str, choice: str) -> Version:
        return replace(self, choices=tuple((n, choice if n == name else c) for n, c in self.choices))

    def drop(self, name: str) -> Version:
        return replace(self, choices=tuple(x for x in self.choices if x[0] != name))

    def drop_after(self, name: str) -> Version:
        at = [n for n, _ in self.choices].index(name)
        return replace(self, choices=self.choices[: at + 1])

    def comment(self, note: str) -> Version:
        return replace(self, note=note)

    def set(self, **params: Any) -> Version:
        """With parameters of stages, "step.name" by a double underscore: step__name=value."""
        return replace(self, params=tuple({**dict(self.params), **params}.items()))

    def log(self, **values: Any) -> Version:
        """With values that the run's log shows."""
        return replace(self, logs=tuple({**dict(self.logs), **values}.items()))


@dataclass(frozen=True)
class Plan:
    """Turns a version into several."""

    turns: tuple[Callable[[Version], list[Version]], ...] = ()

    def set(self, name: str, choice: str) -> Plan:
        return Plan((*self.turns, lambda v: [v.step(name, choice)]))

    def switch(self, **choices: Sequence[str]) -> Plan:
        def every(v: Version) -> list[Version]:
            out = []
            for combination in product(*choices.values()):
                new = v
                for name, choice in zip(choices, combination, strict=True):
                    new = new.step(name, choice)
                out.append(new)
            return out

        return Plan((*self.turns, every))

    def repeat(self, n: int) -> Plan:
        return Plan((*self.turns, lambda v: [v.comment(f"{v.note} run {i}".strip()) for i in range(n)]))

    def log(self, note: str) -> Plan:
        """Runs so far have this note in their log."""
        return Plan((*self.turns, lambda v: [v.comment(note)]))

    def params(self, **params: Any) -> Plan:
        return Plan((*self.turns, lambda v: [v.set(**params)]))

    def merge(self, *others: Plan) -> Plan:
        return Plan((lambda v: [x for p in (self, *others) for x in p.build(v)],))

    def build(self, base: Version) -> list[Version]:
        out = [base]
        for turn in self.turns:
            out = [new for v in out for new in turn(v)]
        return out


class Pipeline:
    def __init__(self, name: str, steps: Sequence[Step], snapshot_path: str | None = None, log_path: str | None = None, group: str = "", project: str = "") -> None:
        self.name, self.steps, self.snapshots, self.logs, self.group, self.project = name, list(steps), snapshot_path, log_path, group, project

    def default(self) -> Version:
        """The first alternative of each step."""
        return Version(tuple((s.name, next(iter(s.choices))) for s in self.steps))

    def every(self) -> list[Version]:
        """All combinations of alternatives."""
        return Plan().switch(**{s.name: list(s.choices) for s in self.steps}).build(self.default())

    def version(self, **choices: str) -> Version:
        """The default with other choices; an unknown step or choice raises KeyError."""
        out = self.default()
        for name, choice in choices.items():
            (step,) = [s for s in self.steps if s.name == name] or [None]
            if step is None or choice not in step.choices:
                raise KeyError(f"{name}={choice}")
            out = out.step(name, choice)
        return out

    def show(self) -> str:
        return "\n".join(f"{s.name}: {', '.join(s.choices)}" for s in self.steps)

    def run(
        self, df: DataFrame, plan: Plan | None = None, base: Version | None = None, named: Mapping[str, DataFrame] | None = None, stop_after: str | None = None, outputs: Sequence[str] = (), log_on: bool = True, max_versions: int | None = None, show_steps: bool = False,
    ) -> list[tuple[Version, DataFrame, dict[str, DataFrame]]]:
        """(version, result, results of the steps named in outputs) for each version of plan, the first max_versions of them."""
        base = base or self.default()
        if stop_after:
            base = base.drop_after(stop_after)
        versions = (plan or Plan()).build(base)
        return [(v, *self._one(df, v, dict(named or {}), outputs, log_on, show_steps)) for v in versions[:max_versions]]

    def _one(self, df: DataFrame, version: Version, named: dict[str, DataFrame], outputs: Sequence[str], log_on: bool, show_steps: bool) -> tuple[DataFrame, dict[str, DataFrame]]:
        results, now, metrics, shown = {}, df, {}, {}
        chosen, params = dict(version.choices), dict(version.params)

        def found(name: str) -> DataFrame:
            return results[name[1:]] if name[0] == "$" else df if name == "#model" else named[name[1:]]

        for step in (s for s in self.steps if s.name in chosen):
            into = now if step.source is None else found(step.source)
            place = "/".join(filter(None, (self.snapshots, self.project, self.name, f"{step.name}-{chosen[step.name]}")))
            path = place if self.snapshots else None
            old = restore(df.sparkSession, path) if path and step.reuse_snapshot else None
            if old is None:
                action = step.choices[chosen[step.name]]
                frames = {k: found(v) for k, v in step.frames.items()}  # all of them, not the last alone
                own = {k.split("__", 1)[1]: v for k, v in params.items() if k.startswith(f"{step.name}__")}
                if hasattr(action, "transform") or hasattr(action, "fit"):
                    action = action.copy() if own and hasattr(action, "copy") else action
                    for k, v in {**frames, **own}.items():
                        _set(action, k.split("__"), v)
                    fitted = action.fit(into) if hasattr(action, "fit") else action
                    out = fitted.transform(into)
                else:
                    fitted, out = action, action(into, **frames, **own)
                metrics |= {f"{step.name}.{k}": v for k, v in getattr(fitted, "metrics", {}).items()}
                shown |= {f"{step.name}.{p}": _get(fitted, p.split(".")) for p in step.paths_to_log}
                results |= {f"{step.name}.{k}": getattr(fitted, k) for k in step.outputs}
                out = out.select(*step.select) if step.select else out
                out = out.drop(*step.drop)
                for a, b in step.rename.items():
                    out = out.drop(b).withColumnRenamed(a, b)
                out = out.repartition(step.repartition) if step.repartition else out
                old = checkpoint(out, path) if path and step.snapshot else out.cache() if step.cache else out
            now = results[step.name] = old
            if step.show or show_steps:
                print(f"{step.name}: {chosen[step.name]}")
                now.printSchema()
        if self.logs and log_on:
            log(df.sparkSession, self.logs, self.name, version, metrics, shown, self.group, self.project)
        return now, {k: results[k] for k in outputs}


def _set(stage: Any, path: Sequence[str], value: Any) -> None:
    """A parameter of a stage, or of one that it holds."""
    for name in path[:-1]:
        stage = getattr(stage, name)
    if hasattr(stage, "hasParam") and stage.hasParam(path[-1]):
        stage.set(stage.getParam(path[-1]), value)
    else:
        setattr(stage, path[-1], value)


def _get(stage: Any, path: Sequence[str]) -> Any:
    for name in path:
        if hasattr(stage, "hasParam") and isinstance(name, str) and stage.hasParam(name):
            stage = stage.getOrDefault(stage.getParam(name))
        else:
            stage = getattr(stage, name)
    return stage


def log(spark: SparkSession, path: str, model: str, version: Version, metrics: Mapping[str, Any], shown: Mapping[str, Any] | None = None, group: str = "", project: str = "") -> None:
    """Appends a run's row, JSON in folders by group, project and model."""
    none = "__HIVE_DEFAULT_PARTITION__"
    row = {"modelGroup": group or none, "project": project or none, "model": model, "note": version.note, "steps": json.dumps(dict(version.choices)), "params": json.dumps({**dict(version.params), **dict(shown or {})}, default=str), "log": json.dumps(dict(version.logs), default=str), "metrics": json.dumps(dict(metrics), default=str)}
    spark.createDataFrame([tuple(row.values())], list(row)).selectExpr("*", "current_timestamp() as executedOn").write.mode("append").partitionBy("modelGroup", "project", "model").json(path)
