"""User functions as derived variables: NumPy scripts or Python callables over co-gridded inputs.

A function is declared pointwise (each output sample depends on the inputs at the same
sample), with a halo (on samples at most so far away along each axis), or neither.  Pointwise
functions run on Arrow batches.  Those with a halo run block by block: every block gets
the samples around it from its neighbours, and what a script makes at the blocks' cut sides is dropped, so the
result is that on the whole grid.  Either kind may ask for totals of a step, which Spark aggregates.  The others
get the whole grid of one time step in one task.

A request for a region reads only that region (and its halo) if all inputs are on the
output's mesh; otherwise the whole grid.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import AXES
from .catalog import Dataset, Variable


#: Samples of a block along each axis, for functions with a halo.
BLOCK = 64


@dataclass(frozen=True)
class Function:
    name: str
    script: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    mesh: str
    pointwise: bool
    halo: int | None = None
    coordinates: bool = False
    totals: dict[str, str] = field(default_factory=dict)


class Registry:
    """Functions of one dataset."""

    def __init__(self, dataset: Dataset):
        self.dataset, self._functions = dataset, {}
        self.block = BLOCK

    def add(
        self, name: str, script: str, inputs: Sequence[str], outputs: Sequence[str], pointwise: bool = False,
        halo: int | None = None, mesh: str | None = None, coordinates: bool = False, totals: dict[str, str] | None = None,
    ) -> None:
        """Checks and registers a function.  Outputs must be new, valid names on a known mesh, that of the first input
        unless given; a mistake in the script's syntax is raised here.

        With ``coordinates`` the inputs' coordinate variables are inputs too, once each.  ``totals`` names aggregates of
        the inputs over a whole step, such as ``avg(v)``, which Spark makes; the script finds each as an array of one value.
        """
        import re

        compile(script, name, "exec")
        totals = dict(totals or {})
        if set(totals) & {*inputs, *outputs, *AXES, "ts"}:
            raise ValueError(f"names in use among {sorted(totals)}")
        for n in [*outputs, *totals]:
            if not re.fullmatch(r"[A-Za-z_]\w*", n):
                raise ValueError(f"not a valid name: {n}")
            if n not in totals and n in self.dataset.variables:
                raise ValueError(f"{n} exists")
        missing = [n for n in inputs if n not in self.dataset.variables]
        if missing or not inputs:
            raise ValueError(f"unknown inputs {missing}")
        meshes = {self.dataset.variables[n].mesh for n in inputs}
        if len(meshes) != 1:
            raise ValueError("inputs are on different meshes")
        target = mesh or self.dataset.variables[inputs[0]].mesh
        if target not in self.dataset.meshes:
            raise ValueError(f"unknown mesh {target}")
        function = Function(name, script, tuple(inputs), tuple(outputs), target, pointwise, halo, coordinates, totals)
        self._functions[name] = function
        varying = any(self.dataset.variables[n].time_varying for n in inputs)
        for n in outputs:
            variable = Variable(n, function.mesh, inputs=function.inputs, time_varying=varying)
            self.dataset.add_derived(variable, lambda _, n=n: self._evaluate(function, n))
            if self.regional(function):
                self.dataset.add_regional(n, lambda ts, box, n=n: self._evaluate(function, n, ts, box))

    def regional(self, function: Function) -> bool:
        """Whether a part of the output needs a part of the inputs only: all are on its mesh, and it looks no farther than a halo."""
        same = all(self.dataset.variables[n].mesh == function.mesh for n in function.inputs)
        return same and not function.totals and (function.pointwise or function.halo is not None)

    def inputs_of(self, function: Function) -> list[str]:
        """The inputs, and the coordinates that the function asks for, each once."""
        out = list(function.inputs)
        if function.coordinates:
            for n in function.inputs:
                out += [c for c in self.dataset.meshes[self.dataset.variables[n].mesh].coordinates if c in self.dataset.variables and c not in out]
        return out

    def state(self) -> str:
        """The functions as text, for ``sync``."""
        return json.dumps([asdict(self._functions[n]) for n in self.names()])

    def sync(self, state: str) -> list[str]:
        """Makes the functions those of a stored state: others go, changed ones are replaced, new ones added; the names that changed."""
        wanted = {f["name"]: Function(**(f | {"inputs": tuple(f["inputs"]), "outputs": tuple(f["outputs"])})) for f in json.loads(state)}
        changed = []
        for name in self.names():
            if self._functions[name] != wanted.get(name):
                self.remove(name)
                changed.append(name)
        for name, f in wanted.items():
            if name not in self._functions:
                self.add(name, f.script, f.inputs, f.outputs, f.pointwise, f.halo, f.mesh, f.coordinates, f.totals)
                changed.append(name)
        return sorted(set(changed))

    def remove(self, name: str) -> None:
        for n in self._functions.pop(name).outputs:
            self.dataset.remove_derived(n)

    def names(self) -> list[str]:
        return sorted(self._functions)

    def get(self, name: str) -> Function:
        return self._functions[name]

    def _gathered(self, function: Function, output: str, ts: int | None, box) -> tuple[DataFrame, list[str], list[str]]:
        """The inputs side by side, cut to a step and to a box with its halo; with the key columns and axes."""
        inputs = None
        axes = list(AXES[: self.dataset.topology(function.inputs[0])])
        varying = self.dataset.variables[output].time_varying
        keys = (["ts"] if varying else []) + axes
        for n in self.inputs_of(function):
            v = self.dataset.variables[n]
            table = self.dataset.table(n)
            if ts is not None and v.time_varying:
                table = table.where(F.col("ts") == ts)
            own = [a for a in axes if a in table.columns]
            if box is not None:
                far = function.halo or 0
                for axis, (lo, hi) in zip(axes, box):
                    if axis in own:
                        table = table.where(F.col(axis).between(lo - far, hi + far))
            on = (["ts"] if v.time_varying else []) + own
            one = table.select(*on, F.col("value").alias(n))
            inputs = one if inputs is None else inputs.join(one, [c for c in on if c in inputs.columns])
        if function.totals:
            by = [c for c in keys if c == "ts"]
            made = inputs.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in function.totals.items()])
            inputs = inputs.join(made, by) if by else inputs.crossJoin(made)
        return inputs, keys, axes

    def _evaluate(self, function: Function, output: str, ts: int | None = None, box=None) -> DataFrame:
        inputs, keys, axes = self._gathered(function, output, ts, box)
        names = self.inputs_of(function) + list(function.totals)
        if function.pointwise:
            return run_pointwise(inputs, keys, axes, function.script, names, output)
        if function.halo is not None:
            return run_blocks(inputs, keys, axes, function.script, names, output, function.halo, self.block)
        return run_whole(inputs, keys, axes, function.script, names, output)

    def printed(self, name: str, ts: int | None = None) -> DataFrame:
        """What a function prints where it runs: (ts, part, text), a row for each part of the grid that it is called on."""
        function = self._functions[name]
        inputs, keys, axes = self._gathered(function, function.outputs[0], ts, None)
        names = self.inputs_of(function) + list(function.totals)
        if function.halo is None and not function.pointwise:
            return _outputs_of(inputs, keys, axes, function.script, names, 1 << 30, 0)
        return _outputs_of(inputs, keys, axes, function.script, names, self.block, function.halo or 0)


def _call(script: str, arrays: dict, output: str):
    scope = {"np": np, "numpy": np, **arrays}
    exec(compile(script, output, "exec"), scope)  # the user's own script, as registered
    return np.asarray(scope[output], float)


def run_pointwise(inputs: DataFrame, keys: Sequence[str], axes: Sequence[str], script: str, names: Sequence[str], output: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            arrays = {n: batch[n].to_numpy(float) for n in names}
            out = batch[list(keys)].copy()
            out["value"] = np.broadcast_to(_call(script, arrays, output), len(batch))
            yield out

    kinds = ", ".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in keys)
    return _null(inputs.mapInPandas(run, f"{kinds}, value double"))


def _array(group, axes: Sequence[str], names: Sequence[str]) -> tuple[dict, tuple]:
    """Inputs as arrays (k, j, i) over the range of indices that the rows have, NaN where there is no row, and the rows' places."""
    first = [int(group[a].min()) for a in axes]
    shape = tuple(int(group[a].max()) - f + 1 for a, f in reversed(list(zip(axes, first))))
    place = tuple(group[a].to_numpy() - f for a, f in reversed(list(zip(axes, first))))
    arrays = {}
    for n in names:
        arrays[n] = np.full(shape, np.nan)
        arrays[n][place] = group[n].to_numpy(float)
    return arrays, place


def run_whole(inputs: DataFrame, keys: Sequence[str], axes: Sequence[str], script: str, names: Sequence[str], output: str) -> DataFrame:
    """One call for each time step, with arrays of axes (k, j, i): a step must fit a task."""

    def run(group):
        arrays, place = _array(group, axes, names)
        out = group[list(keys)].copy()
        out["value"] = np.broadcast_to(_call(script, arrays, output), arrays[names[0]].shape)[place]
        return out

    kinds = ", ".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in keys)
    by = [c for c in keys if c == "ts"]
    return _null(inputs.groupBy(*by).applyInPandas(run, f"{kinds}, value double"))


def with_halo(inputs: DataFrame, axes: Sequence[str], block: int, halo: int) -> DataFrame:
    """Each sample once for every block (``_b`` and the axis) that it is in or no more than ``halo`` samples beside."""
    for a in axes:
        first, last = F.floor((F.col(a) - halo) / block), F.floor((F.col(a) + halo) / block)
        inputs = inputs.withColumn(f"_b{a}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return inputs


def run_blocks(
    inputs: DataFrame, keys: Sequence[str], axes: Sequence[str], script: str, names: Sequence[str], output: str, halo: int, block: int = BLOCK
) -> DataFrame:
    """One call for each block of each time step, with the samples up to ``halo`` away around it."""
    cells = [f"_b{a}" for a in axes]

    def run(group):
        own = np.ones(len(group), bool)
        for a, c in zip(axes, cells):
            own &= (group[a] // block == group[c]).to_numpy()
        out = group.loc[own, list(keys)].copy()
        if not own.any():  # only a halo: there is no block
            out["value"] = np.zeros(0)
            return out
        arrays, place = _array(group, axes, names)
        made = np.broadcast_to(_call(script, arrays, output), arrays[names[0]].shape)[place]
        out["value"] = made[own]
        return out

    kinds = ", ".join(f"{c} {inputs.schema[c].dataType.simpleString()}" for c in keys)
    by = [c for c in keys if c == "ts"]
    return _null(with_halo(inputs, axes, block, halo).groupBy(*by, *cells).applyInPandas(run, f"{kinds}, value double"))


def _outputs_of(inputs: DataFrame, keys: Sequence[str], axes: Sequence[str], script: str, names: Sequence[str], block: int, halo: int) -> DataFrame:
    cells, by = [f"_b{a}" for a in axes], [c for c in keys if c == "ts"]

    def run(group):
        import contextlib
        import io

        import pandas as pd

        text = io.StringIO()
        arrays, _ = _array(group, axes, names)
        with contextlib.redirect_stdout(text):
            exec(compile(script, "script", "exec"), {"np": np, "numpy": np, **arrays})
        part = ",".join(str(group[c].iloc[0]) for c in cells)
        return pd.DataFrame({"ts": [int(group["ts"].iloc[0]) if by else 0], "part": [part], "text": [text.getvalue()]})

    return with_halo(inputs, axes, block, halo).groupBy(*by, *cells).applyInPandas(run, "ts int, part string, text string")


def _null(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
