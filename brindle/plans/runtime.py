"""The execution envelope: budgets, deadlines and cancelling, recipes, step pipelines, asynchronous handles, error classes."""

from __future__ import annotations

import json
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from brindle.functions.expr import no_nan
from brindle.operators import quality
from brindle.sources.catalog import view_name


class BudgetExceeded(Exception):
    """A row, byte or time budget ran out; ``what`` names it."""

    def __init__(self, what: str, limit: float) -> None:
        super().__init__(f"{what} budget of {limit} exceeded")
        self.what, self.limit = what, limit


class Cancelled(Exception):
    pass


@dataclass(frozen=True)
class Context:
    """Identity and budgets of a run."""

    tenant: str = "default"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    max_rows: int | None = 50_000_000
    max_bytes: int | None = None
    deadline_s: float | None = 600.0
    recipe: str | None = None
    tags: tuple[str, ...] = ()

    @property
    def tag(self) -> str:
        return f"brindle-{self.run_id}"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Context:
        d = json.loads(text)
        return cls(**d | {"tags": tuple(d["tags"])})


class Session:
    """Runs actions under a context: tagged, so that they can be cancelled, and stopped at the deadline."""

    def __init__(self, spark: SparkSession, ctx: Context) -> None:
        self.spark, self.ctx = spark, ctx
        self._why: str | None = None

    def cancel(self) -> None:
        self._why = "cancelled"
        self.spark.sparkContext.cancelJobsWithTag(self.ctx.tag)

    def _late(self) -> None:
        self._why = "deadline"
        self.spark.sparkContext.cancelJobsWithTag(self.ctx.tag)

    def run(self, action: Callable[[], Any]) -> Any:
        if self._why == "cancelled":
            raise Cancelled(self.ctx.run_id)
        sc, timer = self.spark.sparkContext, None
        if self.ctx.deadline_s is not None:
            timer = threading.Timer(self.ctx.deadline_s, self._late)
            timer.daemon = True
            timer.start()
        sc.addJobTag(self.ctx.tag)
        try:
            return action()
        except Exception as e:
            if self._why == "deadline":
                raise BudgetExceeded("time", self.ctx.deadline_s) from e
            if self._why == "cancelled":
                raise Cancelled(self.ctx.run_id) from e
            raise
        finally:
            sc.removeJobTag(self.ctx.tag)
            if timer:
                timer.cancel()

    def guarded(self, df: DataFrame) -> DataFrame:
        """At most one row more than the budget is ever computed; ``table`` and ``stream`` turn that row into an error."""
        return df if self.ctx.max_rows is None else df.limit(self.ctx.max_rows + 1)

    def table(self, df: DataFrame):
        """An Arrow table within the row and byte budgets."""
        t = self.run(lambda: self.guarded(df).toArrow())
        if self.ctx.max_rows is not None and t.num_rows > self.ctx.max_rows:
            raise BudgetExceeded("rows", self.ctx.max_rows)
        if self.ctx.max_bytes is not None and t.nbytes > self.ctx.max_bytes:
            raise BudgetExceeded("bytes", self.ctx.max_bytes)
        return t

    def stream(self, df: DataFrame) -> Iterator:
        """Rows partition by partition; ends with BudgetExceeded before the first row beyond the budget."""
        rows = self.run(lambda: self.guarded(df).toLocalIterator(prefetchPartitions=True))
        for i, row in enumerate(rows):
            if self.ctx.max_rows is not None and i >= self.ctx.max_rows:
                raise BudgetExceeded("rows", self.ctx.max_rows)
            yield row


def is_final(error: Exception) -> bool:
    """Whether trying again cannot help: the text or the plan is wrong, or a budget ran out."""
    if isinstance(error, (AnalysisException, ParseException, BudgetExceeded, Cancelled)):
        return True
    if isinstance(error, PySparkException):
        state = error.getSqlState() or ""
        return state[:2] in ("42", "22", "0A", "2B", "46")
    return isinstance(error, (ValueError, TypeError, KeyError))


def retry(action: Callable[[], Any], attempts: int = 3, wait_s: float = 0.0) -> Any:
    for i in range(1, attempts + 1):
        try:
            return action()
        except Exception as e:
            if is_final(e) or i == attempts:
                raise
            time.sleep(wait_s * i)


@dataclass
class Result:
    """Primary table, named further tables (or functions that make them, called once they are wanted), and metadata."""

    primary: DataFrame
    auxiliaries: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        t = self.auxiliaries[name]
        return t() if callable(t) else t


class Recipe(Protocol):
    name: str

    def validate(self, params: Mapping[str, Any]) -> None: ...

    def extract(self, session: Session, params: Mapping[str, Any]) -> dict[str, DataFrame]: ...

    def compute(self, inputs: dict[str, DataFrame], params: Mapping[str, Any]) -> Result: ...


#: Attempts per phase of a staged run.
ATTEMPTS = {"validate": 1, "extract": 3, "compute": 2, "persist": 5}


def run_recipe(spark: SparkSession, recipe: Recipe, params: Mapping[str, Any], store, ctx: Context | None = None, staged: bool = False) -> dict:
    """validate, extract, compute, persist. Phases are one lazy plan, after a count of the extracts for the row budget;
    ``staged`` writes the extracts first and reads them back, so that the rest can be repeated without the sources."""
    ctx = ctx or Context(recipe=recipe.name)
    s = Session(spark, ctx)
    recipe.validate(params)
    inputs = retry(lambda: recipe.extract(s, params), ATTEMPTS["extract"] if staged else 1)
    inputs = {view_name(n): d for n, d in inputs.items()}
    for n, d in list(inputs.items()):
        if staged:
            # rows are counted as they are written: nothing is cut and nothing read twice
            seen = Observation()
            counted = d.observe(seen, F.count(F.lit(1)).alias("n"))
            path = s.run(lambda n=n, d=counted: retry(lambda: store.put(d, ctx.tenant, ctx.run_id, n, "extract"), ATTEMPTS["extract"]))
            rows = seen.get["n"]
            inputs[n] = spark.read.parquet(path)
        else:
            rows = s.run(d.count) if ctx.max_rows is not None else 0
        if ctx.max_rows is not None and rows > ctx.max_rows:
            raise BudgetExceeded("rows", ctx.max_rows)
    out = retry(lambda: recipe.compute(inputs, params), ATTEMPTS["compute"] if staged else 1)
    meta = {"recipe": recipe.name, **out.metadata}
    return s.run(lambda: retry(lambda: store.finalize(ctx.tenant, ctx.run_id, out.primary, {n: out.table(n) for n in out.auxiliaries}, meta), ATTEMPTS["persist"] if staged else 1))


class FluxRecipe:
    """Distribution, flux and trend of one rate by period and group, whatever the source."""

    name = "cross_source_flux"

    def __init__(self, read: Callable[[Session, Mapping[str, Any]], DataFrame]) -> None:
        self.read = read

    def validate(self, params: Mapping[str, Any]) -> None:
        missing = {"rate_col", "date_col"} - set(params)
        if missing:
            raise ValueError(f"missing parameters {sorted(missing)}")

    def extract(self, session: Session, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        df = self.read(session, params)
        have = {c.lower() for c in df.columns}
        need = {params["rate_col"].lower(), params["date_col"].lower(), *(g.lower() for g in params.get("group_cols", ()))}
        if not need <= have:
            raise ValueError(f"columns not in the extract: {sorted(need - have)}")
        return {"facts": df}

    def compute(self, inputs: dict[str, DataFrame], params: Mapping[str, Any]) -> Result:
        f, rate, date, g = inputs["facts"], params["rate_col"], params["date_col"], list(params.get("group_cols", ()))
        return Result(
            quality.flux_variance(f, rate, date, g, params.get("grain", "month")),
            {"distribution": lambda: quality.distribution_summary(f, rate, g), "trend": lambda: quality.period_trend(f, rate, date, g, params.get("grain", "month"))},
        )


@dataclass(frozen=True)
class Step:
    """``kind`` 'sql' runs ``text`` over the steps it consumes as views of their ids; 'tool' calls a named operator on the
    first of them with ``params``."""

    id: str
    kind: str
    text: str = ""
    tool: str = ""
    params: dict = field(default_factory=dict)
    consumes: tuple[str, ...] = ()


def run_steps(spark: SparkSession, steps: list[Step], inputs: Mapping[str, DataFrame] | None = None, tools: Mapping[str, Callable[..., DataFrame]] | None = None, final: str | None = None) -> DataFrame:
    """The final step's DataFrame (the last one by default): steps chain lazily, so one action plans them all together.

    Ids are unique; a step may consume only inputs and earlier steps.
    """
    done: dict[str, DataFrame] = dict(inputs or {})
    for s in steps:
        if s.id in done:
            raise ValueError(f"step {s.id} is given twice")
        missing = [c for c in s.consumes if c not in done]
        if missing:
            raise ValueError(f"step {s.id} consumes {missing}, which come later or not at all")
        if s.kind == "sql":
            if not s.text.strip():
                raise ValueError(f"step {s.id} has no text")
            done[s.id] = spark.sql(s.text, **{view_name(c): done[c] for c in s.consumes})
        elif s.kind == "tool":
            if tools is None or s.tool not in tools:
                raise ValueError(f"step {s.id}: no tool {s.tool!r}")
            done[s.id] = tools[s.tool](*[done[c] for c in s.consumes], **s.params)
        else:
            raise ValueError(f"step {s.id}: unknown kind {s.kind!r}")
    if final is not None and final not in done:
        raise ValueError(f"no step {final}")
    return done[final or steps[-1].id]


_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expand(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all texts of a parsed job; an unset name without default is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        got = env.get(m.group(1), m.group(2))
        if got is None:
            raise ValueError(f"{m.group(1)} is not set")
        return got

    return _VAR.sub(one, value)


def job_steps(spec: dict, env: Mapping[str, str] | None = None) -> list[Step]:
    """Steps of a parsed job: a mapping with a list under 'steps'."""
    return [Step(s["id"], s["kind"], s.get("text", ""), s.get("tool", ""), s.get("params", {}), tuple(s.get("consumes", ()))) for s in expand(spec, env)["steps"]]


class Handles:
    """Queries in the background: submit, status, fetch, cancel. Results are spooled as Parquet, one folder a query."""

    def __init__(self, spark: SparkSession, root: str, workers: int = 4) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._pool = ThreadPoolExecutor(workers)
        self._runs: dict[str, tuple[Session, Future]] = {}

    def submit(self, df: DataFrame, ctx: Context | None = None) -> str:
        ctx = ctx or Context()
        s, path = Session(self.spark, ctx), f"{self.root}/{ctx.run_id}.parquet"

        def work() -> str:
            s.run(lambda: s.guarded(df).write.mode("overwrite").parquet(path))
            if ctx.max_rows is not None and self.spark.read.parquet(path).count() > ctx.max_rows:
                raise BudgetExceeded("rows", ctx.max_rows)
            return path

        self._runs[ctx.run_id] = (s, self._pool.submit(work))
        return ctx.run_id

    def status(self, run_id: str) -> str:
        s, f = self._runs[run_id]
        if not f.done():
            return "running" if f.running() else "queued"
        if f.cancelled() or isinstance(f.exception(), Cancelled):
            return "cancelled"
        return "failed" if f.exception() else "succeeded"

    def fetch(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._runs[run_id][1].result())

    def cancel(self, run_id: str) -> None:
        s, f = self._runs[run_id]
        f.cancel()
        s.cancel()


def json_safe(df: DataFrame) -> DataFrame:
    """Numbers without NaN, decimals as doubles, binaries as hex, nested values and times as text: rows any JSON writer takes."""
    out = []
    for f in df.schema:
        c, t = F.col(f"`{f.name}`"), f.dataType.typeName()
        if t in ("double", "float", "decimal"):
            c = no_nan(c)
        elif t == "binary":
            c = F.hex(c)
        elif t in ("timestamp", "timestamp_ntz", "date"):
            c = c.cast("string")
        elif t in ("array", "map", "struct"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def summary(df: DataFrame, rows: int = 50) -> dict:
    """A short account of a result: its columns, the first rows, and a bar chart's specification over them."""
    got = [r.asDict() for r in json_safe(df).limit(rows).collect()]
    kinds = dict(df.dtypes)
    number = next((c for c, t in kinds.items() if t in ("double", "float", "int", "bigint") or t.startswith("decimal")), None)
    label = next((c for c, t in kinds.items() if t == "string"), None)
    chart = {"mark": "bar", "data": {"values": got}, "encoding": {"x": {"field": label, "type": "nominal"}, "y": {"field": number, "type": "quantitative"}}} if number and label else None
    return {"columns": kinds, "n_rows_shown": len(got), "rows": got, "chart": chart}


def operation_key(name: str, config: Mapping[str, Any], inputs: Mapping[str, str], version: str = "1") -> str:
    """Key of an operation by its inputs, settings and version: equal keys, equal results."""
    import hashlib

    return hashlib.sha256(json.dumps([name, version, dict(config), dict(inputs)], sort_keys=True, default=str).encode()).hexdigest()
