"""Sources by name: descriptors, readers of every kind Spark can reach, samples, and result stores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Reserved kinds of source, with the Spark format that reads each.
FORMATS = {
    "postgres": "jdbc", "mysql": "jdbc", "mssql": "jdbc", "snowflake": "jdbc", "bigquery": "bigquery", "redshift": "jdbc", "iceberg": "iceberg",
    "delta": "delta", "parquet": "parquet", "duckdb": "jdbc", "sqlite": "jdbc", "clickhouse": "jdbc", "trino": "jdbc", "memory": "memory",
}
FETCH_ROWS = 5000
_PART = r'(?:[A-Za-z_][A-Za-z0-9_$]*|"[^"\x00;]+")'
_NAME = re.compile(rf"{_PART}(?:\.{_PART}){{0,2}}\Z")
_VIEW = re.compile(r"[A-Za-z0-9_]+\Z")


class SourceError(Exception):
    """A source that cannot be used as asked; never worth a retry."""


class TenantMismatch(SourceError):
    pass


def identifier(name: str) -> str:
    """A table name of up to three plain or quoted parts, or SourceError."""
    if not _NAME.match(name):
        raise SourceError(f"not an identifier: {name!r}")
    return name


def view_name(name: str) -> str:
    if not _VIEW.match(name):
        raise SourceError(f"not a view name: {name!r}")
    return name


@dataclass(frozen=True)
class Source:
    source_id: str
    kind: str
    display_name: str = ""
    tenant_id: str | None = None
    config: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)


class Catalog:
    """Sources in memory; ids are unique."""

    def __init__(self, sources: list[Source] = ()) -> None:
        self._by_id: dict[str, Source] = {}
        for s in sources:
            self.add(s)

    def add(self, source: Source) -> None:
        if source.source_id in self._by_id:
            raise SourceError(f"source {source.source_id} is given twice")
        if source.kind not in FORMATS:
            raise SourceError(f"unknown kind {source.kind}")
        self._by_id[source.source_id] = source

    def get(self, source_id: str, tenant: str | None = None) -> Source:
        if source_id not in self._by_id:
            raise SourceError(f"no source {source_id}")
        s = self._by_id[source_id]
        if tenant is not None and s.tenant_id is not None and s.tenant_id != tenant:
            raise TenantMismatch(source_id)
        return s

    def list(self, tenant: str | None = None) -> list[Source]:
        return [s for s in self._by_id.values() if tenant is None or s.tenant_id in (None, tenant)]

    @classmethod
    def from_entries(cls, entries: list[dict]) -> Catalog:
        """From parsed settings; source_id and kind must be there."""
        out = cls()
        for e in entries:
            missing = {"source_id", "kind"} - set(e)
            if missing:
                raise SourceError(f"missing {sorted(missing)}")
            out.add(Source(e["source_id"], e["kind"], e.get("display_name", e["source_id"]), e.get("tenant_id"), e.get("config", {}), e.get("tags", {})))
        return out

    @classmethod
    def from_text(cls, text: str) -> Catalog:
        """From JSON, or YAML where a parser is installed: a list, or a mapping with the list under 'sources'."""
        try:
            data = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise SourceError("no YAML parser is installed") from e
            data = yaml.safe_load(text)
        return cls.from_entries(data["sources"] if isinstance(data, dict) else data)


class Reader:
    """Reads from the catalogue's sources; text goes to the source as it is, one source a query."""

    def __init__(self, spark: SparkSession, catalog: Catalog) -> None:
        self.spark, self.catalog = spark, catalog
        self._replies: dict[tuple[str, str], DataFrame] = {}

    def reply(self, source_id: str, sql: str, df: DataFrame) -> None:
        """The rows that a memory source gives to one text."""
        self._replies[source_id, sql.strip()] = df

    def options(self, s: Source, sql: str, split: dict | None = None) -> dict:
        """Reader options of a JDBC query; ``split`` (column, lower, upper, partitions) reads a table in parallel."""
        base = {"url": s.config["url"], "fetchsize": str(s.config.get("fetchsize", FETCH_ROWS)), "sessionInitStatement": s.config.get("init", "")}
        if split:
            base |= {"dbtable": f"({sql}) AS q", "partitionColumn": split["column"], "lowerBound": str(split["lower"]), "upperBound": str(split["upper"]), "numPartitions": str(split["partitions"])}
        else:
            base["query"] = sql
        return {k: v for k, v in base.items() if v} | {k: str(s.config[k]) for k in ("driver", "user", "password", "queryTimeout") if k in s.config}

    def sql(self, source_id: str, text: str, tenant: str | None = None, split: dict | None = None) -> DataFrame:
        s = self.catalog.get(source_id, tenant)
        fmt = FORMATS[s.kind]
        if fmt == "memory":
            key = (source_id, text.strip())
            if key in self._replies:
                return self._replies[key]
            if text.strip().rstrip(";").upper() == "SELECT 1":
                return self.spark.sql("SELECT 1 AS one")
            raise SourceError(f"no reply for {text!r}")
        if fmt in ("parquet", "delta", "iceberg"):
            for name, path in s.config.get("tables", {}).items():
                self.spark.read.format(fmt).load(path).createOrReplaceTempView(view_name(name))
            return self.spark.sql(text)
        return self.spark.read.format(fmt).options(**self.options(s, text, split)).load()

    def describe(self, source_id: str, text: str, tenant: str | None = None):
        """The schema of a query, by analysis alone."""
        return self.sql(source_id, text, tenant).schema


def register_parquet(spark: SparkSession, tables: dict[str, str]) -> None:
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(view_name(name))


def register_arrow(spark: SparkSession, tables: dict) -> None:
    """Arrow tables as views."""
    for name, t in tables.items():
        spark.createDataFrame(t).createOrReplaceTempView(view_name(name))


def csv_sample(spark: SparkSession, folder: str, name: str, n: int = 1000, delimiter: str = ",") -> DataFrame:
    """The first ``n`` rows of <folder>/<name>.csv; an empty table if there is none."""
    path = f"{folder}/{name}.csv"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "_missing string").select()
    return spark.read.csv(path, header=True, inferSchema=True, sep=delimiter).limit(n)


def complete_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``n`` rows of the columns without a null in any."""
    return df.select(*columns).dropna().limit(n)


def cast_sample(df: DataFrame, n: int, casts: dict[str, str] | None = None) -> DataFrame:
    """``n`` rows with lower-case names and safe casts: what does not parse is null."""
    casts = {k.lower(): v for k, v in (casts or {}).items()}
    return df.select(*[(F.col(c).try_cast(casts[c.lower()]) if c.lower() in casts else F.col(c)).alias(c.lower()) for c in df.columns]).limit(n)


def dump_tables(text: str) -> list[dict]:
    """Tables of a plain SQL dump: one entry a column with table, column, type, nullable, primary key, reference, comment."""
    out: list[dict] = []
    for m in re.finditer(r"CREATE TABLE\s+(?:IF NOT EXISTS\s+)?([\w.\"]+)\s*\((.*?)\n\)\s*;", text, re.S | re.I):
        table = m.group(1).replace('"', "")
        for line in re.split(r",\s*\n", m.group(2)):
            c = re.match(r'\s*"?(\w+)"?\s+(.+)', line.strip(), re.S)
            if not c or c.group(1).upper() in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK"):
                continue
            kind = re.split(r"\s+(?:NOT NULL|NULL|DEFAULT|PRIMARY|REFERENCES|COLLATE)\b", c.group(2), maxsplit=1, flags=re.I)[0].strip()
            out.append({"table": table, "column": c.group(1), "type": kind, "nullable": not re.search(r"NOT NULL", line, re.I), "pk": bool(re.search(r"PRIMARY KEY", line, re.I)), "ref": None, "comment": None})
    at = {(r["table"].split(".")[-1], r["column"]): r for r in out}
    for m in re.finditer(r"ALTER TABLE (?:ONLY )?([\w.\"]+)\s+ADD CONSTRAINT \S+ (PRIMARY KEY|FOREIGN KEY) \(([^)]*)\)(?:\s*REFERENCES ([\w.\"]+)\s*\(([^)]*)\))?", text, re.I):
        t = m.group(1).replace('"', "").split(".")[-1]
        for i, c in enumerate(x.strip(' "') for x in m.group(3).split(",")):
            if (t, c) in at:
                if m.group(2).upper().startswith("PRIMARY"):
                    at[t, c]["pk"] = True
                elif m.group(4):
                    at[t, c]["ref"] = f"{m.group(4)}.{m.group(5).split(',')[i].strip()}".replace('"', "")
    for m in re.finditer(r"COMMENT ON COLUMN ([\w.\"]+)\.\"?(\w+)\"? IS '((?:[^']|'')*)'", text):
        key = (m.group(1).replace('"', "").split(".")[-1], m.group(2))
        if key in at:
            at[key]["comment"] = m.group(3).replace("''", "'")
    return out


def introspect(df: DataFrame, table: str) -> DataFrame:
    """Columns of a DataFrame as rows (table, column, position, type, nullable)."""
    rows = [(table, f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "`table` string, column string, position int, type string, nullable boolean")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with a front matter of 'key: value' lines: (path, meta map, body). Files without one have an empty map."""
    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))
    return t.select("path", F.when(head != "", meta).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*\n", "").alias("body"))


class ResultStore:
    """Results as Parquet under <root>/<tenant>/<job>/{extract,compute}/<name>.parquet with a JSON manifest."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, tenant: str, job: str, phase: str, name: str) -> str:
        for part in (tenant, job, name):
            if not re.fullmatch(r"[A-Za-z0-9._-]+", part):
                raise SourceError(f"not a path part: {part!r}")
        return f"{self.root}/{tenant}/{job}/{phase}/{name}.parquet"

    def put(self, df: DataFrame, tenant: str, job: str, name: str, phase: str = "compute", partition_by: tuple[str, ...] = ()) -> str:
        """Writes one table; the commit of the job makes it appear at once, or not at all."""
        path = self.path(tenant, job, phase, name)
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return path

    def finalize(self, tenant: str, job: str, primary: DataFrame, auxiliaries: dict[str, DataFrame] | None = None, metadata: dict | None = None) -> dict:
        tables = {n: self.put(d, tenant, job, n) for n, d in {"primary": primary, **(auxiliaries or {})}.items()}
        manifest = {"tenant": tenant, "job": job, "tables": tables, "metadata": metadata or {}}
        text = self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.root}/{tenant}/{job}/metadata")
        return manifest

    def read(self, tenant: str, job: str, name: str = "primary", phase: str = "compute") -> DataFrame:
        return self.spark.read.parquet(self.path(tenant, job, phase, name))


    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def jobs(self, tenant: str) -> list[str]:
        """Names of the tenant's jobs that were finalized."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", tenant):
            raise SourceError(f"not a path part: {tenant!r}")
        path, fs = self._files(f"{self.root}/{tenant}")
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.getName() for p in found if fs.exists(self._files(f"{p.toString()}/metadata/_SUCCESS")[0]))

    def manifest(self, tenant: str, job: str) -> dict:
        self.path(tenant, job, "compute", "primary")
        return json.loads(self.spark.read.text(f"{self.root}/{tenant}/{job}/metadata").first()[0])

    def delete(self, tenant: str, job: str) -> bool:
        """Removes a job with all its tables; false if there was none."""
        self.path(tenant, job, "compute", "primary")
        if job in (".", ".."):
            raise SourceError(f"not a path part: {job!r}")
        path, fs = self._files(f"{self.root}/{tenant}/{job}")
        return fs.delete(path, True)


class NullStore:
    """Runs the result and keeps nothing."""

    def finalize(self, tenant: str, job: str, primary: DataFrame, auxiliaries: dict[str, DataFrame] | None = None, metadata: dict | None = None) -> dict:
        for d in (primary, *(auxiliaries or {}).values()):
            d.write.format("noop").mode("overwrite").save()
        return {"tenant": tenant, "job": job, "tables": {"primary": "memory://"}, "metadata": metadata or {}}


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def tee(df: DataFrame, *sinks) -> None:
    """One computation to several sinks (callables of a DataFrame)."""
    kept = df.persist()
    try:
        for s in sinks:
            s(kept)
    finally:
        kept.unpersist()


def batches(df: DataFrame, prefetch: bool = True) -> Iterator:
    """Rows partition by partition: the driver holds one partition, and the next if prefetched."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


