"""Sources and sinks: text folders, Feather, JSON lines, Parquet with a backup, and text reports."""

from __future__ import annotations

import csv
import io
import itertools
import re
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillon import schemas

SKIPPED = ("logprobs", "logprobs_babbage", "headlines")
#: Bytes of a Feather file that one task reads.
SPLIT = 64 << 20
#: Names of quartiles in a summary file.
LABELS = {"q25": "25%", "q50": "50%", "q75": "75%"}


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Looks in whatever file system the path names."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def text_corpus(spark: SparkSession, root: str, domains: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """root/{domain}/{source}/**/*.txt as CORPUS, a row for each file. Only the named folders are listed; missing ones add
    nothing; files below a folder of SKIPPED don't count. author: the folder between source and file, if there is one. A
    file that isn't UTF-8 raises."""
    pairs = [(d, s) for d in domains or schemas.DOMAINS for s in sources or schemas.SOURCES]
    paths = [p for d, s in pairs if exists(spark, p := f"{root}/{d}/{s}")]
    if not paths:
        return spark.createDataFrame([], schemas.CORPUS)
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = files.select(path.alias("path"), F.regexp_replace(F.validate_utf8("value"), "\r\n?", "\n").alias("text")).where(~F.col("path").rlike(f"(^|/)({'|'.join(SKIPPED)})/"))
    # the folders are matched from the right-most named pair, so that a root of any name works
    part = lambda k: F.regexp_extract("path", rf"/({'|'.join(re.escape(d) for d, _ in pairs)})/({'|'.join(re.escape(s) for _, s in pairs)})/(?:(?:[^/]+/)*?([^/]+)/)?([^/]+)\.txt$", k)
    return rows.select(part(4).alias("id"), part(1).alias("domain"), part(2).alias("source"), F.nullif(part(3), F.lit("")).alias("author"), "text")


def _arrow_fs(path: str):
    """Arrow's file system for a path, and the path within it: any scheme that Arrow knows; no scheme means a local path."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def _arrow_files(path: str) -> list:
    """(path, bytes) of the file, or of the files of the folder in order of name."""
    from pyarrow import fs

    system, at = _arrow_fs(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (len(found) == 1 or f.base_name[0] not in "._"))
    if not files:
        raise FileNotFoundError(f"no Feather files in {path}")
    return files


class FeatherSource(DataSource):
    """format("feather"): Arrow IPC files, one or a folder of them, in any file system that Arrow reaches from the workers.
    Option `columns`: names with commas between; no others are read. Option `push`: "true" if filters may come to the scan."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        path, _ = _arrow_files(self.options["path"])[0]
        with _arrow_fs(self.options["path"])[0].open_input_file(path) as file:  # the footer only
            found = pa.ipc.open_file(file).schema
        wanted = self.options.get("columns")
        return from_arrow_schema(pa.schema([found.field(c) for c in wanted.split(",")]) if wanted else found)

    def reader(self, schema):
        return (FilteringReader if self.options.get("push") == "true" else FeatherReader)(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return FeatherWriter(self.options["path"], schema, overwrite)


class FeatherReader(DataSourceReader):
    """A task for each file, or for each SPLIT bytes of record batches of a larger one."""

    def __init__(self, path: str, schema):
        self.path, self.columns = path, [f.name for f in schema.fields]
        self.exact = [f.name for f in schema.fields if f.dataType.typeName() in ("string", "byte", "short", "integer", "long", "boolean", "date")]
        self.pushed: list = []

    def partitions(self):
        import pyarrow as pa

        system, out = _arrow_fs(self.path)[0], []
        for path, size in _arrow_files(self.path):
            if size <= SPLIT:
                out.append(InputPartition((path, 0, None)))
                continue
            with system.open_input_file(path) as file:
                n = pa.ipc.open_file(file).num_record_batches
            step = max(1, n * SPLIT // size)
            out += [InputPartition((path, k, k + step)) for k in range(0, n, step)]
        return out

    def read(self, partition):
        import pyarrow as pa

        path, first, last = partition.value
        with _arrow_fs(self.path)[0].open_input_file(path) as file:
            names = pa.ipc.open_file(file).schema.names
            batches = pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns]))
            for k in range(first, batches.num_record_batches if last is None else min(last, batches.num_record_batches)):
                yield from self._kept(batches.get_batch(k).select(self.columns))

    def _kept(self, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.pushed:
            return [batch]
        tests = {"EqualTo": lambda c, v: c == v, "GreaterThan": lambda c, v: c > v, "GreaterThanOrEqual": lambda c, v: c >= v, "LessThan": lambda c, v: c < v, "LessThanOrEqual": lambda c, v: c <= v, "In": lambda c, v: c.isin(list(v)), "IsNotNull": lambda c, v: c.is_valid(), "StringStartsWith": pc.starts_with}
        for name, column, value in self.pushed:
            batch = pa.Table.from_batches([batch]).filter(tests[name](pc.field(column), value)).combine_chunks()
            if not batch.num_rows:
                return []
            batch = batch.to_batches()[0]
        return [batch]


class FilteringReader(FeatherReader):
    """Rows that fail a filter stay in the task. Spark applies all filters again, so only their types have to be right: numbers
    with a fraction are left to it, as the two differ about NaN."""

    def pushFilters(self, filters):
        for f in filters:
            if type(f).__name__ in ("EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "IsNotNull", "StringStartsWith") and f.attribute[0] in self.exact and len(f.attribute) == 1:
                self.pushed.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))
            yield f


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class FeatherWriter(DataSourceArrowWriter):
    """A file for each task that has rows, written batch by batch into a folder beside the path. The files of tasks that made it
    become the table when all are done, the folder as one if the old table goes; if the job fails, the folder is removed. Only
    the driver makes it, so that tasks which outlive a failed job can't bring it back."""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema, overwrite
        self.job = uuid.uuid4().hex
        self.beside = f"{self.path}.{self.job}"
        system, folder = _arrow_fs(self.beside)
        system.create_dir(folder, recursive=True)

    def write(self, iterator):
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job}.feather"
        self._save(name, first.schema, itertools.chain([first], batches))
        return Written(name)

    def _save(self, name, schema, batches):
        import pyarrow as pa

        system, folder = _arrow_fs(self.beside)
        with system.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as file:
            for batch in batches:
                file.write_batch(batch)

    def commit(self, messages):
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        system, folder = _arrow_fs(self.beside)
        _, at = _arrow_fs(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:  # an empty table has columns too
            names = [f"part-00000-0-{self.job}.feather"]
            self._save(names[0], to_arrow_schema(self.schema), [])
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name not in names:  # of an attempt that was repeated
                system.delete_file(f.path)
        kind = system.get_file_info(at).type
        if kind == fs.FileType.NotFound:
            system.move(folder, at)
        elif self.overwrite:
            old = f"{at}.{self.job}.old"
            system.move(at, old)
            try:
                system.move(folder, at)
            except OSError:
                system.move(old, at)
                raise
            (system.delete_dir if kind == fs.FileType.Directory else system.delete_file)(old)
        elif kind == fs.FileType.File:
            raise OSError(f"can't append to the single file {self.path}")
        else:
            for name in names:
                system.move(f"{folder}/{name}", f"{at}/{name}")
            system.delete_dir(folder)

    def abort(self, messages):
        from pyarrow import fs

        system, folder = _arrow_fs(self.beside)
        for _ in range(20):  # a task may add a file meanwhile
            if system.get_file_info(folder).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(folder)
            except OSError:
                time.sleep(0.1)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Filters reach the scan in sessions with spark.sql.python.filterPushdown.enabled."""
    spark.dataSource.register(FeatherSource)
    reader = spark.read.format("feather").option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_feather(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of Feather files, written by the tasks; it appears as a whole or not at all. mode: overwrite or append."""
    df.sparkSession.dataSource.register(FeatherSource)
    df.write.format("feather").mode(mode).save(path)


def export_feather(df: DataFrame, path: str) -> None:
    """One Feather file, through the driver: for a frame that fits it, and readers that want a single file."""
    import pyarrow.feather as feather

    feather.write_feather(df.toArrow(), path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir, which driver and executors share; a local session without one has a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JSONL).json(path)


def from_records(spark: SparkSession, rows: list[dict], schema: str = schemas.JSONL) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write_with_backup(df: DataFrame, path: str, suffix: str = ".bak") -> None:
    """Writes beside, then renames the old table to path + suffix and the new one to path, so that a table may be replaced
    by what is computed from it. If a rename fails, the old table is back at its path and OSError is raised."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    fs, old = _fs(spark, path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    backup, new = make(path + suffix), make(beside)
    had = fs.exists(old)
    if had:
        if fs.exists(backup) and not fs.delete(backup, True):
            fs.delete(new, True)
            raise OSError(f"can't remove {backup}")
        if not fs.rename(old, backup):
            fs.delete(new, True)
            raise OSError(f"can't rename {path} to {backup}")
    if not fs.rename(new, old):
        if had:
            fs.rename(backup, old)
        fs.delete(new, True)
        raise OSError(f"can't rename {beside} to {path}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file in whatever file system the path names."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_summary_csv(df: DataFrame, path: str, keys: list[str] | None = None, metric: str | None = None) -> None:
    """A small summary as one CSV file with a header, sorted by keys. With `metric` (long form, as describe_many gives it) the
    metrics stand side by side under a header of two rows, metric and statistic, followed by a row of the keys' names."""
    keys = keys or []
    rows = [r.asDict() for r in df.orderBy(*keys, *([metric] if metric else [])).collect()]  # a row for each group
    said = lambda v: "" if v is None else str(v)
    if metric is None:
        table = [df.columns, *([said(r[c]) for c in df.columns] for r in rows)]
    else:
        stats = [c for c in df.columns if c not in (*keys, metric)]
        metrics = list(dict.fromkeys(r[metric] for r in rows))
        wide = {tuple(r[k] for k in keys): {} for r in rows}
        for r in rows:
            wide[tuple(r[k] for k in keys)][r[metric]] = r
        blank = [""] * len(keys)
        table = [[*blank, *(m for m in metrics for _ in stats)], [*blank, *(LABELS.get(s, s) for _ in metrics for s in stats)], [*keys, *[""] * (len(metrics) * len(stats))]]
        table += [[*map(said, k), *(said(own.get(m, {}).get(s)) for m in metrics for s in stats)] for k, own in wide.items()]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows(table)
    write_text(df.sparkSession, buffer.getvalue(), path)
