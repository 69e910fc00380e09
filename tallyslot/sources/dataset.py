"""The set of base tables a plan reads, loaded lazily and conformed to the schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyslot import schema


class SchemaMismatch(ValueError):
    """A table lacks a required column or holds a type that cannot be declared."""


class Dataset:
    """Named DataFrames; a table is built the first time a plan asks for it.

    ``ds.lessons`` and ``ds["lessons"]`` are the same. ``replace`` gives a copy
    with some tables swapped, which is how a job hands on new state. ``stored``
    gives a table as it was before casts and defaults, for jobs that judge that.
    """

    def __init__(
        self, spark: SparkSession, builders: dict[str, Callable[[], DataFrame]], raw: dict[str, Callable[[], DataFrame]] | None = None
    ):
        self.spark = spark
        self._builders = dict(builders)
        self._raw = dict(raw or {})
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        return self[name]

    def stored(self, name: str) -> DataFrame:
        return self._raw[name]() if name in self._raw else self[name]

    def __contains__(self, name: str) -> bool:
        return name in self._builders

    def names(self) -> list[str]:
        return list(self._builders)

    def replace(self, **tables: DataFrame) -> "Dataset":
        out = Dataset(self.spark, self._builders, {n: b for n, b in self._raw.items() if n not in tables})
        out._built = dict(self._built)
        for name, df in tables.items():
            out._builders[name] = lambda df=df: df
            out._built[name] = df
        return out

    def register_views(self) -> None:
        """Expose every table to ``spark.sql`` as a temp view."""
        for name in self.names():
            self[name].createOrReplaceTempView(name)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check a table against its declared schema and apply casts and defaults.

    A missing optional column is added as NULL. A missing required column fails
    here, by name, before any job runs.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out, missing = [], []
    for c in schema.TABLES[table]:
        kind = c.type.simpleString()
        if c.name in have:
            value = f"`{c.name}`" if have[c.name] == c.type else f"CAST(`{c.name}` AS {kind})"
            if c.default is not None:
                value = f"coalesce({value}, CAST('{c.default}' AS {kind}))"
        elif c.required and c.default is None:
            missing.append(c.name)
            continue
        else:
            value = "CAST(NULL AS " + kind + ")" if c.default is None else f"CAST('{c.default}' AS {kind})"
        if (table, c.name) in schema.NORMAL_EMAILS:
            value = f"lower(trim({value}))"
        out.append(f"{value} AS `{c.name}`")
    if missing:
        raise SchemaMismatch(f"table {table} lacks required columns: {', '.join(missing)}")
    return df.selectExpr(*out)


def unreadable(column: schema.Col) -> Column:
    """True where a stored value is there but does not fit the declared type, such as an amount of too many digits."""
    name = f"`{column.name}`"
    return F.col(name).isNotNull() & F.expr(f"try_cast({name} AS {column.type.simpleString()})").isNull()


def faults(df: DataFrame, table: str) -> Column:
    """What is wrong with the values of a stored row, as an array of reasons."""
    found = []
    for c in schema.TABLES[table]:
        if c.name in df.columns:
            found.append(F.when(unreadable(c), F.lit(f"{c.name}: not {c.type.simpleString()}")))
            if c.required and c.default is None:
                found.append(F.when(F.col(f"`{c.name}`").isNull(), F.lit(f"{c.name}: missing")))
            if c.length:
                found.append(F.when(F.length(f"`{c.name}`") > c.length, F.lit(f"{c.name}: over {c.length} characters")))
    return F.array_compact(F.array(*found))


def admitted(df: DataFrame, table: str) -> DataFrame:
    """The stored rows without a fault, conformed."""
    sound = df.where(F.size(faults(df, table)) == 0)
    for c in schema.TABLES[table]:
        if c.name in df.columns:
            sound = sound.withColumn(c.name, F.expr(f"try_cast(`{c.name}` AS {c.type.simpleString()})"))
    return conform(sound, table)


def quarantined(df: DataFrame, table: str) -> DataFrame:
    """The other rows as they are stored, with their ``reasons``."""
    return df.withColumn("reasons", faults(df, table)).where(F.size("reasons") > 0)


def read_parquet_dataset(spark: SparkSession, root: str, lenient: bool = False) -> Dataset:
    """Open a folder that holds one parquet table per declared name, each at its newest version.

    A value that cannot be cast stops the job that reads it; with ``lenient`` rows
    with a fault are left out, and ``quarantined(ds.stored(name), name)`` has them.
    """

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(table_path(spark, root, name))

    fit = admitted if lenient else conform
    return Dataset(
        spark,
        {name: (lambda name=name: fit(stored(name), name)) for name in schema.TABLES},
        {name: (lambda name=name: stored(name)) for name in schema.TABLES},
    )


VERSIONS, COMPLETE = "_versions", "_complete"


def _versions(spark: SparkSession, root: str, table: str) -> dict[int, bool]:
    """Versions ever begun, and whether each was finished."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    home = new_path(f"{root}/{table}/{VERSIONS}")
    fs = home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(home):
        return {}
    found = [entry.getPath() for entry in fs.listStatus(home)]
    return {int(path.getName()): fs.exists(new_path(path, COMPLETE)) for path in found}


def table_path(spark: SparkSession, root: str, table: str) -> str:
    """The folder of a table's newest finished version; a table without versions is its own first one."""
    done = [number for number, finished in _versions(spark, root, table).items() if finished]
    return f"{root}/{table}/{VERSIONS}/{max(done):08d}" if done else f"{root}/{table}"


def write_table(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None) -> None:
    """Write a new version of a table as parquet, and only then make it the one that is read.

    Files of earlier versions stay as they are, so ``df`` may read the table it
    replaces, running readers are not disturbed, and a write that fails leaves
    the version before it in force. Of two writers at once, one fails. Old
    versions may be deleted once no reader uses them.
    """
    spark = df.sparkSession
    path = f"{root}/{table}/{VERSIONS}/{max(_versions(spark, root, table), default=0) + 1:08d}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMPLETE}")
    mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(mark, False).close()
