"""Database tables over JDBC: reads in partitions with pushed filters, and writes that may run twice.

Rows go to a staging table from all executors; one statement in one transaction takes them over and notes the batch,
so that a batch that comes again, or fails halfway, changes nothing.

An embedded database is open in the driver's process alone. On a cluster its tables and Spark's meet in files of the
shared folder, which the database loads and unloads itself and executors write and read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewright.operators.arrivals import first_of_any
from tidewright.session import keep_first, shared_path

LEDGER = "ingested_batches"
#: Keys that a query may ask for by name in one statement, when stored rows are looked up.
PARTS = 8


def in_transaction(spark: SparkSession, url: str, statements: list[str]) -> None:
    """All of the statements, or none."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        try:
            for x in statements:
                at = connection.createStatement()
                at.executeUpdate(x)
                at.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def table_names(spark: SparkSession, url: str) -> set[str]:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found, out = connection.getMetaData().getTables(None, None, "%", None), set()
        while found.next():
            out.add(found.getString("TABLE_NAME").lower())
        return out
    finally:
        connection.close()


def quoted(columns, of: str = "") -> str:
    return ", ".join(f'{of}"{c}"' for c in columns)


def create(spark: SparkSession, url: str, table: str, types: dict[str, str], unique: list[list[str]]) -> None:
    """A table with columns of the given SQL types, and a unique constraint on each list of keys."""
    columns = ", ".join(f'"{c}" {t}' for c, t in types.items())
    limits = "".join(f", UNIQUE ({quoted(k)})" for k in unique)
    in_transaction(spark, url, [f"CREATE TABLE {table} ({columns}{limits})"])


def by_files(spark: SparkSession, url: str) -> bool:
    """Whether executors can't open the database, as it is embedded in another process than theirs."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://") and not spark.sparkContext.master.startswith("local[")


def host_path(path: str) -> str:
    """A path of the shared folder as the database sees it."""
    scheme, _, rest = path.partition(":")
    if not rest:
        return path
    if scheme != "file":
        raise ValueError(f"an embedded database can't reach {path}: the shared folder has to be mounted")
    return "/" + rest.lstrip("/")


def called(spark: SparkSession, url: str, statement: str, *arguments) -> None:
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        at = connection.prepareCall(statement)
        for i, a in enumerate(arguments, 1):
            at.setString(i, a)
        at.execute()
        at.close()
    finally:
        connection.close()


def unload(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = PARTS) -> DataFrame:
    """A table, or a subquery, by way of files that the database writes; with `by`, one for each part of its range. Null and empty texts stay apart."""
    schema, path, where = spark.read.jdbc(url, table).schema, shared_path(spark, "unloaded"), [""]
    if by is not None:
        connection = spark._jvm.java.sql.DriverManager.getConnection(url)
        try:
            found = connection.createStatement().executeQuery(f'SELECT min("{by}"), max("{by}") FROM {table}')
            found.next()
            low, high = found.getString(1), found.getString(2)
        finally:
            connection.close()
        if low is not None:
            step = (int(high) - int(low)) // parts + 1
            at = [int(low) + step * i for i in range(parts + 1)]
            where = [f' WHERE "{by}" >= {a} AND "{by}" < {b}' for a, b in zip(at[:-1], at[1:], strict=True)] + [f' WHERE "{by}" IS NULL']
    spark._jvm.java.io.File(host_path(path)).mkdirs()
    for i, w in enumerate(where):
        called(spark, url, "CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY(?, ?, ?, ?, ?)", f"SELECT {quoted(schema.names)}, 1 FROM {table}{w}", f"{host_path(path)}/part-{i}.csv", None, None, "UTF-8")
    # a last column, so that no row is a blank line
    return spark.read.schema(schema.add("_end", IntegerType())).csv(path, multiLine=True, lineSep="\n", quote='"', escape='"', nullValue="\x01", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="FAILFAST").drop("_end")


def load(rows: DataFrame, url: str, table: str, types: dict[str, str]) -> None:
    """Makes a table of rows, with columns of the given SQL types, from files that tasks write and the database loads one by one."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "loaded")
    in_transaction(spark, url, [f"CREATE TABLE {table} ({', '.join(f'"{c}" {t}' for c, t in types.items())})"])
    field = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if rows.schema[c].dataType.typeName() == "string" else F.col(c).cast("string")
    rows.select(F.concat_ws(",", *(F.coalesce(field(c), F.lit("")) for c in types)).alias("value")).write.text(path)
    for f in sorted(x.getName() for x in spark._jvm.java.io.File(host_path(path)).listFiles()):
        if f.startswith("part-"):
            called(spark, url, "CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, ?, ?, ?, ?, ?, 0)", None, table.upper(), None, None, f"{host_path(path)}/{f}", None, None, "UTF-8")


def read_table(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = PARTS) -> DataFrame:
    """A table; with `by`, a whole-number column, in parts between its least and largest value. Filters and columns are pushed down."""
    if by_files(spark, url):
        return unload(spark, url, table, by, parts)
    if by is None:
        return spark.read.jdbc(url, table)
    low, high = spark.read.jdbc(url, f'(SELECT min("{by}") AS a, max("{by}") AS b FROM {table}) t').first()
    return spark.read.jdbc(url, table) if low is None else spark.read.jdbc(url, table, column=f'"{by}"', lowerBound=str(low), upperBound=str(high + 1), numPartitions=parts)


def merge(rows: DataFrame, url: str, table: str, types: dict[str, str], batch: str, statement: str) -> bool:
    """Stages rows and runs a statement over {stage} with a note of the batch; False if the batch is there already."""
    spark = rows.sparkSession
    if LEDGER not in table_names(spark, url):
        in_transaction(spark, url, [f"CREATE TABLE {LEDGER} (batch VARCHAR(200) NOT NULL PRIMARY KEY)"])
    name = batch.replace("'", "''")
    if not read_table(spark, url, f"(SELECT batch FROM {LEDGER} WHERE batch = '{name}') t").isEmpty():
        return False
    stage = f"stage_{uuid.uuid4().hex}"
    if by_files(spark, url):
        load(rows.select(*types), url, stage, {c: t.replace(" NOT NULL", "") for c, t in types.items()})
        try:
            in_transaction(spark, url, [statement.format(stage=stage), f"INSERT INTO {LEDGER} VALUES ('{name}')"])
        finally:
            in_transaction(spark, url, [f"DROP TABLE {stage}"])
        return True
    texts = [c for c in types if rows.schema[c].dataType.typeName() == "string"]
    kinds = ", ".join(f"`{c}` {types[c].replace(' NOT NULL', '')}" for c in texts)
    # a null text can't be sent to every database, so it is told by a column of its own
    sent = [F.when(F.col(c).isNotNull(), F.col(c)).otherwise("").alias(c) if c in texts else F.col(c) for c in types]
    w = rows.select(*sent, *(F.col(c).isNull().cast("int").alias(f"{c}_is_null") for c in texts)).write
    nulls = [f'UPDATE {stage} SET "{c}" = NULL WHERE "{c}_is_null" = 1' for c in texts]
    (w.option("createTableColumnTypes", kinds) if kinds else w).jdbc(url, stage, mode="overwrite")
    try:
        in_transaction(spark, url, [*nulls, statement.format(stage=stage), f"INSERT INTO {LEDGER} VALUES ('{name}')"])
    finally:
        in_transaction(spark, url, [f"DROP TABLE {stage}"])
    return True


def upsert(rows: DataFrame, url: str, table: str, types: dict[str, str], keys: list[str], order: list, batch: str) -> bool:
    """New rows replace stored ones of the same key, the first in `order` of several winning."""
    on = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
    rest = [c for c in types if c not in keys]
    change = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'"{c}" = s."{c}"' for c in rest)} " if rest else ""
    statement = f"MERGE INTO {table} t USING {{stage}} s ON {on} {change}WHEN NOT MATCHED THEN INSERT ({quoted(types)}) VALUES ({quoted(types, 's.')})"
    return merge(keep_first(rows, keys, order), url, table, types, batch, statement)


def insert_new(rows: DataFrame, url: str, table: str, types: dict[str, str], keys: list[list[str]], order: list[str], batch: str) -> bool:
    """Adds rows that conflict with no stored row on any of `keys` (each a list of columns), in order of arrival.

    What stored rows refuse can't refuse other rows of the batch, so those go first.
    """
    stored = read_table(rows.sparkSession, url, table)
    left, names = rows, []
    for i, k in enumerate(keys):
        left = left.join(stored.select(*k).dropna().distinct(), k, "left_anti")
        names.append(f"_key{i}")
        left = left.withColumn(f"_key{i}", F.when(~F.greatest(*(F.col(c).isNull().cast("int") for c in (*k, *k))).cast("boolean"), F.to_json(F.struct(*k))))
    kept = first_of_any(left, names, order, blanks=True).drop(*names)
    clash = " OR ".join("(" + " AND ".join(f't."{c}" = s."{c}"' for c in k) + ")" for k in keys)
    statement = f"INSERT INTO {table} ({quoted(types)}) SELECT {quoted(types)} FROM {{stage}} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {clash})"
    return merge(kept, url, table, types, batch, statement)


def latest(spark: SparkSession, url: str, table: str, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: `order` falls."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return read_table(spark, url, table).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
