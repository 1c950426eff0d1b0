"""An SQL engine over versioned tables: queries, changes, and transactions with snapshots.

A table is a list of committed versions. A row has an identity of two numbers, the
statement that inserted it and its place in it. A change is a pair of small tables, rows
that are new or replaced and identities that are gone. A version is a base, written to
the shared folder, and the changes committed since; reading joins them, and only after
MERGE_AFTER changes a new base is written. So a commit costs what it changes.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siskin.operators.graph import saved, shared_dir
from siskin.operators.relational import small

ID = ["_stmt", "_row"]
#: Committed changes that lie over a base before a new base is written.
MERGE_AFTER = 8
ISOLATION = ("READ_UNCOMMITTED", "SNAPSHOT_ISOLATION", "SERIALIZABLE")


class EngineError(Exception):
    """A statement that the engine rejects."""


class TransactionAborted(EngineError):
    """A conflict: the transaction is tainted and can only be rolled back."""


_TYPES = {"bool": T.BooleanType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "int4": T.IntegerType(), "integer": T.IntegerType(), "double": T.DoubleType(), "varchar": T.StringType(), "vector": T.ArrayType(T.DoubleType())}


@dataclass
class Version:
    at: int
    rows: DataFrame
    #: Folders that the rows are read from, and how many changes lie over the base.
    paths: frozenset[str] = frozenset()
    changes: int = 0
    #: Old and new images, with identities, of the rows that this version changed.
    changed: DataFrame | None = None
    image_paths: frozenset[str] = frozenset()


@dataclass
class Table:
    name: str
    schema: T.StructType
    key: list[str] = field(default_factory=list)
    versions: list[Version] = field(default_factory=list)

    def as_of(self, at: int) -> Version:
        return next(v for v in reversed(self.versions) if v.at <= at)


@dataclass
class Change:
    new: DataFrame | None = None
    gone: DataFrame | None = None
    #: The rows that are gone, as they were.
    old: DataFrame | None = None
    paths: frozenset[str] = frozenset()


class Transaction:
    def __init__(self, number: int, at: int, isolation: str):
        self.number, self.at, self.isolation, self.state = number, at, isolation, "RUNNING"
        self.changes: dict[str, Change] = {}
        #: Predicates of what a serializable transaction has read.
        self.read: list[tuple[str, str]] = []


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, tuple[str, str, list[str]]] = {}
        self.views: dict[str, str] = {}
        self.variables = {"global_isolation_level": "SNAPSHOT_ISOLATION"}
        self.clock = self.statements = self.transactions = 0
        self.active: dict[int, Transaction] = {}
        self.current: Transaction | None = None

    # -- reading --------------------------------------------------------------------------

    def rows(self, name: str, txn: Transaction | None = None) -> DataFrame:
        """The table's rows with identities, as the transaction sees them."""
        table = self._table(name)
        rows = table.as_of(txn.at if txn else self.clock).rows
        change = txn.changes.get(table.name) if txn else None
        return self._applied(rows, change) if change else rows

    def table(self, name: str, txn: Transaction | None = None, where: str | None = None) -> DataFrame:
        """The table as the transaction sees it; a serializable one must find what it read unchanged at its end."""
        txn = txn or self.current
        if txn and txn.isolation == "SERIALIZABLE":
            txn.read.append((self._table(name).name, where or "true"))
        rows = self.rows(name, txn).drop(*ID)
        return rows.filter(where) if where else rows

    @staticmethod
    def _applied(rows: DataFrame, change: Change) -> DataFrame:
        out = rows.join(small(change.gone), ID, "left_anti") if change.gone is not None else rows
        return out.unionByName(change.new) if change.new is not None else out

    def _kept(self, df: DataFrame) -> tuple[DataFrame, frozenset[str]]:
        """df written to the shared folder, and where."""
        path = f"{shared_dir(self.spark)}/siskin-{uuid.uuid4().hex}"
        return saved(df, self.spark, path), frozenset([path])

    def _table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise EngineError(f"no table {name}")
        return self.tables[name.lower()]

    # -- tables ---------------------------------------------------------------------------

    def create_table(self, name: str, schema: T.StructType, key: list[str] | None = None) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            raise EngineError(f"table {name} exists")
        key = [k.lower() for k in key or []]
        for k in key:
            if not isinstance(schema[[f.name for f in schema if f.name.lower() == k][0]].dataType, T.IntegerType):
                raise EngineError("a primary key is of integers")
        if len(key) > 2:
            raise EngineError("a primary key has one column or two")
        full = T.StructType([*schema.fields, T.StructField("_stmt", T.LongType()), T.StructField("_row", T.LongType())])
        self.tables[name.lower()] = Table(name.lower(), schema, key, [Version(self.clock, self.spark.createDataFrame([], full))])

    def create_index(self, name: str, table: str, columns: list[str]) -> None:
        """Recorded only: scans find rows by the statistics of Parquet row groups."""
        schema = {f.name.lower(): f.dataType for f in self._table(table).schema}
        if not 1 <= len(columns) <= 2 or any(not isinstance(schema.get(c.lower()), T.IntegerType) for c in columns):
            raise EngineError("an index is over one or two integer columns")
        if name.lower() in self.indexes:
            raise EngineError(f"index {name} exists")
        self.indexes[name.lower()] = (name, table.lower(), columns)

    # -- changes --------------------------------------------------------------------------

    def insert(self, name: str, rows: DataFrame, txn: Transaction | None = None) -> int:
        """Add rows by position; the number added. Number and types of columns must fit."""
        table = self._table(name)
        if len(rows.columns) != len(table.schema):
            raise EngineError(f"{len(table.schema)} columns expected, {len(rows.columns)} given")
        for have, want in zip(rows.schema, table.schema, strict=True):
            if have.dataType != want.dataType and not isinstance(have.dataType, T.NullType) and not self._widens(have.dataType, want.dataType):
                raise EngineError(f"{want.name} is {want.dataType.simpleString()}, not {have.dataType.simpleString()}")
        self.statements += 1
        new = rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, table.schema, strict=True)))
        new, paths = self._kept(new.withColumns({"_stmt": F.lit(self.statements).cast("long"), "_row": F.monotonically_increasing_id()}))
        return self._within(txn, lambda t: self._write(t, table, Change(new=new, paths=paths)))

    @staticmethod
    def _widens(have: T.DataType, want: T.DataType) -> bool:
        if isinstance(want, T.ArrayType):
            return isinstance(have, T.ArrayType)
        return isinstance(want, T.DoubleType) and isinstance(have, (T.DecimalType, T.FloatType, T.IntegerType)) or isinstance(want, T.IntegerType) and isinstance(have, (T.ShortType, T.ByteType))

    def update(self, name: str, assign: dict[str, str], where: str = "true", txn: Transaction | None = None) -> int:
        """Set columns to SQL expressions over the old row, where the predicate is true; rows changed."""
        table = self._table(name)
        known = {f.name.lower(): f for f in table.schema}
        assign = {c.lower(): e for c, e in assign.items()}
        if set(assign) - set(known):
            raise EngineError(f"no column {sorted(set(assign) - set(known))}")

        def run(t: Transaction) -> int:
            hit = self.rows(name, t).filter(where)
            after = [(F.expr(assign[f.name.lower()]).cast(f.dataType) if f.name.lower() in assign else F.col(f.name)).alias(f"_new_{i}") for i, f in enumerate(table.schema)]
            t.read.append((table.name, where))
            # one pass: rows as they were and as they are to be
            both, paths = self._kept(hit.select(*table.schema.names, *ID, *after))
            old, new = both.select(*table.schema.names, *ID), both.select(*(F.col(f"_new_{i}").alias(f.name) for i, f in enumerate(table.schema)), *ID)
            return self._write(t, table, Change(new, both.select(*ID), old, paths))

        return self._within(txn, run)

    def delete(self, name: str, where: str = "true", txn: Transaction | None = None) -> int:
        """Remove rows where the predicate is true; rows removed."""
        table = self._table(name)

        def run(t: Transaction) -> int:
            t.read.append((table.name, where))
            old, paths = self._kept(self.rows(name, t).filter(where))
            return self._write(t, table, Change(None, old.select(*ID), old, paths))

        return self._within(txn, run)

    def _within(self, txn: Transaction | None, run) -> int:
        """Run in the given or current transaction, else in one of its own."""
        txn = txn or self.current
        if txn:
            if txn.state != "RUNNING":
                raise TransactionAborted(f"transaction {txn.number} is {txn.state.lower()}")
            return run(txn)
        txn = self.begin()
        try:
            n = run(txn)
            self.commit(txn)
            return n
        except Exception:
            if txn.state in ("RUNNING", "TAINTED"):
                self.abort(txn)
            raise

    def _write(self, txn: Transaction, table: Table, change: Change) -> int:
        new, gone = change.new, change.gone
        if gone is not None and self._taken(txn, table, gone):
            txn.state = "TAINTED"
            raise TransactionAborted(f"a row of {table.name} was written by another transaction")
        had = txn.changes.get(table.name, Change())
        both = lambda a, b: a.unionByName(b) if a is not None and b is not None else b if a is None else a
        kept = had.new.join(small(gone), ID, "left_anti") if had.new is not None and gone is not None else had.new
        merged = Change(both(kept, new), both(had.gone, gone), both(had.old, change.old), had.paths | change.paths)
        if table.key and new is not None and self._twice(self._applied(table.as_of(txn.at).rows, merged), new, table.key):
            txn.state = "TAINTED"
            raise TransactionAborted(f"a primary key of {table.name} would be used twice")
        txn.changes[table.name] = merged
        return (new if new is not None else gone).count()

    @staticmethod
    def _twice(rows: DataFrame, new: DataFrame, key: list[str]) -> bool:
        """Whether rows use a key of the new ones more than once; other keys are not looked at."""
        touched = rows.join(small(new.select(*key).distinct()), key, "left_semi")
        return not touched.groupBy(*key).count().filter("count > 1").isEmpty()

    def _taken(self, txn: Transaction, table: Table, rows: DataFrame) -> bool:
        """Whether any of the rows was written by a transaction this one does not see."""
        others = [c.gone for t in self.active.values() if t is not txn and (c := t.changes.get(table.name)) and c.gone is not None]
        others += [v.changed.select(*ID) for v in table.versions if v.at > txn.at and v.changed is not None]
        return any(not rows.join(small(o), ID, "left_semi").isEmpty() for o in others)

    # -- transactions ---------------------------------------------------------------------

    def begin(self, isolation: str | None = None) -> Transaction:
        self.transactions += 1
        isolation = (isolation or self.variables["global_isolation_level"]).upper()
        if isolation not in ISOLATION:
            raise EngineError(f"no isolation level {isolation}")
        txn = self.active[self.transactions] = Transaction(self.transactions, self.clock, isolation)
        return txn

    def commit(self, txn: Transaction) -> None:
        """Publish the changes; a serializable transaction's reads must still hold."""
        if txn.state != "RUNNING":
            raise TransactionAborted(f"transaction {txn.number} is {txn.state.lower()}")
        if txn.isolation == "SERIALIZABLE" and txn.changes and not self._still_holds(txn):
            self.abort(txn)
            raise TransactionAborted(f"what transaction {txn.number} read has changed")
        gone = [name for name in txn.changes if name not in self.tables]
        if gone:
            self.abort(txn)
            raise TransactionAborted(f"table {gone[0]} was dropped")
        for name, change in txn.changes.items():
            table = self.tables[name]
            # without a commit in between, the statement's own check still holds
            if table.key and change.new is not None and table.versions[-1].at > txn.at and self._twice(self._applied(table.versions[-1].rows, change), change.new, table.key):
                self.abort(txn)
                raise TransactionAborted(f"a primary key of {name} would be used twice")
        self.clock += 1
        for name, change in txn.changes.items():
            table = self.tables[name]
            latest = table.versions[-1]
            rows, paths, changes = self._applied(latest.rows, change), latest.paths | change.paths, latest.changes + 1
            if changes > MERGE_AFTER:
                (rows, paths), changes = self._kept(rows), 0
            images = change.new if change.old is None else change.old if change.new is None else change.old.unionByName(change.new)
            table.versions.append(Version(self.clock, rows, paths, changes, images, change.paths))
        txn.state = "COMMITTED"
        self._over(txn)

    def _still_holds(self, txn: Transaction) -> bool:
        for name, where in txn.read:
            for v in self.tables[name].versions if name in self.tables else []:
                if v.at > txn.at and v.changed is not None and not v.changed.filter(where).isEmpty():
                    return False
        return True

    def abort(self, txn: Transaction) -> None:
        txn.state = "ABORTED"
        self._over(txn)

    def _over(self, txn: Transaction) -> None:
        self.active.pop(txn.number, None)
        if self.current is txn:
            self.current = None

    def collect_garbage(self) -> int:
        """Forget versions that no running transaction can see, and delete files that only they read; how many versions."""
        oldest = min((t.at for t in self.active.values()), default=self.clock)
        before, n = self._files(), 0
        for table in self.tables.values():
            seen = table.as_of(oldest).at
            kept = [v for v in table.versions if v.at >= seen]
            n += len(table.versions) - len(kept)
            kept[0].changed, kept[0].image_paths = None, frozenset()  # who runs sees this version
            table.versions = kept
        self._remove(before - self._files())
        return n

    def _files(self) -> set[str]:
        """Folders that versions and running changes read."""
        versions = [v for table in self.tables.values() for v in table.versions]
        return {p for v in versions for p in v.paths | v.image_paths} | {p for t in self.active.values() for c in t.changes.values() for p in c.paths}

    def _remove(self, paths: set[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_table(self, name: str) -> None:
        """Remove a table, its indexes and, where no transaction is running, its files."""
        table, before = self._table(name), self._files()
        del self.tables[table.name]
        self.indexes = {k: v for k, v in self.indexes.items() if v[1] != table.name}
        if not self.active:
            self._remove(before - self._files())

    def merge(self, name: str, source: DataFrame, on: str, matched: list[tuple[str, dict[str, str] | None]], unmatched: list[str] | None, alias: str = "", txn: Transaction | None = None) -> int:
        """Change rows of a table that a row of source meets, and insert what meets none; rows changed.

        on, conditions and expressions are SQL over the table's columns (under its name or
        alias) and source's (as aliased there). matched lists (condition, assignments, or None
        to delete); the first that holds decides. A row met by two rows of source is an error.
        """
        table = self._table(name)
        target = alias or table.name

        def run(t: Transaction) -> int:
            t.read.append((table.name, "true"))
            rows = self.rows(name, t).alias(target)
            met = rows.join(source, F.expr(on))
            which = F.lit(None).cast("int")
            for i, (condition, _) in reversed(list(enumerate(matched))):
                which = F.when(F.expr(condition), F.lit(i)).otherwise(which)
            old = [F.col(f"{target}.{c}").alias(c) for c in [*table.schema.names, *ID]]
            after = []
            for j, f in enumerate(table.schema):
                value = F.col(f"{target}.{f.name}")
                for i, (_, assign) in enumerate(matched):
                    told = {k.lower(): v for k, v in (assign or {}).items()}.get(f.name.lower())
                    value = F.when(which == i, F.expr(told).cast(f.dataType)).otherwise(value) if told else value
                after.append(value.alias(f"_new_{j}"))
            both, paths = self._kept(met.select(*old, *after, which.alias("_which")).filter("_which is not null"))
            if not both.groupBy(*ID).count().filter("count > 1").isEmpty():
                raise EngineError("a row is met by several rows")
            deleting = [i for i, (_, assign) in enumerate(matched) if assign is None]
            new = both.filter(~F.col("_which").isin(deleting)) if deleting else both
            new = new.select(*(F.col(f"_new_{j}").alias(f.name) for j, f in enumerate(table.schema)), *ID)
            n = both.count()
            added = None
            if unmatched is not None:
                self.statements += 1
                missing = source.join(rows, F.expr(on), "left_anti").select(*(F.expr(e).cast(f.dataType).alias(f.name) for e, f in zip(unmatched, table.schema, strict=True)))
                added, more = self._kept(missing.withColumns({"_stmt": F.lit(self.statements).cast("long"), "_row": F.monotonically_increasing_id()}))
                paths |= more
                n += added.count()
            self._write(t, table, Change(new.unionByName(added) if added is not None else new, both.select(*ID), both.select(*table.schema.names, *ID), paths))
            return n

        return self._within(txn, run)

    # -- statements -----------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame | None:
        """Run statements separated by semicolons; the last one's result."""
        out = None
        for statement in _split(text):
            out = self._statement(statement)
        return out

    def _one(self, name: str, value) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"`{name}` {'bigint' if isinstance(value, int) else 'string'}")

    def _statement(self, s: str) -> DataFrame | None:
        word = s.split(None, 1)[0].lower()
        run = {"insert": self._insert, "update": self._update, "delete": self._delete, "create": self._create, "drop": self._drop, "merge": self._merge, "set": self._set, "show": self._show, "explain": self._explain}
        if s.startswith("\\"):
            return self._meta(s)
        if word in run:
            return run[word](s)
        if word in ("begin", "start"):
            if self.current:
                raise EngineError("a transaction is running")
            self.current = self.begin()
            return None
        if word in ("commit", "rollback", "abort"):
            if not self.current:
                raise EngineError("no transaction is running")
            (self.commit if word == "commit" else self.abort)(self.current)
            return None
        if word in ("select", "with", "values", "("):
            return self.query(s)
        raise EngineError(f"{word} is not supported")

    def query(self, s: str) -> DataFrame:
        """A query over the engine's tables as the current transaction sees them, and over its views."""
        for name in self.tables:
            if re.search(rf"\b{re.escape(name)}\b", s, re.I):
                where = re.fullmatch(rf"\s*select\s+.*?\s+from\s+{re.escape(name)}\s+where\s+(.*?)\s*", s, re.I | re.S)
                simple = where and not re.search(r"\b(group|order|limit|having|union|join|select)\b", where[1], re.I)
                if self.current and self.current.isolation == "SERIALIZABLE":
                    self.current.read.append((name, where[1] if simple else "true"))
                self.rows(name, self.current).drop(*ID).createOrReplaceTempView(name)
        for name, text in self.views.items():
            if re.search(rf"\b{re.escape(name)}\b", s, re.I):
                self.query(text).createOrReplaceTempView(name)
        return self.spark.sql(s)

    def _insert(self, s: str) -> DataFrame:
        m = re.fullmatch(r"insert\s+into\s+(\w+)\s+((?:select|values|with|\().*)", s, re.I | re.S)
        if not m or (m[2].startswith("(") and not re.match(r"\(\s*(select|values|with)\b", m[2], re.I)):
            raise EngineError("INSERT INTO table VALUES or SELECT, without a list of columns")
        return self._one("insert_rows", self.insert(m[1], self.query(m[2])))

    def _update(self, s: str) -> DataFrame:
        m = re.fullmatch(r"update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?", s, re.I | re.S)
        if not m or re.search(r"\bfrom\b", m[2], re.I):
            raise EngineError("UPDATE table SET column = value WHERE condition")
        parts = [p.partition("=") for p in _split(m[2], ",")]
        return self._one("update_rows", self.update(m[1], {c.strip(): e.strip() for c, _, e in parts}, m[3] or "true"))

    def _delete(self, s: str) -> DataFrame:
        m = re.fullmatch(r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", s, re.I | re.S)
        if not m:
            raise EngineError("DELETE FROM table WHERE condition")
        return self._one("delete_rows", self.delete(m[1], m[2] or "true"))

    def _create(self, s: str) -> None:
        m = re.fullmatch(r"create\s+index\s+(\w+)\s+on\s+(\w+)\s*(?:using\s+(\w+)\s*)?\(([^)]*)\)", s, re.I)
        if m:
            if m[3] and m[3].lower() not in ("bplustree", "hash", "stl_ordered", "stl_unordered"):
                raise EngineError(f"no kind of index {m[3]}")
            return self.create_index(m[1], m[2], [c.strip() for c in m[4].split(",")])
        m = re.fullmatch(r"create\s+view\s+(\w+)\s+as\s+(.*)", s, re.I | re.S)
        if m:
            if m[1].lower() in self.tables or m[1].lower() in self.views:
                raise EngineError(f"{m[1]} exists")
            self.query(m[2])  # a view that cannot be planned is rejected
            self.views[m[1].lower()] = m[2]
            return None
        if re.match(r"create\s+function\b", s, re.I):
            self.spark.sql(re.sub(r"^create\s+function", "CREATE OR REPLACE TEMPORARY FUNCTION", s, flags=re.I))
            return None
        m = re.fullmatch(r"create\s+table\s+(\w+)\s*\((.*)\)", s, re.I | re.S)
        if not m:
            raise EngineError("CREATE TABLE, INDEX, VIEW or FUNCTION")
        fields, key = [], []
        for part in _split(m[2], ","):
            if k := re.fullmatch(r"primary\s+key\s*\((.*)\)", part, re.I):
                key = [c.strip() for c in k[1].split(",")]
                continue
            c = re.fullmatch(r"(\w+)\s+(\w+)(\s*\(\s*\d+\s*\))?(\s+primary\s+key)?", part, re.I)
            kind = c and _TYPES.get(c[2].lower())
            if not kind or (c[2].lower() in ("varchar", "vector")) != bool(c[3]):
                raise EngineError(f"unsupported column: {part}")
            fields.append(T.StructField(c[1], kind))
            key += [c[1]] if c[4] else []
        return self.create_table(m[1], T.StructType(fields), key)

    def _drop(self, s: str) -> None:
        m = re.fullmatch(r"drop\s+(table|view|index)\s+(if\s+exists\s+)?(\w+)", s, re.I)
        if not m:
            raise EngineError("DROP TABLE, VIEW or INDEX name")
        kind, name = m[1].lower(), m[3].lower()
        held = {"table": self.tables, "view": self.views, "index": self.indexes}[kind]
        if name not in held:
            if m[2]:
                return
            raise EngineError(f"no {kind} {m[3]}")
        if kind == "table":
            self.drop_table(name)
        else:
            del held[name]

    def _merge(self, s: str) -> DataFrame:
        m = re.fullmatch(r"merge\s+into\s+(\w+)(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s+(\(.*?\)|\w+)\s*(?:\s(?:as\s+)?(?!on\b)(\w+))?\s+on\s+(.*?)(\s+when\s+.*)", s, re.I | re.S)
        if not m:
            raise EngineError("MERGE INTO table USING source ON condition WHEN ...")
        matched, unmatched = [], None
        for clause in re.split(r"\s+when\s+", m[6], flags=re.I)[1:]:
            if c := re.fullmatch(r"matched(?:\s+and\s+(.*?))?\s+then\s+(?:update\s+set\s+(.*)|(delete))\s*", clause, re.I | re.S):
                assign = None if c[3] else {k.strip().rpartition(".")[2]: v.strip() for k, _, v in (p.partition("=") for p in _split(c[2], ","))}
                matched.append((c[1] or "true", assign))
            elif c := re.fullmatch(r"not\s+matched\s+then\s+insert\s+values\s*\((.*)\)\s*", clause, re.I | re.S):
                unmatched = _split(c[1], ",")
            else:
                raise EngineError("WHEN MATCHED [AND condition] THEN UPDATE SET or DELETE, WHEN NOT MATCHED THEN INSERT VALUES")
        if unmatched is not None and len(unmatched) != len(self._table(m[1]).schema):
            raise EngineError(f"{len(self._table(m[1]).schema)} values expected")
        source = self.query(f"SELECT * FROM {m[3]}").alias(m[4] or (m[3] if not m[3].startswith("(") else "source"))
        return self._one("merge_rows", self.merge(m[1], source, m[5], matched, unmatched, m[2] or ""))

    def register(self, name: str, function, returns: str) -> None:
        """Make a function of pandas Series available in SQL under a name; it runs on Arrow batches."""
        self.spark.udf.register(name, F.pandas_udf(function, returns))

    def _set(self, s: str) -> None:
        m = re.fullmatch(r"set\s+([\w.]+)\s*(?:=|\bto\b)\s*(.+)", s, re.I)
        if not m:
            raise EngineError("SET name = value")
        self.variables[m[1].lower()] = m[2].strip().strip("'\"")

    def _show(self, s: str) -> DataFrame:
        name = s.split(None, 1)[1].strip().lower()
        return self._one(name, str(self.variables.get(name, "")))

    def _explain(self, s: str) -> DataFrame:
        """Plans as text: (b)ound, (p)lanned, (o)ptimized, (s) physical; all by default."""
        m = re.fullmatch(r"explain\s*(?:\(([\w,\s]*)\))?\s*(.*)", s, re.I | re.S)
        execution = self.query(m[2])._jdf.queryExecution()
        plans = {"b": execution.logical, "p": execution.analyzed, "o": execution.optimizedPlan, "s": execution.executedPlan}
        wanted = [x.strip()[:1].lower() for x in (m[1] or "").split(",") if x.strip()] or list(plans)
        if set(wanted) - set(plans):
            raise EngineError("EXPLAIN (b, p, o, s)")
        return self._one("plan", "\n".join(str(plans[x]().toString()) for x in wanted))

    def _meta(self, s: str) -> DataFrame:
        word, *rest = s[1:].split()
        if word == "dt":
            rows = [(t.name, ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in t.schema)) for t in self.tables.values()]
        elif word == "di":
            rows = [(t, f"{name}({', '.join(cols)})") for name, t, cols in self.indexes.values()]
        elif word == "dbgmvcc":
            rows = [(rest[0], f"version {v.at}: {v.rows.count()} rows") for v in self._table(rest[0]).versions]
        elif word == "txn":
            if rest == ["gc"]:
                rows = [("gc", str(self.collect_garbage()))]
            elif rest == ["-1"]:
                self.current, rows = None, [("txn", "none")]
            elif rest:
                self.current = self.active[int(rest[0])]
                rows = [(rest[0], self.current.state)]
            else:
                rows = [(str(t.number), f"{t.state} at {t.at} {t.isolation}") for t in self.active.values()]
        elif word == "help":
            rows = [("\\dt", "tables"), ("\\di", "indexes"), ("\\dbgmvcc table", "versions"), ("\\txn [gc | id | -1]", "transactions")]
        else:
            raise EngineError(f"no command \\{word}")
        return self.spark.createDataFrame(rows, "name string, told string")


def _split(text: str, at: str = ";") -> list[str]:
    """Parts of a text between `at`, outside of quotes and brackets; comments go."""
    out, part, depth, quote = [], "", 0, ""
    text = re.sub(r"--[^\n]*", "", text)
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == at and depth == 0:
            out.append(part.strip())
            part = ""
            continue
        part += c
    return [p for p in [*out, part.strip()] if p]
