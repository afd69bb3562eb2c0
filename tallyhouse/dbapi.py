"""A DB-API 2.0 face of an engine in the same process; values are bound as literals, for ? by place and for %(name)s by name."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping
from itertools import islice
from typing import Any

from pyspark.errors import PySparkException

from tallyhouse.engine import Engine
from tallyhouse.refusal import Refused

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Warning(Exception):  # noqa: A001
    """Never raised; PEP 249 names it."""


class Error(Exception):
    """Any failure of a statement; code is the refusal's."""

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        self.code = code


class InterfaceError(Error):
    """Wrong use of this module."""


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    """A value that its field can't hold."""


class OperationalError(DatabaseError):
    """A statement that was stopped, or ran into a limit."""


class IntegrityError(DatabaseError):
    """A name that is taken, or a database that isn't empty."""


class InternalError(DatabaseError):
    """A statement that failed while it ran."""


class ProgrammingError(DatabaseError):
    """A statement that isn't answered."""


class NotSupportedError(DatabaseError):
    pass


#: Which exception a refusal becomes, by its code; any other is a ProgrammingError.
RAISED = {
    "value_out_of_range": DataError, "bad_argument": DataError, "bad_date": DataError, "unknown_member": DataError, "too_precise": DataError, "bad_fact": DataError,
    "result_too_large": OperationalError, "query_cancelled": OperationalError, "catalog_changed": OperationalError, "sql_delete_too_large": OperationalError,
    "table_exists": IntegrityError, "field_exists": IntegrityError, "database_exists": IntegrityError, "role_exists": IntegrityError, "database_not_empty": IntegrityError,
}


class Kind(frozenset):
    """Equal to the type codes that it holds, as PEP 249 asks of its type objects."""

    def __eq__(self, other: object) -> bool:
        return str(other).split("(")[0].split("<")[0] in self

    __hash__ = frozenset.__hash__


STRING, BINARY, ROWID = Kind({"string", "array"}), Kind({"binary"}), Kind({"bigint"})
NUMBER, DATETIME = Kind({"tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"}), Kind({"date", "timestamp", "timestamp_ntz"})
Date, Timestamp, Time, Binary = dt.date, dt.datetime, dt.time, bytes


def DateFromTicks(ticks: float) -> dt.date:  # noqa: N802
    return TimestampFromTicks(ticks).date()


def TimestampFromTicks(ticks: float) -> dt.datetime:  # noqa: N802
    return dt.datetime.fromtimestamp(ticks, dt.timezone.utc).replace(tzinfo=None)


_NAMED = re.compile(r"'(?:[^']|'')*'|%%|%\((\w+)\)s")


def by_place(text: str, values: Mapping[str, Any]) -> tuple[str, list[Any]]:
    """text with ? for each %(name)s outside string literals, and % for %%; and the values in that order."""
    out: list[Any] = []

    def swap(m: re.Match) -> str:
        if m.group(1) is None:
            return "%" if m.group() == "%%" else m.group()
        if m.group(1) not in values:
            raise ProgrammingError(f"no value for {m.group(1)}", "bad_arity")
        out.append(values[m.group(1)])
        return "?"

    return _NAMED.sub(swap, text), out


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._rows: Iterator[Any] = iter(())

    def execute(self, text: str, values: tuple | list | Mapping[str, Any] = ()) -> Cursor:
        c = self.connection
        if c.closed:
            raise InterfaceError("the connection is closed")
        if isinstance(values, Mapping):
            text, values = by_place(text, values)
        try:
            answer = c.engine.sql(c.engine.bound(text, list(values)), database=c.database, role=c.role)
        except Refused as e:
            raise RAISED.get(e.code, ProgrammingError)(str(e), e.code) from e
        except PySparkException as e:
            raise InternalError(str(e)) from e
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in answer.schema]
        # rows come one partition at a time
        self._rows = (tuple(r) for r in answer.toLocalIterator())
        return self

    def executemany(self, text: str, rows: list) -> Cursor:
        for values in rows:
            self.execute(text, values)
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(islice(self._rows, size or self.arraysize))

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self._rows

    def setinputsizes(self, sizes: Any) -> None:
        """Nothing to set."""

    def setoutputsize(self, size: int, column: int | None = None) -> None:
        """Nothing to set."""

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, engine: Engine, database: str | None = None, role: str | None = None):
        self.engine, self.database, self.role, self.closed = engine, database, role, False

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None:
        """Statements take effect one by one."""

    def rollback(self) -> None:
        raise NotSupportedError("statements take effect one by one")

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True


def connect(engine: Engine, database: str | None = None, role: str | None = None) -> Connection:
    return Connection(engine, database, role)
