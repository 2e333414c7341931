"""Arrow Flight SQL as a Spark data source: a query's endpoints are read side by side, as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: Fixed value: the type of a statement in the Flight SQL protocol.
_STATEMENT = "type.googleapis.com/arrow.flight.protocol.sql.CommandStatementQuery"


def _field(number: int, value: bytes) -> bytes:
    """A length-delimited field of a protocol buffer."""
    size, out = len(value), bytearray([number << 3 | 2])
    while size > 127:
        out.append(size & 127 | 128)
        size >>= 7
    out.append(size)
    return bytes(out) + value


def command(query: str) -> bytes:
    return _field(1, _STATEMENT.encode()) + _field(2, _field(1, query.encode()))


class _Endpoint(InputPartition):
    def __init__(self, ticket: bytes, locations: list[str]):
        self.ticket, self.locations = ticket, locations


class FlightSql(DataSource):
    """Options: uri of the server, query."""

    @classmethod
    def name(cls) -> str:
        return "lakemill_flight_sql"

    def _info(self):
        from pyarrow import flight

        with flight.connect(self.options["uri"]) as client:
            return client.get_flight_info(flight.FlightDescriptor.for_command(command(self.options["query"])))

    def schema(self):
        return from_arrow_schema(self._info().schema)

    def reader(self, schema) -> DataSourceReader:
        info = self._info()
        places = [_Endpoint(e.ticket.ticket, [x.uri.decode() for x in e.locations]) for e in info.endpoints]
        return _Reader(self.options["uri"], places)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, places: list[_Endpoint]):
        self.uri, self.places = uri, places

    def partitions(self) -> list[_Endpoint]:
        return self.places

    def read(self, partition: _Endpoint) -> Iterator[pa.RecordBatch]:
        from pyarrow import flight

        with flight.connect(next(iter(partition.locations), self.uri)) as client:
            for chunk in client.do_get(flight.Ticket(partition.ticket)):
                yield chunk.data
