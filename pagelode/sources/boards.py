"""Listing boards as a source of Spark's own: spark.read.format("boards") over a transport that the caller gives.

A transport is a callable (provider, board, offset) -> a page of JSON text, or null for a board that doesn't answer. Each board is a
partition, read page after page up to its stop rule inside the task: a short page, an empty one, or a null one ends it. Filters on provider and
board (=, IN) are pushed down: boards that they leave out are neither planned nor asked. As a stream, an offset is how many pages of each
board are known: a batch has each board's pages that have come since.

Rows: provider, board, offset, page (the JSON text). An error of a transport is the query's; a board given twice is read once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from pagelode.functions.shipping import ship_package

#: (provider, board, offset) -> JSON text of a page.
Transport = Callable[[str, str, int], str | None]

BOARD_PAGE = "provider string, board string, offset long, page string"
#: Listings of a full page: a shorter one is the last.
PAGE_SIZE = 100


class BoardPages(InputPartition):
    """A board's pages from an offset, up to one (None: to its end)."""

    def __init__(self, provider: str, board: str, start: int = 0, end: int | None = None) -> None:
        self.provider, self.board, self.start, self.end = provider, board, start, end


def listed(page: str) -> int:
    """How many listings a page has: of its array, or of the first array among its fields."""
    try:
        value = json.loads(page)
    except ValueError:
        return 0
    found = value if isinstance(value, list) else next((v for v in value.values() if isinstance(v, list)), []) if isinstance(value, dict) else []
    return len(found)


def pages_of(transport: Transport, size: int, part: BoardPages) -> Iterator[tuple[str, str, int, str]]:
    offset = part.start
    while part.end is None or offset < part.end:
        page = transport(part.provider, part.board, offset)
        count = 0 if page is None else listed(page)
        if not count:
            return
        yield part.provider, part.board, offset, page
        if count < size:
            return
        offset += size


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, boards: list[tuple[str, str]], size: int) -> None:
        self.transport, self.boards, self.size = transport, boards, size

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else ""
            if name not in ("provider", "board"):
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            place = ("provider", "board").index(name)
            self.boards = [b for b in self.boards if b[place] in wanted]

    def partitions(self) -> list[BoardPages]:
        return [BoardPages(*b) for b in self.boards]

    def read(self, partition: BoardPages) -> Iterator[tuple]:
        if partition is not None and isinstance(partition, BoardPages):
            yield from pages_of(self.transport, self.size, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are JSON objects of board to the offset behind its last full page."""

    def __init__(self, transport: Transport, boards: list[tuple[str, str]], size: int) -> None:
        self.transport, self.boards, self.size = transport, boards, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {json.dumps(b): 0 for b in self.boards}

    def latestOffset(self) -> dict:  # noqa: N802
        """Only the pages' sizes are asked for here, from where the last offset left off."""
        known = getattr(self, "_known", None) or self.initialOffset()
        for key, offset in known.items():
            while (page := self.transport(*json.loads(key), offset)) is not None and listed(page) >= self.size:
                offset += self.size
            known[key] = offset
        self._known = known
        return dict(known)

    def partitions(self, start: dict, end: dict) -> list[BoardPages]:
        return [BoardPages(*json.loads(k), start.get(k, 0), to) for k, to in end.items() if to > start.get(k, 0)]

    def read(self, partition: BoardPages) -> Iterator[tuple]:
        yield from pages_of(self.transport, self.size, partition)


def board_source(transport: Transport, boards: Iterable[tuple[str, str]], size: int = PAGE_SIZE, name: str = "boards") -> type[DataSource]:
    """A source over these (provider, board)s; a stream takes full pages only, since a short one may still grow."""
    known = list(dict.fromkeys((str(p), str(b)) for p, b in boards))

    class Boards(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BOARD_PAGE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(transport, known, size)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(transport, known, size)

    return Boards


def register(spark: SparkSession, transport: Transport, boards: Iterable[tuple[str, str]], size: int = PAGE_SIZE, name: str = "boards") -> None:
    """Makes the boards readable as format(name), with filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(board_source(transport, boards, size, name))
