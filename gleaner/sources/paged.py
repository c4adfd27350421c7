"""A listing that is served by pages, newest first, as a stream: pulled up to the first known item, so many items a run."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gleaner.sources.readers import is_complete, latest_version, store, write_versioned

#: Pages that a reader holds while it searches.
HELD = 32


class LandedPages:
    """A client of pages that were landed as lines of JSON in ``path``/page=1, 2, ...; beyond the last one pages are empty."""

    def __init__(self, options: dict):
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(options["path"])

    def page(self, number: int) -> list[dict]:
        found = self.files.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/page={number}", allow_not_found=True))
        items = []
        for f in sorted((f for f in found if not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            with self.files.open_input_stream(f.path) as s:
                items += [json.loads(line) for line in s.read().decode().split("\n") if line]
        return items


class Listing:
    """Searches a client's pages by key. Pages may move on while it does, as new items come in at the head: it only ever walks forwards,
    where an item can come twice but none is missed, and takes an item only if it is older than the last one. A walk ends as long as fewer
    items come in during a fetch than a page holds."""

    def __init__(self, client, key: list[str]):
        self.client, self.key, self.held = client, key, {}

    def items(self, number: int, anew: bool = False) -> list[tuple[list, dict]] | None:
        """A page's items that have a key, with it; None beyond the end."""
        if anew or number not in self.held:
            raw = self.client.page(number)
            keyed = [([i.get(k) for k in self.key], i) for i in raw]
            keyed = [(k, i) for k, i in keyed if None not in k]
            if any(a[0] < b[0] for a, b in zip(keyed, keyed[1:])):
                raise ValueError(f"page {number} is not newest first")
            self.held.pop(number, None)
            self.held[number] = keyed if raw else None
            if len(self.held) > HELD:
                self.held.pop(next(iter(self.held)))
        return self.held[number]

    def reaches(self, number: int, mark: list | None) -> bool:
        """Whether the listing up to a page's end has come to the mark: to items that are not newer."""
        while (items := self.items(number)) is not None:
            if items:
                return mark is not None and items[-1][0] <= mark
            number += 1
        return True

    def first_page(self, mark: list | None) -> int:
        """The first page that reaches the mark: twice as far each time, then by halves."""
        high = 1
        while not self.reaches(high, mark):
            high *= 2
        low = high // 2 + 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.reaches(middle, mark) else (middle + 1, high)
        return high

    def between(self, low: list | None, high: list | None, start: int) -> Iterator[tuple[list, dict]]:
        """Items above low and not above high (None: no bound), newest first, from a page on."""
        last, number = None, start
        while (items := self.items(number, True)) is not None:
            for key, item in items:
                if low is not None and key <= low:
                    return
                if (high is None or key <= high) and (last is None or key < last):
                    last = key
                    yield key, item
            number += 1

    def end_of_run(self, mark: list | None, most: int | None) -> list | None:
        """The newest key of a run: the oldest ``most`` unknown items, or all of them. The mark if nothing is unknown."""
        self.held.clear()
        if not most:
            return next((k for k, _ in self.between(mark, None, 1)), mark)
        until, back = self.first_page(mark), 1
        while True:
            start = max(1, until - back)
            oldest = deque((k for k, _ in self.between(mark, None, start)), most)
            if len(oldest) == most or start == 1:
                return oldest[0] if oldest else mark
            back *= 2

    def ranges(self, low: list | None, high: list, tasks: int) -> list[tuple]:
        """(low, high] in up to so many ranges of keys, cut where pages begin."""
        self.held.clear()
        first, last = self.first_page(high), self.first_page(low)
        out = []
        for number in range(first, last, max(1, -(-(last - first) // tasks)))[1:]:
            items = self.items(number)
            if items and items[0][0] < high and (low is None or items[0][0] > low):
                out.append((items[0][0], high))
                high = items[0][0]
        return [*out, (low, high)]


class PagedReader(DataSourceStreamReader):
    """Offsets are keys, which stay what they are when pages move; so a batch that is run again has the same items."""

    def __init__(self, client: Callable, options: dict, names: list[str]):
        self.make, self.options, self.names = client, options, names
        self.most, self.tasks = int(options.get("most", "0")), int(options.get("tasks", "8"))
        self.taken = self.key_of({"key": options.get("after", "")})

    def listing(self) -> Listing:
        return Listing(self.make(self.options), self.options["key"].split(","))

    @staticmethod
    def key_of(offset: dict) -> list | None:
        return json.loads(offset["key"]) if offset["key"] else None

    @staticmethod
    def offset_of(key: list | None) -> dict:
        return {"key": "" if key is None else json.dumps(key)}

    def initialOffset(self) -> dict:  # noqa: N802 (Spark's names)
        return self.offset_of(self.taken)

    def latestOffset(self) -> dict:  # noqa: N802
        return self.offset_of(self.listing().end_of_run(self.taken, self.most))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = self.key_of(start), self.key_of(end)
        if high is None or (low is not None and high <= low):
            return []
        if self.taken is None or high > self.taken:
            self.taken = high
        return [InputPartition(r) for r in self.listing().ranges(low, high, self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        (low, high), pages = partition.value, self.listing()
        for _, item in pages.between(low, high, pages.first_page(high)):
            yield tuple(item.get(n) for n in self.names)


def paged_source(name: str, client: Callable) -> type[DataSource]:
    """A streaming source over client(options), whose page(n), from 1 on, gives dicts, newest first, and none beyond the end.

    Options: key (columns, comma-joined, that together order the items and tell them apart), after (the newest known key, as JSON), most
    (items a run; 0: all), tasks (of a batch), and the client's own. The driver looks at some pages only (twice the logarithm of their
    number, one a task, and those of ``most`` items); tasks read the rest, each its own range of keys.

    Items without a key are left out; an item that comes twice is one. An item that is older than a known one when it first appears counts as
    known. An empty listing gives no batch. Keys must be numbers or strings, and items must stay in the listing until they are pulled.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamReader(self, schema) -> PagedReader:  # noqa: N802
            return PagedReader(client, dict(self.options), schema.fieldNames())

    return Paged


def pull(spark: SparkSession, source: type[DataSource], schema: str, key: list[str], state: str, checkpoint: str, after: list | None = None, most: int = 0, **options: str) -> None:
    """One run: items newer than what ``state`` has (than ``after`` at first), the oldest ``most`` of them, as its next version.

    A run that was torn is done again, with the same items, before new ones are taken. A first run that finds nothing is an empty version.
    ``state`` and ``checkpoint`` belong together.
    """
    spark.dataSource.register(source)
    fs, folder = store(spark, state)
    if fs.exists(folder):
        rows = latest_version(spark, state, spark.createDataFrame([], schema))
        newest = rows.agg(F.max(F.struct(*key)).alias("k")).first().k
        after = list(newest) if newest is not None else after
    reader = spark.readStream.format(source.name()).schema(schema).options(key=",".join(key), after="" if after is None else json.dumps(after), most=str(most), **options)

    def keep(batch: DataFrame, number: int) -> None:
        write_versioned(batch, state, number)

    reader.load().writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pulled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All items that complete runs have taken, with the run's number; torn ones are passed over."""
    fs, folder = store(spark, path)
    found = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    whole = [f"{path}/{n}" for n in found if n.startswith("v=") and is_complete(spark, f"{path}/{n}")]
    if not whole:
        return spark.createDataFrame([], f"{schema}, run long")
    return spark.read.option("basePath", path).schema(f"{schema}, v long").parquet(*whole).withColumnRenamed("v", "run")
