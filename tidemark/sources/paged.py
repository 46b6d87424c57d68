"""Paged scans of a catalogue as a Spark data source: folders of page files, one folder a chain, followed by cursor or by offset.

A page is a JSON file.  Cursor pages are named by their cursor (the first is ``start``) and hold ``items``, ``next`` (null at the end) and
maybe ``partial``; offset pages are named by their offset and hold ``items``, ``start`` and ``total``.  A partition of the source holds a bounded
number of chains and streams them page by page, so neither a chain nor the list of items is ever whole in memory.  Chains that are asked for by name
(``chains``) are the only ones listed and read, and only the fields of the read schema are taken from an item.  The names are an option, not a
pushed filter: Spark keeps what a Python reader planned with the table, so that a filter of one plan would hide rows from another plan of the same
DataFrame.

A partial page, a cursor that is no text, empty or was followed before, an offset page that is empty before the total, a total that changes and an
item without a field that the schema calls NOT NULL end the read.  Later items of one key win; that is ``last_of_each``, by an aggregation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.store import filesystem

#: Pages of cursor scans and of offset scans hold so many items; partitions of a scan at most.
CURSOR_PAGE, OFFSET_PAGE, PARTITIONS = 500, 1000, 256
#: Columns that the source itself gives.
OWN = ("chain", "page", "position")


class PageError(ValueError):
    """A chain of pages that cannot be followed to its end."""


class Chains(InputPartition):
    def __init__(self, chains: list[str]):
        self.chains = chains


def follow(read, paging: str):
    """(page number, items) of one chain; ``read(name)`` gives a page's object."""
    if paging == "cursor":
        cursor, seen, number = "start", set(), 0
        while True:
            page = read(cursor)
            if page.get("partial") is True:
                raise PageError("a partial page")
            if not isinstance(page.get("items"), list) or "next" not in page:
                raise PageError("an incomplete page")
            yield number, page["items"]
            cursor, number = page["next"], number + 1
            if cursor is None:
                return
            if not isinstance(cursor, str) or not cursor or cursor in seen or cursor == "start":
                raise PageError(f"an invalid cursor: {cursor!r}")
            seen.add(cursor)
    start, total, number = 0, None, 0
    while total is None or start < total:
        page = read(str(start))
        items, of = page.get("items"), page.get("total")
        if not isinstance(items, list) or not isinstance(of, int) or isinstance(of, bool) or page.get("start") != start:
            raise PageError("an incomplete page")
        if total is not None and of != total:
            raise PageError("the total has changed")
        total = of
        yield number, items
        start, number = start + len(items), number + 1
        if not items and start < total:
            raise PageError("the scan has stalled")


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.paging = schema, options["path"].rstrip("/"), options.get("paging", "cursor")
        self.parts, wanted = int(options.get("partitions", PARTITIONS)), options.get("chains")
        self.wanted = None if wanted is None else set(json.loads(wanted))
        if self.paging not in ("cursor", "offset"):
            raise PageError(f"no paging: {self.paging}")

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.path)
        chains = sorted(x.base_name for x in fs.get_file_info(FileSelector(path)) if x.type == FileType.Directory)
        chains = [c for c in chains if self.wanted is None or c in self.wanted]
        return [Chains(chains[i :: self.parts]) for i in range(min(self.parts, len(chains)))] or [Chains([])]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, path = filesystem(self.path)
        kinds = to_arrow_schema(self.schema)
        needed = [f.name for f in self.schema.fields if not f.nullable and f.name not in OWN]
        for chain in partition.chains:

            def page(name: str, chain: str = chain) -> dict:
                try:
                    with fs.open_input_stream(f"{path}/{chain}/{name}.json") as f:
                        found = json.loads(f.read())
                except FileNotFoundError:
                    raise PageError(f"no page {name} of {chain}") from None
                if not isinstance(found, dict):
                    raise PageError("a page is no object")
                return found

            for number, items in follow(page, self.paging):
                if any(not isinstance(x, dict) or any(x.get(k) is None for k in needed) for x in items):
                    raise PageError(f"an incomplete item on page {number} of {chain}")
                own = {"chain": [chain] * len(items), "page": [number] * len(items), "position": list(range(len(items)))}
                yield pa.RecordBatch.from_arrays([pa.array(own[f.name] if f.name in OWN else [x.get(f.name) for x in items], f.type) for f in kinds], schema=kinds)


class PagedSource(DataSource):
    """``spark.read.format("tidemark_pages").schema(...).option("paging", "cursor" or "offset").load(path)``"""

    @classmethod
    def name(cls):
        return "tidemark_pages"

    def schema(self):
        return "chain string, page int, position int"

    def reader(self, schema):
        return _Reader(schema, self.options)


def scan(spark: SparkSession, path: str, schema: str, paging: str = "cursor", chains: list[str] | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """chain, page, position and the item fields of ``schema`` (the reader takes no others) of all chains, or of those asked for."""
    spark.dataSource.register(PagedSource)
    read = spark.read.format(PagedSource.name()).schema(f"chain string, page int, position int, {schema}").option("paging", paging).option("partitions", partitions)
    return (read if chains is None else read.option("chains", json.dumps(chains))).load(path)


def write_pages(df: DataFrame, path: str, chain: str, order: list[str], paging: str = "cursor", size: int | None = None) -> int:
    """The rows as chains of pages of ``size`` items, ordered within their chain; how many pages.

    Places come from a window over the chain; a page is the only group that is gathered.
    """
    from pyspark.sql.window import Window

    size = size or (CURSOR_PAGE if paging == "cursor" else OFFSET_PAGE)
    w = Window.partitionBy("_chain")
    place = df.select(F.col(chain).cast("string").alias("_chain"), F.struct(*[c for c in df.columns if c != chain]).alias("_item"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    place = place.select("_chain", "_item", (F.row_number().over(w.orderBy(*[f"_o{i}" for i in range(len(order))], "_item")) - 1).alias("_n"), F.count("*").over(w).alias("_total"))
    page = F.floor(F.col("_n") / size)
    pages = place.groupBy("_chain", page.alias("_page")).agg(F.max("_total").alias("_total"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda x: x["_item"]).alias("items"))
    last = (F.col("_page") + 1) * size >= F.col("_total")
    cursor = lambda p: F.concat(F.lit("c"), p.cast("string"))
    if paging == "cursor":
        name = F.when(F.col("_page") == 0, "start").otherwise(cursor(F.col("_page")))
        body = F.struct("items", F.when(~last, cursor(F.col("_page") + 1)).alias("next"))
    else:
        name = (F.col("_page") * size).cast("string")
        body = F.struct("items", (F.col("_page") * size).alias("start"), F.col("_total").alias("total"))
    text = F.to_json(body, {"ignoreNullFields": "false"})

    def put(batches):
        import pyarrow as pa

        fs, root = filesystem(path)
        n = 0
        for b in batches:
            for chain, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs.create_dir(f"{root}/{chain}", recursive=True)
                with fs.open_output_stream(f"{root}/{chain}/{name}.json") as f:
                    f.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return pages.select("_chain", name.alias("name"), text.alias("text")).mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def last_of_each(items: DataFrame, *key: str) -> DataFrame:
    """Of items with one key, the last in the order of the pages."""
    rest = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("page", "position")).alias("x")).select(*key, *[f"x.{c}" for c in rest])


def direct_neighbours(items: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """chain, entity_type, urn: the items one step away of the kinds wanted, each once; items without an urn are left out.

    items: chain, page, position, urn, entity_type, degree.
    """
    own = items.where((F.col("degree") == 1) & F.col("entity_type").isin(*kinds) & (F.coalesce("urn", F.lit("")) != ""))
    return own.select("chain", "entity_type", "urn").distinct()


def property_values(items: DataFrame) -> DataFrame:
    """chain, property_urn, position, kind, string_value, number_value of assigned values, which are texts or numbers; ``values`` holds each as JSON text."""
    own = items.select("chain", "property_urn", F.posexplode("values").alias("place", "json"))
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("json"), F.lit("}")), "$.v")
    is_text = F.col("json").startswith('"')
    return own.select("chain", "property_urn", F.col("place").alias("position"), F.when(is_text, "STRING").otherwise("NUMBER").alias("kind"), F.when(is_text, text).alias("string_value"), F.when(~is_text, text.cast("double")).alias("number_value"))
