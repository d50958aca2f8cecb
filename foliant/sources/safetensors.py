"""Tensor files: headers without payloads, and decoding to 32-bit floats."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)

from foliant import schemas

HEADER_LIMIT = 25_000_000
# How element types are read.
DTYPES = {"F32": "<f4", "F16": "<f2", "I32": "<i4", "U32": "<u4", "I16": "<i2", "U16": "<u2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
PREVIEW_DTYPES = ("F32", "F16", "BF16")


def read_header(read) -> tuple[dict, int]:
    """(header, where the payload begins); ``read(start, end)`` gives bytes [start, end)."""
    raw = read(0, 8)
    if len(raw) < 8:
        raise ValueError("no header length")
    (n,) = struct.unpack("<Q", raw)
    if not 0 < n <= HEADER_LIMIT:
        raise ValueError(f"suspicious header size {n}")
    return json.loads(read(8, 8 + n)), 8 + n


def descriptors(path: str, header: dict, payload: int) -> list[tuple]:
    out = []
    for name, t in header.items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            out.append((name, path, t["dtype"], [int(x) for x in t["shape"]], int(np.prod(t["shape"], dtype=np.int64)), payload + a, payload + b, b - a))
    return out


class _Part(InputPartition):
    """Tensors of one shard: all that its header names (``chosen`` is None), or those given, whose bytes lie in a row."""

    def __init__(self, path: str, chosen: list[tuple] | None = None):
        super().__init__(path)
        self.path, self.chosen = path, chosen


#: Spark's setting that hands filters to sources like this one.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Columns of a descriptor by place; those that filters may name.
COLUMNS = [c.split()[0] for c in schemas.TENSORS.split(", ")]
FILTERED = ("name", "file_path", "dtype", "byte_length", "element_count")
#: Bytes of tensors that a task reads, about, and the most between two tensors that are read in one go.
PART_BYTES, GAP_BYTES = 128 << 20, 64 << 10


def _tests(filters: list[Filter]) -> tuple[list, list[Filter]]:
    """(tests of a descriptor, filters left to Spark)."""
    tests, left = [], []
    for f in filters:
        attribute = getattr(f, "attribute", ())
        at = COLUMNS.index(attribute[0]) if len(attribute) == 1 and attribute[0] in FILTERED else None
        value = getattr(f, "value", None)
        test = None
        if at is not None and isinstance(f, IsNotNull):
            test = lambda d: True
        elif at is not None and value is not None:
            for kind, say in ((EqualTo, lambda x, v: x == v), (In, lambda x, v: x in v), (StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, lambda x, v: v in x), (LessThan, lambda x, v: x < v), (LessThanOrEqual, lambda x, v: x <= v), (GreaterThan, lambda x, v: x > v), (GreaterThanOrEqual, lambda x, v: x >= v)):
                if type(f) is kind:
                    test = lambda d, at=at, say=say, v=value: say(d[at], v)
        (left if test is None else tests).append(f if test is None else test)
    return tests, left


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], *, payload: bool = False, opener=open):
        self.paths, self.payload, self.opener = paths, payload, opener
        self.tests: list = []

    def _descriptors(self, path: str) -> list[tuple]:
        with self.opener(path, "rb") as f:

            def read(a: int, b: int) -> bytes:
                f.seek(a)
                return f.read(b - a)

            return [d for d in descriptors(path, *read_header(read)) if all(t(d) for t in self.tests)]

    def partitions(self) -> list[_Part]:
        """Without tensor bytes a task a shard, which reads its header. With them, headers are read here (25 MB each at most), and
        the chosen tensors are dealt to tasks by their byte ranges, so a shard of any size is read by many and nothing else of it is."""
        if not self.payload:
            return [_Part(p) for p in self.paths]
        out = []
        for path in self.paths:
            own: list[tuple] = []
            for d in sorted(self._descriptors(path), key=lambda d: d[5]):
                if own and d[6] - own[0][5] > PART_BYTES:
                    out.append(_Part(path, own))
                    own = []
                own.append(d)
            if own:
                out.append(_Part(path, own))
        return out or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.chosen is None:
            yield from self._descriptors(partition.path)
        elif partition.chosen:
            with self.opener(partition.path, "rb") as f:
                for group in ranges(partition.chosen):
                    begin = group[0][5]
                    f.seek(begin)
                    data = f.read(max(d[6] for d in group) - begin)
                    for d in group:
                        yield (*d, data[d[5] - begin : d[6] - begin])


class _Chooser(_Reader):
    """A reader that takes filters; Spark refuses one where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on names, types and sizes are tried on headers; the others are Spark's."""
        self.tests, left = _tests(filters)
        return iter(left)


def ranges(chosen: list[tuple]) -> list[list[tuple]]:
    """Tensors that are read in one go: in byte order, with little between them."""
    out: list[list[tuple]] = []
    for d in sorted(chosen, key=lambda d: d[5]):
        if out and d[5] - max(x[6] for x in out[-1]) <= GAP_BYTES:
            out[-1].append(d)
        else:
            out.append([d])
    return out


class SafetensorsSource(DataSource):
    """``spark.read.format("safetensors").option("paths", "a;b")``: descriptors from headers only, of mounted paths.

    With ``option("payload", "true")`` a column ``data`` has each tensor's bytes. With ``option("pushdown", "true")``, for which
    ``spark.sql.python.filterPushdown.enabled`` must be set, filters on name, file_path, dtype, byte_length and element_count are tried on headers, and
    only the byte ranges of tensors that pass are read. Spark keeps what it has pushed down with a loaded frame, so load anew for each filter, as ``chosen`` does.
    """

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def _is(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def schema(self) -> str:
        return schemas.TENSORS + (", data binary" if self._is("payload") else "")

    def reader(self, schema) -> DataSourceReader:
        kind = _Chooser if self._is("pushdown") else _Reader
        return kind([p for p in self.options["paths"].split(";") if p], payload=self._is("payload"))


def tensors_of_blobs(files: DataFrame) -> DataFrame:
    """The same rows from (path, content), for stores that only Spark reads."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [d for p, c in zip(part["path"], part["content"], strict=True) for d in descriptors(p, *read_header(lambda a, b, c=c: bytes(c[a:b])))]
            yield pd.DataFrame(rows, columns=["name", "file_path", "dtype", "shape", "element_count", "byte_start", "byte_end", "byte_length"])

    return files.select("path", "content").mapInPandas(run, schemas.TENSORS)


def shards_of_index(index_json: DataFrame) -> DataFrame:
    """Distinct shard names of an index file's (path, text)."""
    weights = F.from_json(F.get_json_object("text", "$.weight_map"), "map<string,string>")
    from foliant.functions.text import relative_path

    return index_json.select("path", F.explode(F.map_values(weights)).alias("shard")).select(relative_path(F.col("path"), F.col("shard")).alias("path")).distinct()


def shard_paths(files: DataFrame, index_json: DataFrame | None) -> DataFrame:
    """The shards an index names, else all tensor files."""
    return shards_of_index(index_json) if index_json is not None else files.where(F.col("path").endswith(".safetensors")).select("path").orderBy("path")


def preview_tensor(tensors: DataFrame) -> DataFrame:
    """The first tensor of a floating type, else the first; one row."""
    liked = F.when(F.col("dtype").isin(*PREVIEW_DTYPES), 0).otherwise(1)
    return tensors.orderBy(liked, "file_path", "byte_start").limit(1)


def decode(dtype: str, data: bytes) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")
    if dtype not in DTYPES:
        raise ValueError(f"no 32-bit float reading of {dtype}")
    return np.frombuffer(data, DTYPES[dtype]).astype("<f4")


def decoded(dtype: Column, data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(kinds: pd.Series, raws: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else decode(k, bytes(r)) for k, r in zip(kinds, raws, strict=True)])

    return run(dtype, data)


def preview(dtype: Column, data: Column, most: int = 64) -> Column:
    """The first ``most`` elements of a tensor's bytes; no more bytes than they take are decoded."""
    width = F.create_map(*[F.lit(x) for k, v in (*DTYPES.items(), ("BF16", "<u2")) for x in (k, np.dtype(v).itemsize)])
    return decoded(dtype, F.substring(data, F.lit(1), F.coalesce(F.try_element_at(width, dtype), F.lit(0)) * most))


def chosen(spark: SparkSession, paths: list[str], where: Column | str) -> DataFrame:
    """Descriptors and bytes of the tensors that pass a filter; of the files only headers and those bytes are read."""
    register(spark)
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        out = spark.read.format("safetensors").option("paths", ";".join(paths)).option("payload", "true").option("pushdown", "true").load().where(where)
        out._jdf.queryExecution().executedPlan()  # filters are pushed down while the plan is made
        return out
    finally:
        spark.conf.set(PUSHDOWN, before)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SafetensorsSource)


def write(path: str, tensors: dict[str, tuple[str, list[int], bytes]]) -> None:
    """A small tensor file, for round trips."""
    header, at = {}, 0
    for name, (dtype, shape, data) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    raw = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw + b"".join(d for _, _, d in tensors.values()))
