"""The run-time image of a Java home (lib/modules) as a Spark data source.

The index of an image is read once on the driver and cut into runs of entries; each task opens the image, which all
executors must see at the same path, and reads its own run. Compressed entries are inflated if they are zipped.
"""

from __future__ import annotations

import mmap
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas

#: Fixed values of the format: magic numbers, kinds of an entry's attributes.
IMAGE, PACKED = 0xCAFEDADA, 0xCAFEFAFA
END, MODULE, PARENT, BASE, EXTENSION, OFFSET, COMPRESSED, SIZE = range(8)
ENTRIES_PER_TASK = 2000


class Image:
    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115  closed with the object
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.order = "<" if self.data[:4] == struct.pack("<I", IMAGE) else ">"
        magic, _, _, _, table, locations, strings = struct.unpack(f"{self.order}7I", self.data[:28])
        if magic != IMAGE:
            raise ValueError(f"no Java image: {path}")
        self.offsets_at, self.table = 28 + 4 * table, table
        self.locations = self.offsets_at + 4 * table
        self.strings = self.locations + locations
        self.content = self.strings + strings

    def close(self):
        self.data.close()
        self.file.close()

    def text(self, at: int) -> str:
        start = self.strings + at
        return self.data[start : self.data.find(b"\0", start)].decode()

    def entry(self, i: int) -> list[int]:
        """The attributes of the i-th entry by kind."""
        out = [0] * 8
        at = self.locations + struct.unpack_from(f"{self.order}I", self.data, self.offsets_at + 4 * i)[0]
        while kind := self.data[at] >> 3:
            n = (self.data[at] & 7) + 1
            out[kind] = int.from_bytes(self.data[at + 1 : at + 1 + n])
            at += 1 + n
        return out

    def name(self, e: list[int]) -> tuple[str, str]:
        """(module, path inside it)."""
        parent, base, extension = (self.text(e[k]) if e[k] else "" for k in (PARENT, BASE, EXTENSION))
        return self.text(e[MODULE]) if e[MODULE] else "", f"{parent}/" * bool(parent) + base + f".{extension}" * bool(extension)

    def bytes(self, e: list[int]) -> bytes:
        at = self.content + e[OFFSET]
        raw = self.data[at : at + (e[COMPRESSED] or e[SIZE])]
        if not e[COMPRESSED]:
            return raw
        while raw[:4] == struct.pack(f"{self.order}I", PACKED):  # one layer for each plug-in
            _, size, _, plugin, _, _ = struct.unpack(f"{self.order}IQQIIB", raw[:29])
            if self.text(plugin) != "zip":
                raise ValueError(f"no reader for entries packed by {self.text(plugin)}")
            raw = zlib.decompress(raw[29 : 29 + size])
        return raw


class Run(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ImageReader(DataSourceReader):
    def __init__(self, home: str):
        self.home, self.path = home, f"{home}/lib/modules"

    def partitions(self):
        image = Image(self.path)
        n = image.table
        image.close()
        return [Run(a, min(n, a + ENTRIES_PER_TASK)) for a in range(0, n, ENTRIES_PER_TASK)]

    def read(self, partition: Run):
        image = Image(self.path)
        try:
            for i in range(partition.first, partition.last):
                e = image.entry(i)
                module, path = image.name(e)
                if not module or module in ("modules", "packages") or not path.endswith(".class") or path.endswith("package-info.class"):
                    continue
                try:
                    yield f"jrt://{self.home}", f"modules/{module}/{path}", bytes(image.bytes(e)), None
                except (ValueError, zlib.error) as x:
                    yield f"jrt://{self.home}", f"modules/{module}/{path}", None, f"{type(x).__name__}: {x}"
        finally:
            image.close()


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "java-image"

    def schema(self) -> str:
        return schemas.RESOURCE

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options["home"].rstrip("/"))


def read_image(spark: SparkSession, home: str) -> DataFrame:
    """Resources (source_uri, resource_path, content, error) of the classes of a Java home's image."""
    spark.dataSource.register(ImageSource)
    return spark.read.format("java-image").option("home", home).load()


def one_resource(resources: DataFrame, path: str) -> DataFrame:
    return resources.where(F.col("resource_path") == path).select("content")
