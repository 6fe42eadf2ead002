"""Single-file NIfTI-1 volumes as long tables (image, voxel, value), and a data source that reads and writes them.

voxel is the place in the volume's grid, with or without a mask, so masked values go back where they came from.
"""

from __future__ import annotations

import gzip
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: NIfTI-1 data type codes by numpy type.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


FORMAT = "nifti1"
SCHEMA = "image string, voxel int, value double"
NAME = re.compile(r"([^/]*?)(\.nii)?(\.gz)?$")


def _unpacked(data: bytes) -> tuple[bytes, str]:
    """The bytes, unpacked if compressed, and their byte order."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for order in "<>":
        if len(data) >= 348 and struct.unpack_from(order + "i", data)[0] == 348:
            return data, order
    raise ValueError("not a NIfTI-1 file")


def volume_grid(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Sizes and spacings of a NIfTI-1 file's dimensions."""
    data, order = _unpacked(data)
    shape, step = struct.unpack_from(order + "8h", data, 40), struct.unpack_from(order + "8f", data, 76)
    return shape[1 : 1 + shape[0]], step[1 : 1 + shape[0]]


def volume_values(data: bytes) -> np.ndarray:
    """All values of a NIfTI-1 file in file order, scaled as its header says. Compressed content is unpacked."""
    data, order = _unpacked(data)
    shape = struct.unpack_from(order + "8h", data, 40)
    code, offset = struct.unpack_from(order + "h", data, 70)[0], struct.unpack_from(order + "3f", data, 108)
    count = int(np.prod(shape[1 : 1 + shape[0]]))
    values = np.frombuffer(data, order + TYPES[code], count, int(offset[0])).astype(np.float64)
    return values * offset[1] + offset[2] if offset[1] else values


def volume_bytes(values: np.ndarray, shape: tuple[int, ...], step: tuple[float, ...]) -> bytes:
    """A compressed NIfTI-1 file of doubles."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1.0, *step, *[1.0] * (7 - len(step)))
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.ascontiguousarray(values, "<f8").tobytes(), mtime=0)


def volumes(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """(image, voxel, value) of all volumes below a path, in batches of 64 Ki voxels. Spark reads the files, so any store will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"([^/]*?)(\.nii)?(\.gz)?$", 1).alias("image"), "content")

    def run(batches):
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = volume_values(content.as_py())
                for at in range(0, len(values), 1 << 16):
                    part = values[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([image] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int32()), pa.array(part)], names=["image", "voxel", "value"])

    return files.mapInArrow(run, "image string, voxel int, value double")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; plain paths are local."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _content(path: str) -> bytes:
    store, place = _store(path)
    with store.open_input_stream(place, compression=None) as stream:
        return stream.read()


def _listed(path: str) -> list[str]:
    """Names of the volumes in a folder, or of the one volume that the path is."""
    store, place = _store(path)
    if store.get_file_info(place).type == fs.FileType.File:
        return [place]
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and re.search(r"\.nii(\.gz)?$", f.base_name))


@dataclass
class VolumeFiles(InputPartition):
    paths: list[str]
    grid: tuple[tuple[int, ...], tuple[float, ...]] | None


class VolumeReader(DataSourceReader):
    """Volumes are dealt to tasks by file. The driver lists names and reads one volume, whose grid all others must share."""

    def __init__(self, options):
        self.path, self.mask = options["path"], options.get("mask")
        self.above, self.most = float(options.get("above", 0.5)), int(options.get("filesPerTask", 16))

    def partitions(self) -> list[VolumeFiles]:
        paths, grid = _listed(self.path), None
        if paths:
            store, _ = _store(self.path)
            with store.open_input_stream(paths[0], compression=None) as stream:
                grid = volume_grid(stream.read())
        return [VolumeFiles(paths[k : k + self.most], grid) for k in range(0, len(paths), self.most)] or [VolumeFiles([], None)]

    def read(self, partition: VolumeFiles) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        keep = None
        if self.mask and partition.paths:
            mask = _content(self.mask)
            if volume_grid(mask) != partition.grid:
                raise ValueError(f"volumes and mask have different sizes or spacings: {partition.grid}, {volume_grid(mask)}")
            keep = np.flatnonzero(volume_values(mask) > self.above).astype(np.int32)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as stream:
                data = stream.read()
            if volume_grid(data) != partition.grid:
                raise ValueError(f"volumes have different sizes or spacings: {path} {volume_grid(data)}, not {partition.grid}")
            values = volume_values(data)
            places = np.arange(len(values), dtype=np.int32) if keep is None else keep
            image = NAME.search(path)[1]
            for at in range(0, len(places), 1 << 16):
                part = places[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(part)), pa.array(part), pa.array(values[part])], names=["image", "voxel", "value"])


@dataclass
class WrittenVolumes(WriterCommitMessage):
    folder: str
    names: list[str]


class VolumeWriter(DataSourceArrowWriter):
    """One file per image. Tasks write below a folder of their own attempt; only what Spark commits is moved to its place.

    Rows come by image, as write_volumes deals them. A task holds one image at a time. Other attempts' files go with the folder.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.step = tuple(float(x) for x in options.get("step", ",".join(["1"] * len(self.shape))).split(","))
        self.fill, self.job = float(options.get("fill", 0)), f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenVolumes:
        store, place = _store(self.path)
        context = TaskContext.get()
        folder = f"{place}/{self.job}/{context.taskAttemptId()}"
        size, names = int(np.prod(self.shape)), []
        name, values, seen = None, np.full(size, self.fill), np.zeros(size, bool)

        def close():
            if name is not None:
                store.create_dir(folder)
                with store.open_output_stream(f"{folder}/{name}.nii.gz", compression=None) as stream:
                    stream.write(volume_bytes(values, self.shape, self.step))
                names.append(name)

        for batch in iterator:
            images = np.array(batch.column(0).cast(pa.string()).to_pylist(), object)
            if any(i is None or not i or "/" in i for i in images) or batch.column(1).null_count:
                raise ValueError("images need a name without / and voxels a number")
            places, new = batch.column(1).to_numpy(), batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if len(places) and (places.min() < 0 or places.max() >= size):
                raise ValueError(f"a voxel lies outside of the grid {self.shape}")
            edges = [0, *(np.flatnonzero(images[1:] != images[:-1]) + 1).tolist(), len(images)] if len(images) else [0]
            for lo, hi in zip(edges, edges[1:]):
                if images[lo] != name:
                    close()
                    if images[lo] in names:
                        raise ValueError("rows must come image by image")
                    name, values, seen = images[lo], np.full(size, self.fill), np.zeros(size, bool)
                at = places[lo:hi]
                if seen[at].any() or len(np.unique(at)) < len(at):
                    raise ValueError(f"image {name} has a voxel twice")
                values[at], seen[at] = new[lo:hi], True
        close()
        return WrittenVolumes(folder, names)

    def commit(self, messages) -> None:
        store, place = _store(self.path)
        store.create_dir(place)
        if self.overwrite:
            for old in _listed(self.path):
                store.delete_file(old)
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{message.folder}/{name}.nii.gz", f"{place}/{name}.nii.gz")
        self._clear(store, place)

    def abort(self, messages) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, place) -> None:
        if store.get_file_info(f"{place}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/{self.job}")


class VolumeSource(DataSource):
    """Format nifti1. Reading: path, mask (a volume's path), above (the mask's bar), filesPerTask. Writing: path, shape, step, fill."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


def read_volumes(spark: SparkSession, path: str, mask: str | None = None, above: float = 0.5) -> DataFrame:
    """(image, voxel, value) of the volumes in a folder, of the voxels that the mask volume has above `above`, if given.

    An error where sizes or spacings differ between volumes or from the mask. An empty folder gives no rows.
    """
    spark.dataSource.register(VolumeSource)
    source = spark.read.format(FORMAT).option("above", above)
    return (source.option("mask", mask) if mask else source).load(path)


def write_volumes(voxels: DataFrame, path: str, shape: tuple[int, ...], step: tuple[float, ...] | None = None, fill: float = 0.0, mode: str = "overwrite") -> None:
    """One compressed volume of doubles per image of (image, voxel, value) in a folder; voxels without a row are `fill`, nulls are NaN.

    A voxel twice or outside of the grid, or a null image, is an error, and a failed job leaves no file in the folder. Images are
    dealt to tasks by name and come one after another. mode: overwrite takes older volumes of the folder away, append doesn't.
    """
    voxels.sparkSession.dataSource.register(VolumeSource)
    rows = voxels.select(F.col("image").cast("string"), F.col("voxel").cast("int"), F.col("value").cast("double"))
    rows = rows.repartition("image").sortWithinPartitions("image", "voxel")
    options = {"shape": ",".join(map(str, shape)), "fill": fill} | ({"step": ",".join(map(str, step))} if step else {})
    rows.write.format(FORMAT).options(**options).mode(mode).save(path)
