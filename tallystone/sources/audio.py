"""WAV recordings as a Python data source: headers read without their sound, clips written by a commit protocol.

Files are opened through ``pyarrow.fs``, so a path may be local or in any store that it knows. A recording is a partition's item: its reader seeks from
chunk to chunk and reads the first bytes of each only, however long the recording is.
"""

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = "path string, rate int, frame_bytes int, frames long, data_at long, format binary, error string"
#: Recordings that one task reads the headers of.
FILES = 256
#: Bytes copied at once.
PIECE = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def header(path: str) -> dict:
    """Rate, bytes of a frame, frames, the data's place and the format chunk of a WAV file; with ``error`` and nulls if it isn't a sound one."""
    out = dict.fromkeys(("rate", "frame_bytes", "frames", "data_at", "format", "error"))
    try:
        store, at = opened(path)
        with store.open_input_file(at) as f:
            size = f.size()
            head = f.read(12)
            if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
                return out | {"error": "not a RIFF/WAVE file"}
            kind = None
            while len(chunk := f.read(8)) == 8:
                name, length = chunk[:4], struct.unpack("<I", chunk[4:])[0]
                if name == b"data":
                    if kind is None or len(kind) < 16:
                        return out | {"error": "missing or short fmt chunk"}
                    rate, width = struct.unpack("<I", kind[4:8])[0], struct.unpack("<H", kind[12:14])[0]
                    if not rate or not width:
                        return out | {"error": "invalid sample rate or block align"}
                    begin = f.tell()  # a streamed file's length may be more than there is
                    return out | {"rate": rate, "frame_bytes": width, "frames": min(length, size - begin) // width, "data_at": begin, "format": kind}
                if name == b"fmt ":
                    kind = f.read(min(length, 1 << 16))
                    f.seek(f.tell() + max(length - (1 << 16), 0) + length % 2)
                else:
                    f.seek(min(f.tell() + length + length % 2, size))
            return out | {"error": "no data chunk"}
    except OSError as error:
        return out | {"error": str(error)}


@dataclass
class _Paths(InputPartition):
    paths: list[str]


class _Headers(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        store, at = opened(self.folder)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".wav") and "/_" not in f.path[len(at) :])
        scheme = self.folder[: self.folder.index("://") + 3] if "://" in self.folder and not self.folder.startswith("file:") else ""
        return [_Paths([scheme + p for p in found[i : i + FILES]]) for i in range(0, len(found), FILES)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            h = header(path)
            yield path, h["rate"], h["frame_bytes"], h["frames"], h["data_at"], h["format"], h["error"]


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, str]]


def _head(kind: bytes, size: int, frames: int) -> bytes:
    """Everything before the data of a WAV file with a given format chunk."""
    parts = [b"fmt ", struct.pack("<I", len(kind)), kind, b"\0" * (len(kind) % 2)]
    if struct.unpack("<H", kind[:2])[0] != 1:  # other formats than PCM tell their frames
        parts += [b"fact", struct.pack("<II", 4, frames)]
    parts += [b"data", struct.pack("<I", size)]
    rest = b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(rest) + size + size % 2) + b"WAVE" + rest


class _Clips(DataSourceWriter):
    """Files are written aside, moved to their names by the commit of all tasks, and removed if the job fails."""

    def __init__(self, folder: str):
        self.folder, self.aside = folder, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, at = opened(self.folder)
        own = posixpath.join(at, self.aside, str(TaskContext.get().taskAttemptId()))
        store.create_dir(own, recursive=True)
        files = []
        for n, r in enumerate(rows):
            name = r["name"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            made = posixpath.join(own, f"{n}.wav")
            self._clip(store, made, r)
            files.append((made, posixpath.join(at, f"{name}.wav")))
        return _Done(files)

    def _clip(self, store: fs.FileSystem, made: str, r) -> None:
        if r["data"] is not None:
            data, kind = bytes(r["data"]), bytes(r["format"])
            width = struct.unpack("<H", kind[12:14])[0]
            data = data[: len(data) // width * width]
            with store.open_output_stream(made) as out:
                out.write(_head(kind, len(data), len(data) // width))
                out.write(data + b"\0" * (len(data) % 2))
            return
        h = header(r["recording"])
        if h["error"]:
            raise ValueError(f"{r['recording']}: {h['error']}")
        first = min(h["frames"], max(0, int(r["start"] * h["rate"])))
        last = max(first, min(h["frames"], int(r["end"] * h["rate"])))
        left = size = (last - first) * h["frame_bytes"]
        source, at = opened(r["recording"])
        with source.open_input_file(at) as f, store.open_output_stream(made) as out:
            out.write(_head(h["format"], size, last - first))
            f.seek(h["data_at"] + first * h["frame_bytes"])
            while left > 0 and (piece := f.read(min(left, PIECE))):
                out.write(piece)
                left -= len(piece)
            if size % 2:
                out.write(b"\0")

    def commit(self, messages: list) -> None:
        store, at = opened(self.folder)
        names = [final for m in messages if m for _, final in m.files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("several clips of one name")
        for m in messages:
            for made, final in m.files if m else ():
                store.move(made, final)
        self._clean(store, at)

    def abort(self, messages: list) -> None:
        self._clean(*opened(self.folder))

    def _clean(self, store: fs.FileSystem, at: str) -> None:
        aside = posixpath.join(at, self.aside)
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)


class WavFiles(DataSource):
    """Reads the headers of the WAV files below a folder (columns ``HEADER``), and writes one WAV file for each row (columns ``CLIP``).

    A clip is the frames of ``recording`` in [start, end) seconds, clipped to it, in its own format; or, if ``data`` isn't null, these bytes in the given ``format`` chunk.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Headers(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("clips are added to a folder; use mode append")
        return _Clips(self.options["path"])


CLIP = "name string, recording string, start double, end double, data binary, format binary"


def pcm(rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """The format chunk of uncompressed sound."""
    width = channels * bits // 8
    return struct.pack("<HHIIHH", 1, channels, rate, rate * width, width, bits)
