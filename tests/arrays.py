"""Writes chunked array stores for the tests to read."""

import gzip
import itertools
import json
import os
import struct
import zipfile
import zlib
from typing import Any

import numpy as np
import zstandard

from axisloom.sources.zarr import _MISSING, crc32c, meta


def pack_zip(folder: str, path: str) -> str:
    """Packs a store into one zip file of stored members, metadata first."""
    names = sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, files in os.walk(folder) for n in files)
    names.sort(key=lambda n: not n.endswith((".zmetadata", "zarr.json", ".zarray", ".zgroup", ".zattrs")))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for n in names:
            z.write(os.path.join(folder, n), n.replace(os.sep, "/"))
    return path


def write_array(root: str, path: str, x: np.ndarray, chunks: tuple[int, ...] | None = None, codec: str | None = "zstd", version: int = 3, shard: tuple[int, ...] | None = None) -> None:
    """Writes an array; shard: the outer chunk shape, a multiple of chunks."""
    folder = os.path.join(root, path)
    os.makedirs(folder, exist_ok=True)
    chunks = tuple(chunks or (max(1, n) for n in x.shape))
    x = np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<"), copy=False)
    if version == 2:
        if codec == "zstd" or shard:
            raise ValueError("zstd and shards need version 3")
        m = {"zarr_format": 2, "shape": list(x.shape), "chunks": list(chunks), "dtype": x.dtype.str, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": ".", "compressor": {"id": codec, "level": 5} if codec else None}
        name = ".zarray"
    else:
        inner = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {"level": 3} | ({"checksum": False} if codec == "zstd" else {})}] if codec else [])
        outer = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunks), "codecs": inner, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}] if shard else inner
        m = {"zarr_format": 3, "node_type": "array", "shape": list(x.shape), "data_type": {"b": "bool"}.get(x.dtype.kind, x.dtype.name), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shard or chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": outer, "attributes": {}}
        name = "zarr.json"
    with open(os.path.join(folder, name), "w") as f:
        json.dump(m, f)
    info = meta(root, path)

    def encoded(part: np.ndarray, shape: tuple[int, ...]) -> bytes:
        full = np.zeros(shape, x.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        raw = full.tobytes()
        return {None: lambda: raw, "gzip": lambda: gzip.compress(raw, 5, mtime=0), "zlib": lambda: zlib.compress(raw, 5), "zstd": lambda: zstandard.ZstdCompressor(level=3).compress(raw)}[codec]()

    for at in itertools.product(*map(range, info.grid)):
        part = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, info.chunks))]
        if shard:
            blob, places = b"", []
            for sub in itertools.product(*(range(-(-s // c)) for s, c in zip(shard, chunks))):
                piece = part[tuple(slice(i * c, (i + 1) * c) for i, c in zip(sub, chunks))]
                if piece.size == 0:
                    places.append((_MISSING, _MISSING))
                    continue
                one = encoded(piece, chunks)
                places.append((len(blob), len(one)))
                blob += one
            index = np.array(places, "<u8").tobytes()
            data = blob + index + struct.pack("<I", crc32c(index))
        else:
            data = encoded(part, chunks)
        file = os.path.join(folder, info.key(at))
        os.makedirs(os.path.dirname(file), exist_ok=True)
        with open(file, "wb") as f:
            f.write(data)


def write_strings(root: str, path: str, values: list[str], **kwargs: Any) -> None:
    raw = [v.encode() for v in values]
    write_array(root, path, np.frombuffer(b"".join(raw), np.uint8), **kwargs)
    write_array(root, f"{path}_offsets", np.cumsum([0, *map(len, raw)]).astype(np.int64), **kwargs)
