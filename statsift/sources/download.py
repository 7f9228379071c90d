"""Whole files to a folder: resumed, verified, never overwritten unasked.

One row a target; the work is done by tasks, and a failure is a row."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statsift.functions.names import safe_file_name

RESULT = "source_id string, path string, bytes long, md5 string, category string"
CHUNK = 1 << 20


def fetch(url: str, path: str, md5: str | None = None, overwrite: bool = False, opener=urllib.request.urlopen) -> dict:
    """Fetch one file by way of ``path.part``, from where that ends."""
    if os.path.exists(path) and not overwrite:
        return {"bytes": os.path.getsize(path), "md5": None, "category": "exists"}
    part, digest = path + ".part", hashlib.md5()
    have = os.path.getsize(part) if os.path.exists(part) else 0
    try:
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-", "Accept-Encoding": "identity"} if have else {"Accept-Encoding": "identity"})
        try:
            answer = opener(request)
        except urllib.error.HTTPError as e:
            if e.code != 416 or not have:
                raise
            answer = opener(urllib.request.Request(url, headers={"Accept-Encoding": "identity"}))  # nothing follows what is there: begin anew
        with answer:
            mode = "ab" if have and answer.status == 206 else "wb"
            with open(part, mode) as out:
                while chunk := answer.read(CHUNK):
                    out.write(chunk)
        with open(part, "rb") as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
    except OSError:
        return {"bytes": os.path.getsize(part) if os.path.exists(part) else 0, "md5": None, "category": "download_error"}
    size = os.path.getsize(part)
    if md5 and digest.hexdigest() != md5.lower():
        os.remove(part)
        return {"bytes": size, "md5": digest.hexdigest(), "category": "checksum_failed"}
    os.replace(part, path)
    return {"bytes": size, "md5": digest.hexdigest(), "category": None}


def download(targets: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """``source_id (URL), name, md5 (or NULL)`` to ``folder``, which all tasks must see.

    A name loses what could lead out of the folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for url, name, md5 in zip(frame["source_id"], frame["name"], frame["md5"]):
                path = os.path.join(folder, name)
                rows.append({"source_id": url, "path": path, **fetch(url, path, md5, overwrite)})
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return targets.select("source_id", safe_file_name(F.col("name")).alias("name"), "md5").mapInPandas(run, RESULT)


def read_spreadsheets(files: DataFrame) -> DataFrame:
    """``source_id, row_idx, cells`` of spreadsheets' first sheets; a missing reader is a row with a category."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            for source, content in zip(frame["source_id"], frame["content"]):
                try:
                    sheet = pd.read_excel(io.BytesIO(content), header=None, dtype=str)
                    cells = sheet.fillna("").to_numpy().tolist()
                    yield pd.DataFrame({"source_id": source, "row_idx": range(len(cells)), "cells": cells, "category": None})
                except ImportError:
                    yield pd.DataFrame({"source_id": [source], "row_idx": [None], "cells": [None], "category": ["dependency_missing"]})
                except (ValueError, OSError):
                    yield pd.DataFrame({"source_id": [source], "row_idx": [None], "cells": [None], "category": ["unsupported_format"]})

    return files.select("source_id", "content").mapInPandas(run, "source_id string, row_idx long, cells array<string>, category string")
