"""The headline file: a path that is given, or a public dataset by its id."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from tidemark.protocol import Protocol


def kaggle_download(dataset: str) -> str:
    """The folder of a Kaggle dataset, fetched by the public client if that is installed."""
    try:
        from kagglehub import dataset_download
    except ModuleNotFoundError as err:
        raise FileNotFoundError(f"name the headline file, or install kagglehub to fetch {dataset}") from err
    return dataset_download(dataset)


def headline_file(path: str | None, protocol: Protocol = Protocol(), download: Callable[[str], str] = kaggle_download) -> str:
    """``path`` as given, which may be in any store that Spark reads; without one the protocol's
    file of its dataset, where the client keeps what it has fetched."""
    return path if path else str(Path(download(protocol.dataset)) / protocol.dataset_file)
