"""Engines that need a device or a service (optical recognition, vision and language models): a registry.

An engine is a function of a file's bytes and page numbers that returns rows; none is built in, so by default each
reports itself unavailable and a document falls back to its text layer. Page budgets, retries and waits are the
engine's settings; a chunk that fails gives no rows and stops no other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

ROWS = "doc_id string, chunk int, answer string, error string"


@dataclass(frozen=True)
class Limits:
    """Pages of a document at most, pages of a call, tries of a call and the wait before the n-th (n times ``wait_s``)."""

    pages: int
    pages_per_call: int
    tries: int = 1
    wait_s: float = 0.0
    budget_s: float = 170.0


# The engines that may be named, and their limits.
LIMITS = {
    "easyocr": Limits(40, 1),
    "surya": Limits(40, 1),
    "surya_llm": Limits(40, 1),
    "tesseract": Limits(40, 1),
    "vlm": Limits(40, 1),
    "gemini": Limits(300, 2, 5, 12.0),
    "groq": Limits(40, 3, 5, 60.0),
}
_ENGINES: dict[str, Callable[[bytes, list[int]], str]] = {}


def register(name: str, engine: Callable[[bytes, list[int]], str]) -> None:
    if name not in LIMITS:
        raise ValueError(f"unknown engine: {name}")
    _ENGINES[name] = engine


def available(name: str) -> bool:
    return name in _ENGINES


def route(file_format: str, ocr: bool = False, pdf_engine: str = "geometric") -> str:
    """The strategy for a format: a reader, an engine of the registry, or the geometric text-layer reader."""
    if file_format in ("docx", "xlsx", "xls"):
        return "docx" if file_format == "docx" else "sheet"
    if ocr or file_format == "scan_pdf":
        return pdf_engine if available(pdf_engine) else "easyocr"
    return pdf_engine if pdf_engine in LIMITS else "geometric"


def answers(files: DataFrame, name: str) -> DataFrame:
    """What the engine says of each chunk of pages of ``path, content, pages``."""
    engine, limits = _ENGINES.get(name), LIMITS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, pages in zip(frame["path"], frame["content"], frame["pages"], strict=True):
                began, rows = time.monotonic(), []
                for chunk, first in enumerate(range(0, min(int(pages), limits.pages), limits.pages_per_call)):
                    answer, error = None, "unavailable" if engine is None else None
                    for attempt in range(limits.tries if engine else 0):
                        if time.monotonic() - began > limits.budget_s:
                            error = "out of time"
                            break
                        try:
                            answer, error = engine(content, list(range(first, min(first + limits.pages_per_call, int(pages))))), None
                            break
                        except Exception as e:  # noqa: BLE001  an engine's failure is a row
                            error = f"{type(e).__name__}: {e}"[:500]
                            time.sleep(limits.wait_s * attempt)
                    rows.append((path, chunk, answer, error))
                yield pd.DataFrame(rows, columns=["doc_id", "chunk", "answer", "error"])

    return files.select("path", "content", "pages").mapInPandas(run, ROWS)


def corrected(lines: list[str], correct: Callable[[list[str]], list[str]], batch: int = 120) -> list[str]:
    """Lines corrected in batches; a batch whose answer has another number of lines, or fails, stays as it was."""
    out: list[str] = []
    for at in range(0, len(lines), batch):
        own = lines[at : at + batch]
        try:
            got = correct(own)
        except Exception:  # noqa: BLE001  fail open
            got = own
        out += got if len(got) == len(own) else own
    return out
