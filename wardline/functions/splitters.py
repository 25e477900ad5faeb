"""Chunk strategies that go through a text in order: sentences, paragraphs, sections, headers and separators.

Each start depends on the end before, so they are plain functions over one text that Arrow batches call;
all are linear in the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import snapped

#: Separators of the recursive splitter in order, and what begins a section.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION = r"\n(?=[A-Z][^a-z]*:|\d+\.\s|#{1,6}\s|[A-Z]{2,})"
#: Characters of chunks that go on together, about.
BATCH = 1 << 20
_HEADER = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)


def _grouped(parts: list[str], size: int, overlap: int, joint: str) -> list[str]:
    """Neighbours joined while their own lengths sum to at most `size`; a group begins with the last parts of the one before that sum to at most `overlap`."""
    out: list[str] = []
    now: deque[str] = deque()
    length = fresh = 0
    for part in parts:
        if now and length + len(part) > size:
            out.append(joint.join(now))
            kept, total = [], 0
            for p in reversed(now):
                if total + len(p) > overlap:
                    break
                kept.append(p)
                total += len(p)
            now, length, fresh = deque(reversed(kept)), total, 0
        now.append(part)
        length, fresh = length + len(part), fresh + 1
    return [*out, joint.join(now)] if fresh else out


def by_sentence(text: str, size: int, overlap: int) -> list[str]:
    return _grouped([s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip())) if s], size, overlap, " ")


def by_paragraph(text: str, size: int, overlap: int = 0) -> list[str]:
    return _grouped([p for p in (p.strip() for p in text.split("\n\n")) if p], size, -1, "\n\n")


def by_window(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end after a sentence where one ends in their second half; a short text is one."""
    text = text.strip()
    return [text] if text and len(text) <= size else snapped(text, size, overlap)


def by_section(text: str, size: int, overlap: int) -> list[str]:
    """Sections by what begins one; those of over twice `size` are windows, and so is a text without sections."""
    parts = re.split(SECTION, text)
    if len(parts) <= 1:
        return by_window(text, size, overlap)
    out: list[str] = []
    for part in (p.strip() for p in parts):
        if part:
            out += by_window(part, size, overlap) if len(part) > 2 * size else [part]
    return out


def by_separator(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Descends the separators: pieces of the first that occurs, each beginning with it, are joined up to `size`; a longer piece is split by the later ones.

    Chunks of one piece's neighbours begin with the last pieces of the one before, up to `overlap` characters.
    Chunks are stripped, and empty ones left out.
    """
    out: list[str] = []
    todo: list[tuple[str, int]] = [(text, 0)]
    while todo:
        part, level = todo.pop()
        at = next((i for i in range(level, len(separators)) if separators[i] and separators[i] in part), None)
        if at is None:  # no separator is left: windows of characters
            if len(part) <= size:
                windows = [part]
            elif separators and not separators[-1]:
                windows = [part[i : i + size] for i in range(0, max(len(part) - overlap, 1), size - overlap)]
            else:
                windows = [part]
            out += [w.strip() for w in windows if w.strip()]
            continue
        mark = separators[at]
        head, *rest = part.split(mark)
        pieces = ([head] if head else []) + [mark + p for p in rest]
        now: deque[str] = deque()
        length = 0
        chunks: list[tuple[str, bool]] = []
        for piece in pieces:
            if len(piece) > size:
                if now:
                    chunks.append(("".join(now), True))
                now, length = deque(), 0
                chunks.append((piece, False))
                continue
            if now and length + len(piece) > size:
                chunks.append(("".join(now), True))
                while now and (length > overlap or length + len(piece) > size):
                    length -= len(now.popleft())
            now.append(piece)
            length += len(piece)
        if now:
            chunks.append(("".join(now), True))
        if all(done for _, done in chunks):
            out += [c.strip() for c, _ in chunks if c.strip()]
        else:  # chunks and parts to descend into stay in order
            todo += [(c, len(separators)) if done else (c, at + 1) for c, done in reversed(chunks)]
    return out


def header_sections(text: str) -> list[tuple[list[str], str]]:
    """(titles, content) for each header line of one to six # marks: its title after those it stands under, and what follows it; what comes before the first has no titles."""
    out: list[tuple[list[str], str]] = []
    path: list[tuple[int, str]] = []
    at = 0
    for m in _HEADER.finditer(text):
        out.append(([t for _, t in path], text[at : m.start()].strip()))
        level = len(m.group(1))
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, m.group(2)))
        at = m.end()
    out.append(([t for _, t in path], text[at:].strip()))
    return [(titles, content) for titles, content in out if titles or content]


def by_header(text: str, size: int, overlap: int) -> list[tuple[list[str], str]]:
    """(titles, chunk): the sections of headers, the long ones split by separators; a section without content keeps its titles."""
    return [(titles, c) for titles, content in header_sections(text) for c in (by_separator(content, size, overlap) or [""])]


STRATEGIES = {"fixed": by_window, "sentence": by_sentence, "paragraph": by_paragraph, "semantic": by_section, "recursive": by_separator, "header": by_header}


def chunked(docs: DataFrame, strategy: str = "fixed", size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, index, total, chunk_id, titles, content) of every chunk of every text by one of STRATEGIES; null and empty texts have none.

    `titles` is empty but for "header". Other columns are not read. Texts are taken from an Arrow batch one by
    one, and their chunks handed on in batches of about BATCH characters, so Python holds one text's chunks
    and little more beside the batch. `overlap` has to be less than `size`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy}: one of {', '.join(STRATEGIES)}")
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be less than the size")
    split = STRATEGIES[strategy]

    pairs = (lambda t: split(t, size, overlap)) if strategy == "header" else (lambda t: (([], c) for c in split(t, size, overlap)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, rows = b.column(1), 0, []

            def made() -> pa.RecordBatch:
                at, *columns = zip(*rows, strict=True)  # noqa: B023
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "index", "total", "titles", "content"])  # noqa: B023

            for at in range(len(texts)):
                chunks = list(pairs(t)) if (t := texts[at].as_py()) else []
                for index, (titles, content) in enumerate(chunks):
                    rows.append((at, index, len(chunks), titles, content))
                    held += len(content) + 100
                    if held > BATCH:
                        yield made()
                        held, rows = 0, []
            if rows:
                yield made()

    schema = T.StructType([T.StructField("key", docs.select(docs[key]).schema[0].dataType), *T._parse_datatype_string("index int, total int, titles array<string>, content string").fields])
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(cut, schema)
    return out.select(F.col("key").alias(key), "index", "total", F.concat(F.col("key").cast("string"), F.lit("_chunk_"), F.col("index")).alias("chunk_id"), "titles", "content")
