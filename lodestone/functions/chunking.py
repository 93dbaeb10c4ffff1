"""Chunkers: paragraphs packed with an overlap, and Markdown by sections.

A text is seen through offsets. Sentence ends of a long paragraph are positions in it without the white space after sentences, so that a
piece is the slice up to the last end within the limit. Paragraphs are packed by their cumulative lengths: a chunk's last paragraph is
found by bisection, and the overlap only moves where the count begins. Each document is chunked on its own in an Arrow batch; nothing is
shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

# What sets paragraphs and sentences apart, and headings of the first four levels with their title.
_BLANK_LINE = re.compile(r"\n\s*\n")
_AFTER_SENTENCE = re.compile(r"([。！？；!?;.])\s+")
_SENTENCE_END = re.compile(r"[。！？；!?;.]")
_HEADING = re.compile(r"^[^\S\n]*#{1,4}[^\S\n]+(\S(?:[^\n]*?\S)??)(?:[^\S\n]+#+)?[^\S\n]*$", re.M)


def _slices(paragraph: str, limit: int) -> Iterator[str]:
    """A paragraph without the blanks between its sentences, in slices that end with a sentence where one ends within the limit."""
    dense = _AFTER_SENTENCE.sub(r"\1", paragraph)
    ends = [m.end() for m in _SENTENCE_END.finditer(dense)]
    ends.append(len(dense))
    start = 0
    while start < len(dense):
        within = bisect_right(ends, start + limit)
        end = ends[within - 1] if within and ends[within - 1] > start else start + limit
        yield dense[start:end]
        start = end


def split_paragraphs(text: str, limit: int) -> Iterator[str]:
    """Paragraphs; longer ones in pieces of whole sentences up to the limit, sentences over it cut hard."""
    for paragraph in _BLANK_LINE.split(text):
        whole = paragraph.strip()
        if len(whole) > limit:
            yield from _slices(whole, limit)
        elif whole:
            yield whole


def chunk_paragraphs(text: str, c: EngineConfig = EngineConfig(), prefix: str = "", keep_prefix_only: bool = False) -> list[str]:
    """Greedy chunks of paragraphs, each beginning with the tail of the one before.

    A paragraph counts with a line break; one that would fill the chunk to c.chunk_size begins the next. Every chunk takes the
    first paragraph it may take, but with keep_prefix_only a chunk holds the prefix alone if that doesn't fit beside it.
    """
    parts = [p for p in map(str.strip, split_paragraphs(text, c.chunk_size)) if p]
    upto = list(accumulate((len(p) + 1 for p in parts), initial=0))
    out: list[str] = []
    head, start = prefix, 0
    alone = keep_prefix_only and bool(prefix.strip()) and (not parts or len(prefix) + len(parts[0]) >= c.chunk_size)
    while alone or start < len(parts):
        # the first paragraph whose end lies beyond what is left of the size
        stop = start if alone else bisect_left(upto, c.chunk_size + 1 - len(head) + upto[start], min(start + 2, len(upto))) - 1
        out.append((head + "\n".join(parts[start:stop])).strip())
        head = prefix + (out[-1][-c.overlap_chars :] + "\n" if c.overlap_chars > 0 else "")
        start, alone = stop, False
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(title, section) for each heading, to the next one; what comes before the first has no title."""
    heads = list(_HEADING.finditer(text))
    starts = [m.start() for m in heads] + [len(text)]
    found = [("", text[: starts[0]].strip())]
    return found + [(m[1], text[m.start() : end].strip()) for m, end in zip(heads, starts[1:])]


def chunk_markdown(text: str, c: EngineConfig = EngineConfig(), parity: bool = False) -> list[tuple[int, str]]:
    """(index, chunk): a chunk for each section under its title, longer sections in paragraphs; texts with less than two headings as plain.

    With ``parity`` text before the first heading is dropped, the index begins anew in each long section and chunks with nothing but
    a title are kept.
    """
    before, *titled = sections(text)
    if len(titled) < 2:
        return list(enumerate(chunk_paragraphs(text, c)))
    groups = [] if parity else [chunk_paragraphs(before[1], c)]
    groups += [[f"# {title}\n\n{body}"] if len(body) <= c.section_chars else chunk_paragraphs(body, c, f"# {title}\n\n", parity) for title, body in titled]
    at = list(accumulate(map(len, groups), initial=0))
    anew = [parity and len(body) > c.section_chars for _, body in ([] if parity else [before]) + titled]
    return [((0 if again else base) + k, chunk) for group, base, again in zip(groups, at, anew) for k, chunk in enumerate(group)]


def chunk_text(text: str, markdown: bool, c: EngineConfig = EngineConfig(), parity: bool = False) -> list[tuple[int, str]]:
    return chunk_markdown(text, c, parity) if markdown else list(enumerate(chunk_paragraphs(text, c)))


def chunk_documents(df: DataFrame, text_col: str = "text", source_col: str = "source", markdown_col: str | None = None, c: EngineConfig = EngineConfig(), parity: bool = False) -> DataFrame:
    """(seq, source, chunk_index, text) of each document of at least c.min_doc_chars characters.

    markdown_col tells Markdown texts; by default sources in .md are. seq orders the rows of equal sources as the input's ``seq``
    does if it has one. Null texts and null sources of a shorter text have no row; an empty table gives none.
    """
    md = F.col(markdown_col) if markdown_col else F.coalesce(F.lower(source_col).endswith(".md"), F.lit(False))
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")

    def run(batches):
        for b in batches:
            at, index, text = [], [], []
            for i, (t, m) in enumerate(zip(b.column("text").to_pylist(), b.column("md").to_pylist())):
                for k, piece in chunk_text(t, m, c, parity):
                    at.append(i)
                    index.append(k)
                    text.append(piece)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("seq").take(take), b.column("source").take(take), pa.array(index, pa.int64()), pa.array(text, pa.string())], names=["seq", "source", "chunk_index", "text"])

    src = df.select(seq.alias("seq"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), md.alias("md")).filter(F.length("text") >= c.min_doc_chars)
    return src.mapInArrow(run, "seq long, source string, chunk_index long, text string")
