"""Splitting oversized texts at natural boundaries.

Balanced targets: the smallest number of pieces that could hold the text gives equal-length targets; each is snapped to the strongest
boundary near it from which the rest can still be cut; while a piece would pass the limit, one more is made.  There is no bound on the pieces.
Cuts are tried from paragraphs down: the first strength by which a whole plan stays within the limit is used, and the boundary reported is
the weakest cut of the plan made.  Overlaps take room, so the pieces with them may need a weaker cut somewhere; both are reported.

Only texts over the limit leave the JVM, as Arrow batches; texts are independent, so there is no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200

_NL = r"(?:\r\n|\n|\r(?!\n))"
LEVELS = [  # coarsest first
    ("paragraph", re.compile(rf"{_NL}(?:[ \t]*{_NL})+")),
    ("line", re.compile(_NL)),
    ("sentence", re.compile(r"(?<=[.!?])\s+")),
    ("word", re.compile(r"\s+")),
]
INSIDE = "inside_word"


def _separators(text: str, least: int) -> list[tuple[int, int, int]]:
    """(start, end, strength) of the separators of strength ``least`` and more; each kind is looked for between those before it, and those
    that touch are joined into one of the greatest strength."""
    parts, found = [(0, len(text))], []
    for k, (_, rx) in enumerate(LEVELS[: len(LEVELS) + 1 - least]):
        inner = []
        for s, e in parts:
            at = s
            for m in rx.finditer(text[s:e]):
                found.append((s + m.start(), s + m.end(), len(LEVELS) - k))
                inner.append((at, s + m.start()))
                at = s + m.end()
            inner.append((at, e))
        parts = inner
    out: list[tuple[int, int, int]] = []
    for s, e, k in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), max(k, out[-1][2]))
        else:
            out.append((s, e, k))
    return out


def _plan(text: str, limit: int, overlap: int | None, least: int) -> list[tuple[int, int, int]] | None:
    """The separators at which to cut ``text``, of strength ``least`` and more, or None where some piece would pass the limit.

    Without ``overlap`` (None) a piece lies between the separators; with it a piece ends with its separator and the next starts
    ``overlap`` before that.  The smallest number of pieces gives equal targets; a target is snapped to the strongest separator near it
    from which the rest can still be cut within the limit into the pieces left; while it can't, a piece is added."""
    seps, length = _separators(text, max(least, 1)), len(text)
    back = overlap or 0
    if not least:  # inside words too: cuts at equal distances in what has no separator
        room, hard, before = limit - back, [], 0
        for s, e, _ in [*seps, (length, length, 0)]:
            to = s if overlap is None else e
            n = -(-(to - before) // room)
            hard += [(before + (to - before) * i // n,) * 2 + (0,) for i in range(1, n)]
            before = e
        seps = sorted(seps + hard)
    if overlap is not None:
        seps = [x for x in seps if overlap < x[1] < length]
    # a piece from separator i (-1 is the start of the text) to separator j (the last is its end)
    start = [0] + [e - back for _, e, _ in seps]
    end = [(s if overlap is None else e) for s, e, _ in seps] + [length]
    far = [bisect_right(end, at + limit) - 1 for at in start]  # the last separator a piece from i reaches
    if any(f < i for i, f in enumerate(far)):
        return None
    left = [1] * len(start)  # the pieces needed from i on
    for i in range(len(start) - 1, -1, -1):
        left[i] = 1 if far[i] == len(seps) else 1 + left[far[i] + 1]
    pieces = max(2, -(-(length - back) // (limit - back)))
    while left[0] > pieces:
        pieces += 1
    made, at, half = [], 0, max(1, length // (2 * pieces))
    for i in range(1, pieces):
        target = back + (length - back) * i // pieces
        fits = [j for j in range(at, min(far[at], len(seps) - 1) + 1) if left[j + 1] <= pieces - i]
        if not fits:
            break
        near = [j for j in fits if abs(end[j] - target) <= half]
        best = max(near, key=lambda j: (seps[j][2], -abs(end[j] - target))) if near else min(fits, key=lambda j: abs(end[j] - target))
        made.append(seps[best])
        at = best + 1
    return made


def _strongest(text: str, limit: int, overlap: int | None, first: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The plan of the strongest cuts, from strength ``first`` down, with the name of the weakest kind of cut that it needs."""
    for least in range(first, -1, -1):
        if (made := _plan(text, limit, overlap, least)) is not None:
            return (LEVELS[len(LEVELS) - least][0] if least else INSIDE), made
    raise ValueError("the overlap leaves no room")


def boundary_of(text: str, limit: int = LIMIT) -> str:
    """The weakest kind of cut made, without overlaps, to bring every piece of ``text`` to ``limit`` characters; '' where none is needed."""
    return _strongest(text, limit, None, len(LEVELS))[0] if len(text) > limit else ""


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, str, list[tuple[int, int]]]:
    """The boundary of ``text``, the weakest kind of cut made with the overlaps, and the pieces as (start, end); each but the first starts
    ``overlap`` before the end of the one before."""
    if len(text) <= limit:
        return "", "", [(0, len(text))]
    name = boundary_of(text, limit)
    cut, made = _strongest(text, limit, overlap, next((len(LEVELS) - k for k, (x, _) in enumerate(LEVELS) if x == name), 0))
    ends = [e for _, e, _ in made] + [len(text)]
    return name, cut, list(zip([0] + [e - overlap for e in ends[:-1]], ends, strict=True))


def split_oversized(items: DataFrame, *, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, boundary, cut, pieces array<struct<piece, start, end, content>>) of the items over ``limit`` characters (code points, as stored).

    Every piece has at most ``limit`` characters, consecutive ones share exactly ``overlap``, and without the overlaps they give the
    text again.  boundary is the weakest cut that the limit alone asks for, cut the weakest one made with the overlaps.  Nulls, empty texts and texts within the limit give no row; repeated items come out as often as they went in; very long
    texts are cut whole.  Other columns are ignored.  An empty table gives no rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [pieces_of(t, limit, overlap) for t in b["text"]]
            pieces = [[{"piece": i, "start": s, "end": e, "content": t[s:e]} for i, (s, e) in enumerate(p)] for t, (_, _, p) in zip(b["text"], rows, strict=True)]
            yield pd.DataFrame({"key": b["key"], "boundary": [n for n, _, _ in rows], "cut": [c for _, c, _ in rows], "pieces": pieces})

    long = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    key_type = items.schema[key].dataType.simpleString()
    out = long.mapInPandas(cut, f"key {key_type}, boundary string, cut string, pieces array<struct<piece: int, start: int, end: int, content: string>>")
    return out.withColumnRenamed("key", key)


def split_chunks(chunks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all oversized chunks: (chunk_id, document_id, chunk_index, section_label, piece, boundary, cut, start_char, content),
    chunk_index renumbered from 0 within the document over its pieces and its other chunks, in the order of the old chunk_index (nulls
    last), then created_at, then id.  A chunk without document is numbered by itself.

    The numbers are sums over one row per chunk: first within spans of old indices, then over the spans, so a document of very many
    chunks isn't one task's work.
    """
    span = 4096
    n = F.when(F.length("content") > limit, 0).otherwise(1)
    doc = F.coalesce("document_id", "id")
    base = chunks.select(F.col("id").alias("chunk_id"), "document_id", doc.alias("doc"), "chunk_index", "section_label", "created_at", n.alias("n"))
    cut = split_oversized(chunks, key="id", text="content", limit=limit, overlap=overlap).withColumnRenamed("id", "chunk_id")
    sizes = cut.select("chunk_id", F.size("pieces").alias("n_pieces")).distinct()
    sized = base.join(sizes, "chunk_id", "left").withColumn("n", F.coalesce("n_pieces", "n")).withColumn("span", F.floor(F.coalesce("chunk_index", F.lit(2**31 - 1)) / span))
    order = [F.col("chunk_index").asc_nulls_last(), "created_at", "chunk_id"]
    inside = Window.partitionBy("doc", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spans = sized.groupBy("doc", "span").agg(F.sum("n").alias("total"))
    before = spans.select("doc", "span", F.sum("total").over(Window.partitionBy("doc").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    first = sized.withColumn("own", F.sum("n").over(inside)).filter("n_pieces is not null").join(before, ["doc", "span"])
    at = F.coalesce("before", F.lit(0)) + F.coalesce("own", F.lit(0))
    numbered = first.select("chunk_id", "document_id", "section_label", at.alias("first"))
    out = numbered.join(cut, "chunk_id").select("chunk_id", "document_id", "section_label", "boundary", "cut", "first", F.inline("pieces"))
    return out.select("chunk_id", "document_id", (F.col("first") + F.col("piece")).alias("chunk_index"), "section_label", "piece", "boundary", "cut", F.col("start").alias("start_char"), "content")
