"""Two plainer rules of line dedup, by pairs of lines and by disjoint chunks; the query and the pipeline use `linechunks`.

A text is cut at line feeds. `dedup_passages` compares all pairs of neighbouring lines of which one has a word. A pair
that stands earlier in the corpus, by key and place, goes, unless it overlaps the first one. Every repeated run of two
lines or more consists of such pairs, so maximal runs go whole, to their first and last line, wherever they stand and
whatever surrounds them. A line that repeats alone stays, as do blank pairs; the first occurrence of a line always stays.

One pass makes a pair of 64-bit line hashes a window, which are counted with map-side combining, so a pair in a third of
all documents is a few rows a task. The lines of repeated pairs are compared by their smallest and largest bytes a hash,
combined likewise; a hash whose bytes differ removes nothing. Only then documents are joined with the places to remove.

`dedup_lines` is the coarser rule over disjoint chunks: a rolling hash over the hashes of the last `WINDOW` lines ends a
chunk after a line where it is 0 modulo `AVERAGE`. A chunk has at least MIN_LINES lines (but a text's last may be
shorter) and at most MAX_LINES; chunks are compared by 128-bit digests, then by their bytes. It leaves the ends of
passages, and most short ones, standing.

A place is removed only from rows of its key whose text has the pair there; other texts of that key stay as they are.
A null or empty text has one empty line or none and is left as it is. Equal rows (same key, same text) hold the same
first occurrence and stay both; rows with a null key come first in key order and are never changed. Texts are cut
whole whatever their length. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.bpe import batches
from muster.llm.tables import keep

WINDOW, AVERAGE, MIN_LINES, MAX_LINES = 2, 2, 2, 32
_MASK = (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int]]:
    """Bounds, in lines, of the chunks of a text."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in text.split("\n")]
    out, first = [], 0
    for k in range(len(hashes)):
        rolling = 0
        for h in hashes[max(0, k - WINDOW + 1) : k + 1]:
            rolling = (rolling * 0x9E3779B97F4A7C15 + h) & _MASK
        n = k + 1 - first
        if n >= MAX_LINES or n >= MIN_LINES and (rolling >> 32) % AVERAGE == 0:
            out.append((first, k + 1))
            first = k + 1
    if first < len(hashes):
        out.append((first, len(hashes)))
    return out


def _each(keys: list, texts: list) -> Iterator[tuple]:
    """Key, chunk number, lines and bytes of all chunks that take part."""
    for key, text in zip(keys, texts, strict=True):
        if key is None or not text or "\n" not in text:
            continue
        lines = text.split("\n")
        for no, (a, b) in enumerate(chunks(text)):
            if b - a >= 2 and (data := "\n".join(lines[a:b])).strip():
                yield key, no, b - a, data.encode("utf-8", "surrogatepass")


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in batches(parts):
        rows = [(k, no, *divmod(xxhash.xxh3_128_intdigest(data), 1 << 64)) for k, no, _, data in _each(keys, texts)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        signed = [[x - (1 << 64) if x >> 63 else x for x in c] for c in cols[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols[:2], *signed)], names=["doc", "no", "d1", "d2"])


def _bodies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in batches(parts):
        rows = [(*divmod(xxhash.xxh3_128_intdigest(data), 1 << 64), data) for _, _, _, data in _each(keys, texts)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        signed = [[x - (1 << 64) if x >> 63 else x for x in c] for c in cols[:2]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in signed), pa.array(cols[2], pa.binary())], names=["d1", "d2", "data"])


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts, lines, gone, removed = [], [], [], []
        for text, nos in zip(batch.column("text").to_pylist(), batch.column("nos").to_pylist(), strict=True):
            own = text.split("\n") if text is not None else []
            lines.append(len(own))
            if nos:
                drop, keep_ = set(nos), []
                for no, (a, b) in enumerate(chunks(text)):
                    if no not in drop:
                        keep_ += own[a:b]
                text = "\n".join(keep_)
                gone.append(len(own) - len(keep_))
            else:
                gone.append(0)
            removed.append(len(nos or ()))
            texts.append(text)
        columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "text", "n_lines", "removed_chunks", "removed_lines"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` by their names, the text without repeated chunks, and n_lines, removed_chunks and
    removed_lines (in place of extra columns of these names)."""
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    found = keep(keyed.mapInArrow(_digests, "doc bigint, no bigint, d1 bigint, d2 bigint"))
    repeated = found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last")).where("first <> last")
    doomed = keep(found.join(repeated, ["d1", "d2"]).where("first <> struct(doc, no)").select("d1", "d2", "doc", "no", "first"))
    holders = doomed.select("doc").unionByName(doomed.select(F.col("first.doc").alias("doc"))).distinct()
    bodies = keyed.join(holders, "doc", "left_semi").mapInArrow(_bodies, "d1 bigint, d2 bigint, data binary")
    equal = bodies.groupBy("d1", "d2").agg(F.min("data").alias("low"), F.max("data").alias("high")).where("low = high").select("d1", "d2")
    nos = doomed.join(equal, ["d1", "d2"]).groupBy("doc").agg(F.collect_set("no").alias("nos"))
    return _shaped(docs, nos, _cut, id_col, text_col)


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, first line and line hashes of all pairs of neighbouring lines that take part."""
    for keys, texts in batches(parts):
        docs, nos, left, right = [], [], [], []
        for key, text in zip(keys, texts, strict=True):
            if key is None or not text or "\n" not in text:
                continue
            lines = text.split("\n")
            h = np.array([_line_hash(line) for line in _encoded(lines)], np.uint64).view(np.int64)
            worded = np.array([bool(line.strip()) for line in lines])
            at = np.flatnonzero(worded[:-1] | worded[1:])
            docs.append(np.full(len(at), key, np.int64))
            nos.append(at.astype(np.int64))
            left.append(h[at])
            right.append(h[at + 1])
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (docs, nos, left, right)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "no", "d1", "d2"])


def _encoded(lines: list[str]) -> list[bytes]:
    return [line.encode("utf-8", "surrogatepass") for line in lines]


def _line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def _line_bytes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, smallest and largest bytes of the lines of the pairs at `nos`, by slices of a batch."""
    for batch in parts:
        for at in range(0, batch.num_rows, 1000):
            part, seen = batch.slice(at, 1000), {}
            for text, nos in zip(part.column("text").to_pylist(), part.column("nos").to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                wanted = {k for no in nos for k in (no, no + 1) if k < len(lines)}
                for line in _encoded([lines[k] for k in wanted]):
                    h = _line_hash(line)
                    low, high = seen.get(h, (line, line))
                    seen[h] = min(low, line), max(high, line)
            hashes = np.array(list(seen), np.uint64).view(np.int64)
            low, high = zip(*seen.values(), strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["h", "low", "high"])


def _cut_passages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the pairs of lines at `nos` (no, d1, d2) from texts that have those lines there."""
    for batch in parts:
        texts, lines, gone, removed = [], [], [], []
        for text, nos in zip(batch.column("text").to_pylist(), batch.column("nos").to_pylist(), strict=True):
            own = text.split("\n") if text is not None else []
            hashes = _line_hashes([own[k] for no in nos or () for k in (no["no"], no["no"] + 1) if k < len(own)])
            drop = set()
            for no in nos or ():
                k = no["no"]
                if k + 1 < len(own) and hashes[own[k]] == no["d1"] and hashes[own[k + 1]] == no["d2"]:
                    drop |= {k, k + 1}
            if drop:
                text = "\n".join(line for k, line in enumerate(own) if k not in drop)
            texts.append(text)
            lines.append(len(own))
            gone.append(len(drop))
            removed.append(sum(k - 1 not in drop for k in drop))
        columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "text", "n_lines", "removed_chunks", "removed_lines"])


def _line_hashes(lines: list[str]) -> dict[str, int]:
    """Of each line its hash as a signed number, as tables hold it."""
    return {line: h - (1 << 64) if (h := _line_hash(data)) >> 63 else h for line, data in zip(lines, _encoded(lines), strict=True)}


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` by their names, the text without repeated passages, and n_lines, removed_chunks (runs of
    lines) and removed_lines (in place of extra columns of these names)."""
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    found = keep(keyed.mapInArrow(_windows, "doc bigint, no bigint, d1 bigint, d2 bigint"))
    repeated = found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last")).where("first <> last")
    later = found.join(repeated, ["d1", "d2"]).where("first.doc <> doc or no - first.no >= 2")
    doomed = keep(later.select("d1", "d2", "doc", "no", "first"))
    places = doomed.select("doc", "no").unionByName(doomed.select("first.doc", "first.no"))
    holders = places.groupBy("doc").agg(F.collect_set("no").alias("nos"))
    lines = keyed.join(holders, "doc").select("text", "nos").mapInArrow(_line_bytes, "h bigint, low binary, high binary")
    clashing = keep(lines.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("h"))
    sure = doomed.select("d1", "d2", "doc", "no")
    for d in ("d1", "d2"):
        sure = sure.join(clashing.withColumnRenamed("h", d), d, "left_anti")
    nos = sure.groupBy("doc").agg(F.collect_set(F.struct("no", "d1", "d2")).alias("nos"))
    return _shaped(docs, nos, _cut_passages, id_col, text_col)


def _shaped(docs: DataFrame, nos: DataFrame, cut: Callable, id_col: str, text_col: str) -> DataFrame:
    added = ("n_lines", "removed_chunks", "removed_lines")
    others = [c for c in docs.columns if c not in (text_col, *added)]
    sides = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc"))
    # rows without a key have no places; they are not sent to one task
    keyless = sides.where("doc is null").withColumn("nos", F.lit(None).cast(nos.schema["nos"].dataType))
    joined = sides.where("doc is not null").join(nos, "doc", "left").unionByName(keyless).select(*(f"c{k}" for k in range(len(others))), "text", "nos")
    kinds = {f"c{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(others)}
    schema = ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "text string, n_lines bigint, removed_chunks bigint, removed_lines bigint"])
    out = joined.mapInArrow(cut, schema)
    named = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {text_col: F.col("text")}
    return out.select(*(named[c].alias(c) for c in docs.columns if c in named), *added)
