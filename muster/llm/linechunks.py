"""Line dedup by content-defined chunks: multi-line passages that repeat anywhere go, but for their first occurrence.

A text is cut at line feeds. A rolling hash over the hashes of two neighbouring lines marks a boundary after a pair
where it is 0 modulo AVERAGE. From every line a chunk of two lines or more runs to the first boundary, or until it holds
MAX_WORDS words or MAX_LINES lines; from every line another one runs backwards by the same rule. So a chunk depends on
its own lines alone, never on a cut before it, and a passage holds the same chunks wherever it stands. Every passage of
MAX_WORDS words or MAX_LINES lines has one, and of shorter ones of n lines a share of 1 - (1 - 1 / AVERAGE) ** (n - 1).

A chunk that stands earlier in the corpus, by key, text and place, matches its first occurrence, unless it overlaps it.
Matches of a text with one earlier place (the same distance to lines of one earlier text) are merged to runs; as chunks
start and end at every line of a passage, a run reaches to the passage's first and last line. The longest run goes first.
What is left of a later one goes if it still has two lines in a row, or lies amid the run; a single line at an end of a
run stays, so lines that two places only share in part stay. A removed line always stands earlier, so the first
occurrence of a line is never removed.

Chunks are found by digests of 64 bits, counted with map-side combining, so a chunk in a third of all documents is a few
rows a task. Then bytes are compared: of every digest that matched the line hashes, and of every line hash the bytes, are
reduced to the smallest and the largest; what differs bars the lines that hold it from removal. Texts are joined with
their places once, written to the shared folder, and cut from there.

Texts of one key that differ are different texts; equal rows hold the same first occurrence and stay both. Rows with a
null key, and null or empty texts, are left as they are. Blank chunks take no part. Texts are cut whole whatever their
length; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import mix
from muster.llm.tables import keep, load, written

AVERAGE, MAX_WORDS, MAX_LINES = 2, 25, 32
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(MAX_LINES + 1)], np.uint64)
#: Characters of texts that are worked on at once, or one longer text.
SLICE_CHARS = 2_000_000

PLACE = "struct<no: bigint, n: bigint, d: bigint, fdoc: bigint, ftid: bigint, fno: bigint>"


def line_hashes(lines: list[str], bits: int = 64) -> np.ndarray:
    """Hashes of lines; fewer bits make collisions, for tests."""
    h = np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines], np.uint64)
    return h & np.uint64((1 << bits) - 1)


def chunks(lines: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First lines of all chunks of a text that have a word, and the lines after their last ones."""
    n = len(lines)
    line = np.arange(n)
    words = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines])))
    # a pair is named by its second line
    pairs = np.flatnonzero((mix(hashes[:-1] * np.uint64(_BASE) + hashes[1:]) >> np.uint64(32)) % np.uint64(AVERAGE) == 0) + 1
    after = np.append(pairs, n)[np.searchsorted(pairs, line + 1)]
    full = np.maximum(np.searchsorted(words, words[:-1] + MAX_WORDS) - 1, line + 1)
    stop = np.minimum(np.minimum(after, full), line + MAX_LINES - 1) + 1
    before = np.append(-1, pairs - 1)[np.searchsorted(pairs, line, "right")]
    filled = np.minimum(np.searchsorted(words, words[1:] - MAX_WORDS, "right") - 1, line - 1)
    start = np.maximum(np.maximum(before, filled), line - MAX_LINES + 1)
    spans = np.concatenate((np.stack((line, stop), axis=1)[stop <= n], np.stack((start, line + 1), axis=1)[start >= 0]))
    spans = np.unique(spans, axis=0)
    spans = spans[words[spans[:, 1]] > words[spans[:, 0]]]
    return spans[:, 0], spans[:, 1]


def digests(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of the line hashes of each chunk, in their order."""
    out = (end - first).astype(np.uint64)
    for k in range(int((end - first).max(initial=0))):
        inside = first + k < end
        out[inside] = out[inside] * np.uint64(_BASE) + mix(hashes[(first + k)[inside]] + np.uint64(k))
    return mix(out)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE_CHARS characters of `text`."""
    for batch in parts:
        sizes = np.cumsum([len(t) if t is not None else 0 for t in (x.as_py() for x in batch.column("text"))])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, "right")))
            yield batch.slice(at, end - at)
            at = end


def _found(bits: int):
    """Key, text id, first line, lines and digest of all chunks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(parts):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, tid, text in zip(batch.column("doc").to_pylist(), batch.column("tid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key is None or not text or "\n" not in text:
                    continue
                lines = text.split("\n")
                hashes = line_hashes(lines, bits)
                first, end = chunks(lines, hashes)
                d = digests(hashes, first, end)
                for col, values in zip(cols, (np.full(len(first), key), np.full(len(first), tid), first, end - first, d), strict=True):
                    col.append(values.view(np.int64))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flat], names=["doc", "tid", "no", "n", "d"])

    return run


def _contents(bits: int):
    """(kind, h, low, high) of the places of texts: of digests (kind 0) the line hashes, of line hashes (kind 1) the bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(parts):
            seen: dict[tuple[int, int], tuple[bytes, bytes]] = {}

            def see(kind: int, h: int, data: bytes, seen=seen) -> None:
                low, high = seen.get((kind, h), (data, data))
                seen[kind, h] = min(low, data), max(high, data)

            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                if not places:
                    continue
                lines = text.split("\n")
                hashes = line_hashes(lines, bits)
                for p in places:
                    see(0, p["d"], hashes[p["no"] : p["no"] + p["n"]].tobytes())
                for k in {k for p in places for k in range(p["no"], p["no"] + p["n"])}:
                    see(1, int(hashes[k : k + 1].view(np.int64)[0]), lines[k].encode("utf-8", "surrogatepass"))
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([v[side] for v in seen.values()], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "h", "low", "high"])

    return run


def _holders(bits: int):
    """(kind, h, doc, tid, first line, lines) of what the matches of texts hold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(parts):
            rows = set()
            for doc, tid, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "tid", "text", "places")), strict=True):
                hashes = line_hashes(text.split("\n"), bits).view(np.int64) if places else ()
                for p in places or ():
                    rows.add((0, p["d"], doc, tid, p["no"], p["n"]))
                    rows |= {(1, int(hashes[k]), doc, tid, k, 1) for k in range(p["no"], p["no"] + p["n"])}
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["kind", "h", "doc", "tid", "no", "n"])

    return run


def removed(places: list[dict], barred: list[dict] | None = None) -> set[int]:
    """Lines of a text that go, by its matches with first occurrences."""
    bars = {k for b in barred or () for k in range(b["no"], b["no"] + b["n"])}
    by_place: dict[tuple, list[list[int]]] = {}
    for p in sorted((p for p in places if p["fdoc"] is not None), key=lambda p: (p["no"], p["n"])):
        a, b = p["no"], p["no"] + p["n"]
        if bars and not bars.isdisjoint(range(a, b)):
            continue
        runs = by_place.setdefault((p["fdoc"], p["ftid"], a - p["fno"]), [])
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    gone: set[int] = set()
    for _, a, b, _ in sorted((a - b, a, b, place) for place, runs in by_place.items() for a, b in runs):
        k = a
        while k < b:
            if k in gone:
                k += 1
                continue
            end = next((j for j in range(k, b) if j in gone), b)
            if end - k >= 2 or k > a and end < b:
                gone |= set(range(k, end))
            k = end
    return gone


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts, lines, gone, chunks_ = [], [], [], []
        for text, places, barred in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "barred")), strict=True):
            own = text.split("\n") if text is not None else []
            drop = removed(places, barred) if places else set()
            texts.append("\n".join(line for k, line in enumerate(own) if k not in drop) if drop else text)
            lines.append(len(own))
            gone.append(len(drop))
            chunks_.append(sum(k - 1 not in drop for k in drop))
        others = batch.schema.names[: batch.schema.names.index("text")]
        columns = [*(batch.column(c) for c in others), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (lines, chunks_, gone))]
        yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_lines", "removed_chunks", "removed_lines"])


def _barred(joined: DataFrame, bits: int) -> DataFrame | None:
    """(doc, tid, barred) of texts with matches whose digests or line hashes stand for different bytes."""
    held = joined.where("places is not null").select("doc", "tid", "text", "places")
    contents = held.mapInArrow(_contents(bits), "kind int, h bigint, low binary, high binary")
    clashing = keep(contents.groupBy("kind", "h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("kind", "h"))
    if not clashing.limit(1).count():
        return None
    holders = held.mapInArrow(_holders(bits), "kind int, h bigint, doc bigint, tid bigint, no bigint, n bigint")
    return holders.join(clashing, ["kind", "h"]).groupBy("doc", "tid").agg(F.collect_set(F.struct("no", "n")).alias("barred"))


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """All columns of `docs` by their names, the text without repeated passages, and n_lines, removed_chunks (runs of
    lines) and removed_lines (in place of extra columns of these names)."""
    added = ("n_lines", "removed_chunks", "removed_lines")
    others = [c for c in docs.columns if c not in (text_col, *added)]
    own = [f"c{k}" for k in range(len(others))]
    sides = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(others, own, strict=True)), F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("tid"))

    found = keep(sides.select("doc", "tid", "text").mapInArrow(_found(bits), "doc bigint, tid bigint, no bigint, n bigint, d bigint"))
    place = F.struct("doc", "tid", "no")
    repeated = found.groupBy("d").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    apart = "first.doc <> doc or first.tid <> tid or no - first.no >= n"
    matches = keep(found.join(repeated, "d").where(apart).select("doc", "tid", "no", "n", "d", F.col("first.doc").alias("fdoc"), F.col("first.tid").alias("ftid"), F.col("first.no").alias("fno")))
    nothing = F.lit(None).cast("bigint")
    firsts = matches.select(F.col("fdoc").alias("doc"), F.col("ftid").alias("tid"), F.col("fno").alias("no"), "n", "d").distinct().select("*", nothing.alias("fdoc"), nothing.alias("ftid"), nothing.alias("fno"))
    places = matches.unionByName(firsts).groupBy("doc", "tid").agg(F.collect_set(F.struct("no", "n", "d", "fdoc", "ftid", "fno")).alias("places"))

    # rows without a key have no places; they are not sent to one task
    keyless = sides.where("doc is null").withColumn("places", F.lit(None).cast(f"array<{PLACE}>"))
    keyed = sides.where("doc is not null").join(places, ["doc", "tid"], "left")
    joined = written(keyed.unionByName(keyless).select(*own, "doc", "tid", "text", "places"), "line_dedup")
    barred = _barred(joined, bits)
    kind = "array<struct<no: bigint, n: bigint>>"
    ready = joined.withColumn("barred", F.lit(None).cast(kind)) if barred is None else joined.join(barred, ["doc", "tid"], "left")
    kinds = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for o, c in zip(own, others, strict=True))
    out = ready.select(*own, "text", "places", "barred").mapInArrow(_cut, f"{kinds}, text string, n_lines bigint, removed_chunks bigint, removed_lines bigint")
    named = {c: F.col(o) for c, o in zip(others, own, strict=True)} | {text_col: F.col("text")}
    return out.select(*(named[c].alias(c) for c in docs.columns if c in named), *added)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_chunks(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.length("text").cast("bigint").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
