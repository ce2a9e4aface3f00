"""Removal of repeated passages by window fingerprints over a synchronising sample.

A byte goes when it lies in a ``length``-byte string that also starts earlier.
Prefix doubling, which this replaces, ranks positions by ever longer prefixes
and sorts rank pairs; positions whose rank is unique leave.  Ranking every byte
position at once would move some thirty times the input, so nothing doubles
here: prefixes have fixed lengths and are hashed straight from the text, and
the first round works on a sample that no repeat can miss: each ``length``-byte window picks, of its K-byte
prefixes of suffixes, the one of least hash (leftmost on ties).  Equal windows
pick equal places, so

1. positions picked (one in about 35 bytes) carry the name of their first K
   bytes and the name of the stretch of windows that picked them; Spark sorts
   these pairs, and unique first names leave;
2. of equal pairs all but the first occurrence go as a whole (their windows
   all start earlier, too); a first name with one second name needs no more;
3. the windows of the other first occurrences go through the same round with
   prefixes of four fifths of ``length``;
4. every window that is still left gets the rank pair of its first 64 bytes
   and of the bytes from there to ``length``; Spark sorts the pairs, and all
   but the first of each go.

Names are 64-bit fingerprints rather than dense ranks, so that a round needs
one sort and no counting pass.  Before each shuffle a task keeps the first of
equal pairs only and marks the others at once, which bounds what a widely
copied text or line sends anywhere.

Defined results: texts are UTF-8 bytes, null is empty; texts shorter than
``length`` lose nothing; rows with equal ids are one document, and strings
that start at the same place of it are no earlier ones; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, table

LENGTH, K, PIECE, CHUNK = 100, 32, 1 << 19, 1 << 20
#: Columns of both rounds: kind 0 is a pair to sort, kind 1 a removed stretch (doc, at = start << 32 | size).
ROWS = "kind int, a long, b long, doc long, at long"


def _sample(length: int, k: int = K, listed: bool = False):
    """Function for mapInArrow over (doc, text): rows of a round; b is the stretch, at = start << 32 | windows.

    ``listed``: over (doc, text, ats), the windows of the listed stretches only.
    """
    piece, chunk = PIECE, CHUNK

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        h64 = xxhash.xxh3_64_intdigest
        odd, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)

        def powers(x: int):
            out = np.full(chunk + piece + 2 * length, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        up, down = powers(odd), powers(inverse)
        wide = length - k + 1

        def ranked(parts):
            """parts: (doc, start in it, bytes); gives arrays a, b, doc, start, windows."""
            data = b"".join(p[2] for p in parts)
            c = np.frombuffer(data, np.uint8)
            sums = np.zeros(len(c) + 1, np.uint64)
            np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=sums[1:])
            h = (sums[k:] - sums[:-k]) * down[: len(c) - k + 1]
            del sums
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= wide:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < wide:
                low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
            pick = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del low
            sizes = np.array([len(p[2]) for p in parts], np.int64)
            begin = np.cumsum(sizes) - sizes
            fine = np.zeros(len(pick), bool)
            for s, n in zip(begin.tolist(), sizes.tolist()):
                fine[s : s + n - length + 1] = True
            at = np.flatnonzero(fine)
            p = pick[at]
            new = np.ones(len(at), bool)
            new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            windows = np.diff(np.append(first, len(at)))
            start = at[first]
            stop = start + windows + (length - 1)
            b = np.array([h64(data[x:y]) for x, y in zip(start.tolist(), stop.tolist())], np.uint64).view(np.int64)
            own = np.searchsorted(begin, start, side="right") - 1
            docs, offsets = np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts], np.int64)
            return h[p[first]].view(np.int64), b, docs[own], start - begin[own] + offsets[own], windows

        def given(found):
            a, b, doc, start, windows = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start, windows = a[order], b[order], doc[order], start[order], windows[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            again = (doc != doc[lead]) | (start != start[lead])
            stretch = np.where(again, windows + (length - 1), windows)
            if listed:
                with np.errstate(over="ignore"):  # marked already: any partition will do
                    a = np.where(again, (doc * 1_000_003 + start) * 0x9E3779B97F4A7C1, a)
            return pa.RecordBatch.from_arrays([pa.array(again.astype(np.int32)), pa.array(a), pa.array(b), pa.array(doc), pa.array(start << 32 | stretch)], ["kind", "a", "b", "doc", "at"])

        for batch in batches:
            parts, held, found = [], 0, []
            stretches = batch.column(2) if listed else [None] * batch.num_rows
            for doc, text, ats in zip(batch.column(0).to_pylist(), batch.column(1), stretches):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if doc is None or len(text) < length:
                    continue
                if listed:
                    pieces = [(at >> 32, at & 0xFFFFFFFF) for at in ats.as_py()]
                else:
                    pieces = [(s, min(piece, len(text) - length + 1 - s)) for s in range(0, len(text) - length + 1, piece)]
                for s, windows in pieces:
                    part = text[s : s + windows + length - 1]
                    parts.append((doc, s, part))
                    held += len(part)
                    if held >= chunk:
                        found.append(ranked(parts))
                        parts, held = [], 0
            if parts:
                found.append(ranked(parts))
            if found:
                yield given(found)

    return run


def _first_round(length: int):
    """Over rows sorted by (a, b, doc, at): removed stretches (kind 1), and first occurrences that need a further round (kind 0)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["kind", "a", "b", "doc", "at"]
        last = None  # of the pair before: a, b, doc, start, windows, whether given as needing more

        for batch in batches:
            kind, a, b, doc, at = (batch.column(i).to_numpy() for i in range(5))
            done = kind == 1
            out = [(1, doc[done], at[done])]
            a, b, doc, at = (x[~done] for x in (a, b, doc, at))
            n = len(a)
            if not n:
                zero = np.zeros(len(out[0][1]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(zero), pa.array(zero), pa.array(out[0][1]), pa.array(out[0][2])], names)
                continue
            start, windows = at >> 32, at & 0xFFFFFFFF
            head = np.ones(n, bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            carried = last is not None and last[0] == a[0] and last[1] == b[0]
            lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
            lead_doc, lead_start = doc[lead], start[lead]
            if carried:
                head[0] = False
                lead_doc[lead == 0], lead_start[lead == 0] = last[2], last[3]
            again = (doc != lead_doc) | (start != lead_start)
            f = np.flatnonzero(head)
            fa = a[f]
            multi = np.zeros(len(f), bool)
            same = fa[1:] == fa[:-1]
            multi[1:] |= same
            multi[:-1] |= same
            out.append((1, doc[again], start[again] << 32 | (windows[again] + length - 1)))
            if len(f):
                if last is not None and last[0] == fa[0]:
                    multi[0] = True
                    if not last[5]:
                        out.append((0, np.array([last[2]]), np.array([last[3] << 32 | last[4]])))
                        last = (*last[:5], True)
                out.append((0, doc[f[multi]], at[f[multi]]))
                e = f[-1]
                last = (a[e], b[e], int(doc[e]), int(start[e]), int(windows[e]), bool(multi[-1]))
            kind = np.concatenate([np.full(len(d), k, np.int32) for k, d, _ in out])
            zero = np.zeros(len(kind), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(zero), pa.array(zero), pa.array(np.concatenate([d for _, d, _ in out])), pa.array(np.concatenate([x for _, _, x in out]))], names)

    return run


def _windows(length: int):
    """Function over (doc, text, ats): rank pairs of all windows of the listed stretches."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        h64, half = xxhash.xxh3_64_intdigest, min(64, length - 1)

        def given(found):
            a, b, doc, start = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start = a[order], b[order], doc[order], start[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            again = (doc != doc[lead]) | (start != start[lead])
            keep = head | again
            with np.errstate(over="ignore"):  # marked already: any partition will do
                a = np.where(again, (doc * 1_000_003 + start) * 0x9E3779B97F4A7C1, a)
            return pa.RecordBatch.from_arrays([pa.array(again[keep].astype(np.int32)), pa.array(a[keep]), pa.array(b[keep]), pa.array(doc[keep]), pa.array(start[keep] << 32 | length)], ["kind", "a", "b", "doc", "at"])

        for batch in batches:
            found, held = [], 0
            for doc, text, ats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spots = [s for at in ats.as_py() for s in range(at >> 32, (at >> 32) + (at & 0xFFFFFFFF))]
                a = np.array([h64(data[s : s + half]) for s in spots], np.uint64).view(np.int64)
                b = np.array([h64(data[s + half : s + length]) for s in spots], np.uint64).view(np.int64)
                found.append((a, b, np.full(len(spots), doc, np.int64), np.array(spots, np.int64)))
                held += len(spots)
                if held > 300_000:
                    yield given(found)
                    found, held = [], 0
            if found:
                yield given(found)

    return run


def _second_round():
    """Over rows sorted by (a, b, doc, at): rows marked already, and all but the first of equal pairs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = None
        for batch in batches:
            kind, a, b, doc, at = (batch.column(i).to_numpy() for i in range(5))
            done = kind == 1
            gone_doc, gone_at = doc[done], at[done]
            a, b, doc, at = (x[~done] for x in (a, b, doc, at))
            if not len(a):
                zero = np.zeros(len(gone_doc), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(zero), pa.array(zero), pa.array(gone_doc), pa.array(gone_at)], ["kind", "a", "b", "doc", "at"])
                continue
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            lead = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            lead_doc, lead_at = doc[lead], at[lead]
            if last is not None and last[0] == a[0] and last[1] == b[0]:
                lead_doc[lead == 0], lead_at[lead == 0] = last[2], last[3]
            again = (doc != lead_doc) | (at != lead_at)
            last = (a[-1], b[-1], int(lead_doc[-1]), int(lead_at[-1]))
            gone_doc, gone_at = np.concatenate([gone_doc, doc[again]]), np.concatenate([gone_at, at[again]])
            zero = np.zeros(len(gone_doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(zero), pa.array(zero), pa.array(gone_doc), pa.array(gone_at)], ["kind", "a", "b", "doc", "at"])

    return run


def _cut_out(with_text: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
        for batch in batches:
            rows = [[] for _ in names]
            for doc, text, ats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                gone, spans, kept = 0, 0, data
                if ats.is_valid and len(ats):
                    at = np.unique(ats.values.to_numpy())
                    start = at >> 32
                    reach = np.maximum.accumulate(start + (at & 0xFFFFFFFF))
                    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                    begins, ends = start[new].tolist(), reach[np.append(new[1:] - 1, len(at) - 1)].tolist()
                    spans, gone = len(begins), sum(ends) - sum(begins)
                    kept = b"".join(data[x:y] for x, y in zip([0, *ends], [*begins, len(data)]))
                values = [doc, len(data), gone, spans, hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "ignore")] * with_text
                for column, v in zip(rows, values):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept text with ``with_text`` (cut characters left out)."""
    if length < 2 * K:
        raise ValueError(f"length must be at least {2 * K}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sample = Stored(rows.mapInArrow(_sample(length), ROWS))
    pairs = sample.df.where("kind = 0").repartition("a").sortWithinPartitions("a", "b", "doc", "at")
    first = Stored(pairs.mapInArrow(_first_round(length), ROWS).select("kind", "doc", "at").union(sample.df.where("kind = 1").select("kind", "doc", "at")))
    sample.drop()
    by_doc = rows.repartition("doc")  # one shuffle of the texts, read by all joins

    def with_stretches(found: DataFrame, how: str = "inner") -> DataFrame:
        lists = found.groupBy("doc").agg(F.collect_list("at").alias("ats")).withColumnRenamed("doc", "d")
        return by_doc.join(lists.hint("merge"), F.col("doc") == F.col("d"), how).select("doc", "text", "ats")

    longer = with_stretches(first.df.where("kind = 0")).mapInArrow(_sample(length, length * 4 // 5, listed=True), ROWS)
    longer = longer.repartition("a").sortWithinPartitions("a", "b", "doc", "at").mapInArrow(_first_round(length), ROWS)
    windows = with_stretches(longer.where("kind = 0")).mapInArrow(_windows(length), ROWS)
    second = windows.repartition("a", "b").sortWithinPartitions("a", "b", "doc", "at").mapInArrow(_second_round(), ROWS)
    gone = first.df.where("kind = 1").select("doc", "at").union(longer.where("kind = 1").select("doc", "at")).union(second.select("doc", "at"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    return with_stretches(gone, "left").mapInArrow(_cut_out(with_text), out)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


#: Every window of every text, in pieces of 1,000 windows; for small tables.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 1000)) AS piece_at FROM d),
p AS MATERIALIZED (SELECT doc_id, piece_at, substr(h, 2 * piece_at + 1, 2198) AS part FROM c),
w AS (SELECT doc_id, piece_at, part, unnest(range(0, len(part) // 2 - 99)) AS o FROM p),
k AS (SELECT doc_id, piece_at + o AS s, row_number() OVER (PARTITION BY substr(part, 2 * o + 1, 200) ORDER BY doc_id, piece_at + o) AS nth FROM w),
g AS (SELECT doc_id, s, s - lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) > 100 AS new FROM k WHERE nth > 1),
i AS (SELECT doc_id, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, island),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prior FROM r),
t AS (SELECT q.doc_id, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
