"""Passages that stand character for character in more than one record, by level-wise doubling.

A window of MIN characters is shared if it stands in the text of two records. Windows are tried at 50, 100 and 200
characters (for MIN = 200), each level only over what repeated at the level below:

1. Of all windows of 50 characters those are taken that have the least hash in some stretch of 200 (winnowing): whatever
   200 characters two records share, both take the same window of 50 inside it, at the same place. About one window in 76
   is taken. The texts are read once for that; with each window go the hashes of its extensions to 100 characters, to the
   left and to the right. Counted over the whole corpus, windows that stand in one record alone fall out.
2. Of the rest those fall out whose extensions to 100 characters stand in one record alone. No text is needed for that.
3. Of the records that still have a window the texts are fetched (a bitmap of fixed size over their ids keeps most
   others from being shuffled, as one over the repeated hashes does at level one), and the stretches of 200 around what survived are compared at every offset; stretches whose
   surroundings are the same as a whole are settled at once without that. Stretches that overlap or touch become one span.

What is shared at 200 characters is settled there: a level beyond could change no span, as spans are made of stretches of
MIN characters. Nothing is paired: each level groups windows by hash and asks for a least and a greatest record id. A
window so frequent that its group would not fit a task (more than HOT rows) takes an equal way with one row for each
stretch of 200, aggregated before the shuffle. Hashes have 64 bits (those of level two 32, as it only sifts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

MIN_CHARS = 200
HOT = 4096
SLICE_CHARS = 1_000_000
#: The bitmaps that sift rows before a shuffle have so many words of 64 bits, whatever the data; when full they let everything through.
BITMAP_WORDS = 1 << 19
_CHUNK_ROWS = 2048


def _codes(texts):
    """Code points of all texts one after the other, and their lengths."""
    import numpy as np

    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) ^ (h >> np.uint64(32))


class _Rolling:
    """Hashes of any window of a code array, by prefix sums in arithmetic modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, codes):
        import numpy as np

        n = len(codes)
        power = np.full(n + 1, self.BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def at(self, start, length):
        """Hashes of the windows at ``start`` (an array) of ``length`` characters (a number or an array)."""
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start])

    def all(self, length: int):
        """Hashes of all windows of ``length`` characters."""
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def _sliding(x, width: int, least: bool):
    """For each i the least (greatest) of x[i : i + width]; len(x) - width + 1 of them."""
    import numpy as np

    f, fill = (np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = f.accumulate(blocks, axis=1).reshape(-1)
    after = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(after[: n - width + 1], before[width - 1 : n])


def winnow(texts, min_chars: int = MIN_CHARS):
    """Windows of min_chars // 4 characters taken from the texts: (index of text, place in it, hash, hashes of the extensions to twice the length to the left and right, 0 where there is no room)."""
    import numpy as np

    k = min_chars // 4
    codes, lens = _codes(texts)
    none = np.zeros(0, np.int64)
    if len(codes) < min_chars:
        return none, none, none.astype(np.uint64), none.astype(np.int32), none.astype(np.int32)
    ends = np.cumsum(lens)
    room = np.repeat(ends, lens) - np.arange(len(codes))  # characters from here to the end of this text
    rolling = _Rolling(codes)
    h = rolling.all(k)
    inside = room[: len(h)] >= k
    h = np.where(inside, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    width = min_chars - k + 1
    least = _sliding(h, width, True)
    least[room[: len(least)] < min_chars] = 0
    # a window is taken if its hash is the least of some stretch that holds it: stretches begin up to width - 1 before it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
    taken = np.flatnonzero((_sliding(padded, width, False) == h) & inside)
    doc = np.searchsorted(ends, taken, side="right")
    pos = taken - (ends - lens)[doc]
    twice = []
    for fits, start in ((pos >= k, taken - k), (room[taken] >= 2 * k, taken)):
        x = np.zeros(len(taken), np.int32)
        x[fits] = (rolling.at(start[fits], 2 * k) >> np.uint64(33)).astype(np.int32) + 1
        twice.append(x)
    return doc, pos, h[taken], *twice


def _scan(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            # (doc, place of the part in its text, part): a long text comes in parts that overlap, so that each stretch is whole in one
            parts = [(i, s, t if len(t) <= 2 * SLICE_CHARS else t[s : s + SLICE_CHARS + min_chars - 1]) for i, t in enumerate(texts) for s in (range(0, len(t), SLICE_CHARS) if len(t) > 2 * SLICE_CHARS else (0,))]
            start = size = 0
            for i in range(len(parts)):
                size += len(parts[i][2])
                if size >= SLICE_CHARS or i + 1 == len(parts):
                    chosen = parts[start : i + 1]
                    part, pos, h, left, right = winnow([p[2] for p in chosen], min_chars)
                    doc, offset = np.array([p[0] for p in chosen], np.int64)[part], np.array([p[1] for p in chosen], np.int64)[part]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array((pos + offset).astype(np.int32)), pa.array(left), pa.array(right)], ["h", "doc", "pos", "left", "right"])
                    start, size = i + 1, 0

    return run


def _surroundings(min_chars: int):
    """(doc, text, hits) -> a row for each hit, with the text of all stretches it can stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = min_chars - min_chars // 4
        names = ["h", "hot", "doc", "start", "lead", "around"]
        for batch in batches:
            rows = [[] for _ in names]
            for doc, text, hits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for hit in hits:
                    start = max(0, hit["pos"] - back)
                    for out, x in zip(rows, (hit["h"], hit["hot"], doc, start, hit["pos"] - start, text[start : hit["pos"] + min_chars]), strict=True):
                        out.append(x)
                if len(rows[0]) >= 5000:
                    yield _surrounding_batch(rows, names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield _surrounding_batch(rows, names)

    return run


def _surrounding_batch(rows, names):
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)


def _in_many(key, doc):
    """Whether the key of each row also stands in a row of another doc."""
    import numpy as np

    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(many, np.diff(np.append(first, len(key))))
    return out


def _windows(rolling, begin, lens, lead, group, min_chars):
    """Of every row all stretches of min_chars: (row, place in the row's text, key of group, offset and content)."""
    import numpy as np

    count = np.maximum(lens - min_chars + 1, 0)
    row = np.repeat(np.arange(len(lens)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    h = rolling.at(begin[row] + at, min_chars)
    return row, at, _mixed(h + _mixed(group[row] + (lead[row] - at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def compare(group, doc, start, lead, around, min_chars: int = MIN_CHARS):
    """Levels two and three over whole groups of one window each: (doc, begin, end) of shared stretches."""
    import numpy as np

    k = min_chars // 4
    codes, lens = _codes(around)
    rolling, begin = _Rolling(codes), np.cumsum(lens) - lens
    gone = np.full(len(lens), False)
    # level two: twice the length, to the left and to the right
    left, right = lead >= k, lens - lead >= 2 * k
    alive = gone.copy()
    for side, offset in ((left, -k), (right, 0)):
        rows = np.flatnonzero(side)
        key = _mixed(rolling.at(begin[rows] + lead[rows] + offset, 2 * k) + group[rows])
        alive[rows] |= _in_many(key, doc[rows])
    rows = np.flatnonzero(alive & (lens >= min_chars))
    # surroundings that are the same as a whole are settled at once
    key = _mixed(rolling.at(begin[rows], lens[rows]) + _mixed(group[rows] + lead[rows].astype(np.uint64) * np.uint64(1_000_003) + lens[rows].astype(np.uint64)))
    whole = _in_many(key, doc[rows])
    out = [(doc[rows[whole]], start[rows[whole]].astype(np.int64), start[rows[whole]] + lens[rows[whole]])]
    # the others need two of each such class, of different docs, beside them
    order = np.lexsort((doc[rows], key))
    edge = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(rows) else np.zeros(0, bool)
    keep = ~whole
    keep[order[edge]] = True
    if len(rows):
        keep[order[np.append(np.flatnonzero(edge)[1:] - 1, len(rows) - 1)]] = True
    mixed = np.isin(group[rows], group[rows[~whole]])
    rest = rows[keep & mixed]
    if len(rest):
        row, at, key = _windows(rolling, begin[rest], lens[rest], lead[rest], group[rest], min_chars)
        hit = np.flatnonzero(_in_many(key, doc[rest][row]))
        if len(hit):
            r, a = row[hit], at[hit]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)])
            first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)
            s = start[rest][r[first]].astype(np.int64)
            out.append((doc[rest][r[first]], s + a[first], s + a[last] + min_chars))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _compare_sorted(min_chars: int):
    """For mapInArrow over partitions sorted by h: whole groups, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def result(table):
            h, doc, start, lead = (table.column(c).to_numpy() for c in ("h", "doc", "start", "lead"))
            found = compare(h.view(np.uint64), doc, start, lead, table.column("around").to_pylist(), min_chars)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["doc", "b", "e"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _CHUNK_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                h = t.column("h").to_numpy()
                edge = np.flatnonzero(h[1:] != h[:-1]) + 1  # all groups but the last are whole
                done = 0
                while done < len(edge):
                    upto = max(done + 1, int(np.searchsorted(edge, (edge[done - 1] if done else 0) + _CHUNK_ROWS)))
                    a = edge[done - 1] if done else 0
                    yield result(t.slice(a, edge[upto - 1] - a))
                    done = upto
                t = t.slice(edge[-1] if len(edge) else 0)
                held, rows = t.to_batches(), t.num_rows
        if rows:
            yield result(pa.Table.from_batches(held).combine_chunks())

    return run


def _all_windows(min_chars: int):
    """For mapInArrow: a row for each stretch of min_chars of the surroundings of a hot window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for i in range(0, batch.num_rows, _CHUNK_ROWS):
                b = batch.slice(i, _CHUNK_ROWS)
                h, doc, start, lead = (b.column(c).to_numpy() for c in ("h", "doc", "start", "lead"))
                codes, lens = _codes(b.column("around").to_pylist())
                row, at, key = _windows(_Rolling(codes), np.cumsum(lens) - lens, lens, lead, h.view(np.uint64), min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[row]), pa.array(start[row].astype(np.int64) + at)], ["key", "doc", "b"])

    return run


def shared_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(id, span_start, span_end) of every longest stretch whose characters all stand in some shared window.

    Ids are integers. Null ids, null texts and texts of fewer than ``min_chars`` characters give no row. Rows with the
    same id count as one record: a text repeated under one id isn't shared by that. Other columns are ignored.
    ``min_chars`` must be a multiple of 4. Texts go through whole; offsets are in characters, the end exclusive.
    """
    if min_chars % 4:
        raise ValueError("min_chars must be a multiple of 4")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    taken = _cut(docs.mapInArrow(_scan(min_chars), "h bigint, doc bigint, pos int, left int, right int"))
    lo_hi = (F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    repeated = _cut(taken.groupBy("h").agg(*lo_hi, F.count("*").alias("n")).where("lo < hi").select("h", (F.col("n") > hot).alias("hot")))
    sides = _having(taken, repeated, "h").join(repeated.hint("shuffle_hash"), "h").select("h", "doc", "pos", "hot", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("twice")), F.struct(F.lit(1).alias("side"), F.col("right").alias("twice")))).alias("x")).select("h", "doc", "pos", "hot", "x.*").where("twice <> 0")
    sides = _cut(sides)
    double = sides.groupBy("h", "side", "twice").agg(*lo_hi).where("lo < hi").drop("lo", "hi")
    hits = _cut(sides.join(double, ["h", "side", "twice"]).groupBy("doc").agg(F.collect_set(F.struct("pos", "h", "hot")).alias("hits")))
    docs = _having(docs, hits, "doc")
    around = lambda part: docs.join(part.where(F.size("hits") > 0), "doc").select("doc", "text", "hits").mapInArrow(_surroundings(min_chars), "h bigint, hot boolean, doc bigint, start int, lead int, around string").drop("hot")
    parts = around(hits.withColumn("hits", F.filter("hits", lambda x: ~x["hot"]))).repartition("h").sortWithinPartitions("h").mapInArrow(_compare_sorted(min_chars), "doc bigint, b bigint, e bigint")
    hot_hits = hits.withColumn("hits", F.filter("hits", lambda x: x["hot"])).where(F.size("hits") > 0)
    if not hot_hits.isEmpty():
        windows = around(hot_hits).mapInArrow(_all_windows(min_chars), "key bigint, doc bigint, b bigint")
        many = windows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key")
        parts = parts.unionByName(windows.join(many, "key").select("doc", "b", (F.col("b") + min_chars).alias("e")))
    by_doc = Window.partitionBy("doc").orderBy("b", "e")
    parts = parts.withColumn("new", (F.col("b") > F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))).cast("int"))
    parts = parts.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("doc", "island").agg(F.min("b").alias("span_start"), F.max("e").alias("span_end"))
    return spans.select(F.col("doc").alias(id_col), "span_start", "span_end")


def _having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most that have no row of their key in ``keys``: a bitmap over hashed keys, of at most BITMAP_WORDS rows, is broadcast."""
    at = F.pmod(F.xxhash64(key), F.lit(64 * BITMAP_WORDS))
    word, bit = F.shiftright(at, 6).cast("int"), F.pmod(at, F.lit(64)).cast("int")
    bits = keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.getbit("bits", bit) == 1).drop("word", "bits")


def _cut(df: DataFrame) -> DataFrame:
    from labloom.session import cut

    return cut(df)


def shared_share(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """For each row with an id: characters of its text, how many are shared elsewhere, and their share (0.0 for no text)."""
    spans = shared_spans(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    per = spans.groupBy(F.col(id_col).alias("_doc")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("_shared"))
    base = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars")).where("_doc is not null")
    out = base.join(per, "_doc", "left").withColumn("shared_chars", F.coalesce("_shared", F.lit(0)).cast("long"))
    return out.select(F.col("_doc").alias(id_col), "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"))
