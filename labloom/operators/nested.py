"""Deeply nested JSON records into related flat rows, by vectorised structural indexing.

All payloads of an Arrow batch are laid end to end. Bitmaps of backslashes, quotes, brackets and delimiters are made over
the bytes; a running parity of the unescaped quotes gives what is inside strings, running sums of the brackets the depth
of everything outside. Tokens sorted by depth find their enclosing bracket by a running maximum, so every value knows its
parent, its key or place, and its span, without a parser's walk. The same bitmaps check each token against the one before
it, so a payload that breaks the grammar anywhere gives no rows. Linked rows are selected by masks over all values of the
batch at once, and their texts are cut out of the bytes by spans. Wrappers are followed by looking for the objects that
bear a pack's key; a payload that is one string is decoded and indexed again, however many layers there are.

``node_rows`` flattens any JSON so: one row for each value, with its parent's number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 4_000_000
OBJECT, ARRAY, END_OBJECT, END_ARRAY, COLON, COMMA, STRING, SCALAR = range(8)
_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\Z")


class Index:
    """Values of all records: rec, parent (a value or -1), span of the key (or -1), place, kind, begin, end; and which records are whole."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        self.raw = raw = b"\n".join(texts) + b"\n"
        self.bytes = b = np.frombuffer(raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(lens) - lens
        rec = np.repeat(np.arange(len(texts)), lens)
        n, at = len(b), np.arange(len(b))
        ok = np.ones(len(texts), bool)

        # quotes and what is inside strings
        slash = b == 92
        self.slashes = np.concatenate([[0], np.cumsum(slash)])
        last = np.maximum.accumulate(np.where(slash, -1, at))
        escaped = np.zeros(n, bool)
        escaped[1:] = ((at[:-1] - last[:-1]) & 1) == 1
        quote = (b == 34) & ~escaped
        count = np.cumsum(quote)
        before = np.where(starts > 0, count[starts - 1], 0)
        inside = ((count - before[rec]) & 1) == 1
        ok[rec[starts + lens - 1][inside[starts + lens - 1]]] = False
        text = inside & ~(quote & inside)
        ok[rec[text & (b < 32) & (at != (starts + lens - 1)[rec])]] = False
        esc = np.flatnonzero(escaped & inside)
        ok[rec[esc[~np.isin(b[esc], np.frombuffer(b'"\\/bfnrtu', np.uint8))]]] = False
        u = esc[b[esc] == 117]
        hexa = np.isin(b, np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
        for k in range(1, 5):
            ok[rec[u[~hexa[np.minimum(u + k, n - 1)]]]] = False

        # delimiters outside strings
        outside = ~inside & ~quote
        kind = np.full(n, -1, np.int8)
        for code, char in ((OBJECT, 123), (ARRAY, 91), (END_OBJECT, 125), (END_ARRAY, 93), (COLON, 58), (COMMA, 44)):
            kind[outside & (b == char)] = code
        kind[quote & inside] = STRING
        loose = outside & (kind < 0) & ~np.isin(b, np.frombuffer(b" \t\n\r", np.uint8))
        head = loose.copy()
        head[1:] &= ~loose[:-1]
        kind[head] = SCALAR
        tok = np.flatnonzero(kind >= 0)
        k, r = kind[tok], rec[tok]
        m = len(tok)
        first = np.ones(m, bool)
        first[1:] = r[1:] != r[:-1]
        seen = np.zeros(len(texts), bool)
        seen[r] = True
        ok &= seen

        # depth by prefix sums, enclosing bracket by a running maximum within a depth
        opens, closes = k <= ARRAY, (k == END_OBJECT) | (k == END_ARRAY)
        step = opens.astype(np.int64) - closes
        depth = np.cumsum(step)
        base = np.zeros(len(texts), np.int64)
        base[r[first]] = (depth - step)[first]
        depth = depth - base[r]
        ok[r[depth < 0]] = False
        final = np.zeros(len(texts), np.int64)
        final[r] = depth  # the last one stays
        ok[final != 0] = False
        level = np.where(opens, depth - 1, np.where(closes, depth + 1, depth))
        who = np.concatenate([np.flatnonzero(opens), np.arange(m)])
        lev = np.concatenate([depth[opens], level])
        defines = np.concatenate([np.ones(int(opens.sum()), bool), np.zeros(m, bool)])
        order = np.lexsort((who, lev, r[who]))
        who, lev, defines = who[order], lev[order], defines[order]
        latest = np.maximum.accumulate(np.where(defines, np.arange(len(who)), -1))
        same = (latest >= 0) & (lev[latest] == lev) & (r[who[latest]] == r[who])
        enclosing = np.full(m, -1, np.int64)
        member = ~defines
        enclosing[who[member]] = np.where(same, who[latest], -1)[member]

        # grammar: each token against the one before it
        prev = np.where(first, -1, np.roll(k, 1))
        ctx = np.where(enclosing >= 0, k[enclosing], -1)
        is_key = (k == STRING) & (ctx == OBJECT) & ((prev == OBJECT) | (prev == COMMA))
        after_key = np.zeros(m, bool)
        after_key[1:] = is_key[:-1] & ~first[1:]
        ended = ((prev == END_OBJECT) | (prev == END_ARRAY) | (prev == STRING) | (prev == SCALAR)) & ~after_key
        value = (opens | (k == STRING) | (k == SCALAR)) & ~is_key
        good = np.ones(m, bool)
        good[value] = np.where(ctx == -1, first, np.where(ctx == ARRAY, (prev == ARRAY) | (prev == COMMA), prev == COLON))[value]
        good[k == COLON] = ((ctx == OBJECT) & after_key)[k == COLON]
        good[k == COMMA] = ((ctx >= 0) & ended)[k == COMMA]
        good[closes] = ((ctx == k - 2) & (ended | (prev == k - 2)))[closes]
        ok[r[~good]] = False
        scalar = np.flatnonzero(k == SCALAR)
        tail = np.flatnonzero(loose & ~np.append(loose[1:], False)) + 1
        ends = np.zeros(m, np.int64)
        ends[scalar] = tail[: len(scalar)] if len(tail) == len(scalar) else tok[scalar] + 1
        words = [raw[tok[i] : ends[i]] for i in scalar]
        fine = {w: bool(_SCALAR.match(w)) for w in set(words)}
        ok[r[scalar[[not fine[w] for w in words]]]] = False

        # values with parent, key, place and span
        strings = np.flatnonzero(k == STRING)
        shut = np.flatnonzero(quote & ~inside)
        ends[strings] = shut[np.minimum(np.searchsorted(shut, tok[strings]), max(len(shut) - 1, 0))] + 1 if len(shut) else tok[strings] + 1
        shutting = np.flatnonzero(closes & (enclosing >= 0))
        ends[enclosing[shutting]] = tok[shutting] + 1
        good_rec = ok[r]
        v = np.flatnonzero(value & good_rec)
        number = np.full(m, -1, np.int64)
        number[v] = np.arange(len(v))
        self.ok, self.rec, self.kind, self.begin, self.end = ok, r[v], k[v], tok[v], ends[v]
        self.parent = np.where(enclosing[v] >= 0, number[enclosing[v]], -1)
        self.null = (self.kind == SCALAR) & (b[self.begin] == 110)
        self.key_begin, self.key_end = np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        keyed = np.flatnonzero(ctx[v] == OBJECT)
        self.key_begin[keyed], self.key_end[keyed] = tok[v[keyed] - 2] + 1, ends[v[keyed] - 2] - 1
        self.keyed = keyed
        self.place = np.zeros(len(v), np.int64)
        by_parent = np.argsort(self.parent, kind="stable")
        p = self.parent[by_parent]
        new = np.ones(len(v), bool)
        new[1:] = p[1:] != p[:-1]
        self.place[by_parent] = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        self.place[self.parent < 0] = 0
        self.size = len(v)
        self.escaped_keys: dict[str, list[int]] = {}
        for i in keyed[self.slashes[self.key_end[keyed]] > self.slashes[self.key_begin[keyed]]].tolist():
            self.escaped_keys.setdefault(_decoded(raw[self.key_begin[i] : self.key_end[i]]), []).append(i)

    def named(self, name: str):
        """The values that bear a key, in order."""
        import numpy as np

        want = np.frombuffer(name.encode(), np.uint8)
        at = self.keyed[(self.key_end - self.key_begin)[self.keyed] == len(want)]
        at = at[(self.bytes[self.key_begin[at][:, None] + np.arange(len(want))] == want).all(axis=1)]
        return np.sort(np.concatenate([at, np.asarray(self.escaped_keys.get(name, []), np.int64)]))

    def under(self, name: str):
        """For every value its child of that name that isn't null (of repeated names the last), or -1."""
        import numpy as np

        out = np.full(self.size + 1, -1, np.int64)
        at = self.named(name)
        out[self.parent[at]] = at
        out[-1] = -1
        hit = out >= 0
        hit[hit] = ~self.null[out[hit]]
        return np.where(hit, out, -1)

    def texts(self, values) -> pa.Array:
        """Values as text: a string without quotes and escapes, anything else as it stands."""
        quoted = (self.kind[values] == STRING).astype("int64")
        return self.cut(self.begin[values] + quoted, self.end[values] - quoted, quoted == 1)

    def keys(self, values) -> pa.Array:
        """The keys of values that have one."""
        return self.cut(self.key_begin[values], self.key_end[values], self.key_begin[values] >= 0)

    def cut(self, begin, end, string) -> pa.Array:
        """Spans of the bytes as text, all at once; escapes are undone where the span is of a string and has any."""
        import numpy as np
        import pyarrow.compute as pc

        size = end - begin
        stop = np.cumsum(size)
        place = np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        offsets = np.concatenate([[0], stop]).astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.bytes[place]))).cast(pa.string())
        odd = string & (self.slashes[end] > self.slashes[begin])
        if odd.any():
            plain = [_decoded(self.raw[x:y]) for x, y in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]
            out = pc.replace_with_mask(out, pa.array(odd), pa.array([t.encode("utf-8", "replace").decode() for t in plain], pa.string()))
        return out


def _decoded(inner: bytes) -> str:
    return json.loads(b'"' + inner + b'"', strict=False) if b"\\" in inner else inner.decode()


class Packs:
    """The rows of the packs in an index, as parts: (child, packs, parent keys, child keys, values), each an array over the rows of one kind."""

    def __init__(self, index: Index):
        import numpy as np

        x, self.x, self.parts = index, index, []
        name = {n: x.under(n) for n in ("benchmark_id", "lineage", "id", "mapping_threshold_config", "default", "overrides", "candidate_code", "threshold", "artifact_refs", "kind", "href", "metrics", "name", "value", "reports", "report_name", "payload", "checks", "metric")}
        self.name = name
        # a pack within a pack is none: spans nest or lie apart, so only ends before a begin matter
        packs = np.flatnonzero(name["benchmark_id"][:-1] >= 0)
        latest = np.concatenate([[-1], np.maximum.accumulate(x.end[packs])[:-1]]) if len(packs) else np.zeros(0, np.int64)
        self.packs = packs = packs[x.begin[packs] >= latest]
        holder = x.parent[packs]
        self.ord = np.where((holder >= 0) & (x.kind[holder] == ARRAY), x.place[packs], 0)
        first = np.searchsorted(x.rec[packs], x.rec[packs]) if len(packs) else packs
        self.no = np.arange(len(packs)) - first
        every = np.arange(len(packs))
        bench = x.texts(name["benchmark_id"][packs])
        self.add("pack", every, pa.array([""] * len(packs), pa.string()), bench, packs)
        lineage = name["lineage"][packs]
        told = (lineage >= 0) & (name["id"][lineage] >= 0)
        told, lineage = every[told], lineage[told]
        lids = x.texts(name["id"][lineage])
        self.add("lineage", told, bench.take(pa.array(told)), lids, lineage)
        config = name["mapping_threshold_config"][lineage]
        default = np.where(config >= 0, name["default"][config], -1)
        has = np.flatnonzero(default >= 0)
        self.add("threshold", told[has], lids.take(pa.array(has)), pa.array(["default"] * len(has), pa.string()), default[has])
        self.entries("threshold", np.where(config >= 0, name["overrides"][config], -1), told, lids, "candidate_code", "threshold")
        self.entries("artifact_ref", name["artifact_refs"][packs], every, bench, "kind", "href")
        self.entries("metric", name["metrics"][packs], every, bench, "name", "value")
        at, keys, values, listed = self.members(name["reports"][packs], "report_name", "payload")
        payload = np.where(listed, values, name["payload"][values])
        good = np.flatnonzero(payload >= 0)
        at, keys, payload = at[good], keys.take(pa.array(good)), payload[good]
        self.add("report", at, bench.take(pa.array(at)), keys, payload)
        self.entries("check", name["checks"][payload], at, keys, "metric", None)

    def add(self, child: str, at, parent_keys: pa.Array, child_keys: pa.Array, values) -> None:
        """Rows of one kind: at are places in ``packs``."""
        self.parts.append((child, at, parent_keys, child_keys, values))

    def members(self, holders, key: str, value: str | None):
        """Of holders (a value or -1 each) the entries of objects keyed by name and of lists of objects that bear the name: place of the holder, names, values, whether from a list."""
        import numpy as np

        x = self.x
        of = np.full(x.size + 1, -1, np.int64)
        of[holders[holders >= 0]] = np.flatnonzero(holders >= 0)
        c = np.flatnonzero((of[x.parent] >= 0) & (x.parent >= 0) & ~x.null)
        kind = x.kind[x.parent[c]]
        direct = c[kind == OBJECT]
        listed = c[(kind == ARRAY) & (x.kind[c] == OBJECT)]
        listed = listed[self.name[key][listed] >= 0]
        values = listed if value is None else self.name[value][listed]
        listed, values = listed[values >= 0], values[values >= 0]
        names = pa.concat_arrays([x.keys(direct), x.texts(self.name[key][listed])])
        return np.concatenate([of[x.parent[direct]], of[x.parent[listed]]]), names, np.concatenate([direct, values]), np.concatenate([np.zeros(len(direct), bool), np.ones(len(listed), bool)])

    def entries(self, child: str, holders, at, parent_keys: pa.Array, key: str, value: str | None) -> None:
        place, names, values, _ = self.members(holders, key, value)
        self.add(child, at[place], parent_keys.take(pa.array(place)), names, values)

    def attributes(self, values) -> pa.Array:
        """Of objects their members that are neither null nor nested (of repeated names the last); of anything else its value."""
        import numpy as np

        x = self.x
        of = np.full(x.size + 1, -1, np.int64)
        whole = x.kind[values] == OBJECT
        of[values[whole]] = np.flatnonzero(whole)
        c = np.flatnonzero((x.parent >= 0) & (of[x.parent] >= 0) & (x.kind >= STRING) & ~x.null)
        alone = np.flatnonzero(~whole)
        row = np.concatenate([of[x.parent[c]], alone])
        keys = pa.concat_arrays([x.keys(c), pa.array(["value"] * len(alone), pa.string())])
        texts = x.texts(np.concatenate([c, values[alone]]))
        code = keys.dictionary_encode().indices.to_numpy()
        mark = row * (int(code.max()) + 1 if len(code) else 1) + code
        _, last = np.unique(mark[::-1], return_index=True)
        keep = np.sort(len(mark) - 1 - last)
        keep = keep[np.argsort(row[keep], kind="stable")]
        offsets = np.searchsorted(row[keep], np.arange(len(values) + 1)).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(offsets), keys.take(pa.array(keep)), texts.take(pa.array(keep)))


def pack_columns(texts: list[bytes], attributes: bool = True) -> list[dict]:
    """Tables (as columns) of all packs in the payloads: place in texts, pack_ord, pack_no, child, parent_key, child_key, attributes."""
    import numpy as np

    out, todo, places = [], texts, np.arange(len(texts))
    while len(todo):
        index = Index(todo)
        packs = Packs(index)
        for child, at, parents, keys, values in packs.parts:
            if len(at):
                columns = {"place": places[index.rec[packs.packs[at]]], "pack_ord": packs.ord[at], "pack_no": packs.no[at], "child": pa.array([child] * len(at), pa.string()), "parent_key": parents, "child_key": keys}
                out.append(columns | ({"attributes": packs.attributes(values)} if attributes else {}))
        # what is one string is decoded and indexed again; each layer is shorter than the one around it
        again = np.flatnonzero((index.parent < 0) & (index.kind == STRING))
        todo = [t.encode("utf-8", "surrogatepass") for t in index.texts(again).to_pylist()]
        places = places[index.rec[again]]
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads (column 1) in slices of bounded size, each with the place of its first."""
    payloads = batch.column(1).to_pylist()
    start = size = 0
    for i in range(len(payloads)):
        size += len(payloads[i])
        if size >= SLICE_BYTES or i + 1 == len(payloads):
            yield start, [p.encode() for p in payloads[start : i + 1]]
            start, size = i + 1, 0


def _flatten_batches(attributes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch):
                for t in pack_columns(texts, attributes):
                    ids = batch.column(0).take(pa.array(t.pop("place") + start))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) if not isinstance(c, pa.Array) else c for c in t.values())], ["record_id", *t])

    return run


def pack_rows(proof_packs: DataFrame, *, id_col: str = "record_id", payload_col: str = "payload", attributes: bool = True) -> DataFrame:
    """(record_id, pack_ord, pack_no, child, parent_key, child_key, attributes map<string,string>): a row for each child of each pack.

    child is pack, lineage, threshold, artifact_ref, metric, report or check; pack_ord is the pack's place in its list,
    pack_no its number in the payload, which with the keys links a row to its parent even where a payload has several lists
    of packs. Null payloads and payloads that aren't whole JSON give no row, nor do entries whose value is null or absent.
    Repeated records give repeated rows; other columns are ignored. ``attributes`` may be left out. No shuffle.
    """
    chosen = proof_packs.select(F.col(id_col).alias("record_id"), F.col(payload_col).alias("payload")).where("payload is not null")
    id_type = chosen.schema["record_id"].dataType.simpleString()
    return chosen.mapInArrow(_flatten_batches(attributes), f"record_id {id_type}, pack_ord bigint, pack_no bigint, child string, parent_key string, child_key string" + (", attributes map<string,string>" if attributes else ""))


KINDS = {OBJECT: "object", ARRAY: "array", STRING: "string", SCALAR: "scalar"}


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    kinds = pa.array([KINDS.get(i, "") for i in range(8)], pa.string())
    for batch in batches:
        for start, texts in _slices(batch):
            x = Index(texts)
            first = np.searchsorted(x.rec, x.rec)
            node = np.arange(x.size) - first
            parent = pa.array(np.where(x.parent >= 0, x.parent - first, 0), mask=x.parent < 0)
            inner = pa.array(x.kind < STRING)
            none = pa.scalar(None, pa.string())
            key = pc.if_else(pa.array(x.key_begin >= 0), x.cut(np.maximum(x.key_begin, 0), np.maximum(x.key_end, 0), x.key_begin >= 0), none)
            leaf = np.where(x.kind < STRING, x.begin, x.end)  # brackets give no text
            quoted = (x.kind == STRING).astype(np.int64)
            value = pc.if_else(pc.or_(inner, pa.array(x.null)), none, x.cut(x.begin + quoted, leaf - quoted, quoted == 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.rec + start)), pa.array(node), parent, key, pa.array(x.place), kinds.take(pa.array(x.kind.astype(np.int64))), value], ["record_id", "node", "parent", "key", "place", "kind", "value"])


def node_rows(records: DataFrame, *, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, node, parent, key, place, kind, value): every value of any JSON as a row, numbered in the order read.

    parent is the number of the object or list around it (null for the whole), key its name there (null in a list), place
    its 0-based place, kind object, array, string or scalar; value is null for objects, lists and JSON null. Null payloads
    and payloads that aren't whole JSON give no row; repeated records give repeated rows; other columns are ignored.
    Strings are not decoded any further. No shuffle.
    """
    chosen = records.select(F.col(id_col).alias("record_id"), F.col(payload_col).alias("payload")).where("payload is not null")
    id_type = chosen.schema["record_id"].dataType.simpleString()
    return chosen.mapInArrow(_node_batches, f"record_id {id_type}, node bigint, parent bigint, key string, place bigint, kind string, value string")


def pack_tables(proof_packs: DataFrame, **kwargs) -> dict[str, DataFrame]:
    """One flat table for each kind of child; lineage bears rule_pack_version and the other versions as columns."""
    rows = pack_rows(proof_packs, **kwargs)
    a = lambda k: F.col("attributes")[k]
    link = ["record_id", "pack_ord", "pack_no"]
    of = lambda c: rows.where(F.col("child") == c)
    return {
        "packs": of("pack").select(*link, F.col("child_key").alias("benchmark_id"), *[a(k).alias(k) for k in ("contract_version", "report_type", "lineage_id")]),
        "lineage": of("lineage").select(*link, F.col("parent_key").alias("benchmark_id"), F.col("child_key").alias("lineage_id"), *[a(k).alias(k) for k in ("job_id", "source_checksum", "terminology_release", "parser_version", "rule_pack_version", "ocr_version")]),
        "thresholds": of("threshold").select(*link, F.col("parent_key").alias("lineage_id"), F.col("child_key").alias("scope"), a("value").try_cast("double").alias("threshold")),
        "artifact_refs": of("artifact_ref").select(*link, F.col("parent_key").alias("benchmark_id"), F.col("child_key").alias("kind"), a("value").alias("href")),
        "metrics": of("metric").select(*link, F.col("parent_key").alias("benchmark_id"), F.col("child_key").alias("name"), a("value").try_cast("double").alias("value")),
        "reports": of("report").select(*link, F.col("parent_key").alias("benchmark_id"), F.col("child_key").alias("report_name"), a("status").alias("status")),
        "checks": of("check").select(*link, F.col("parent_key").alias("report_name"), F.col("child_key").alias("metric"), *[a(k).try_cast("double").alias(k) for k in ("observed", "baseline")]),
    }
