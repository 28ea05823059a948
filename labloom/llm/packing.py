"""Items of varying length into containers of fixed capacity, by deficit round-robin over sources.

Items are spread over shards by a hash of their id; a shard is packed in one task. Every source has a queue, sorted by
size, and a deficit: the tokens it is due by its target share of what has been packed, less what it has got. The source
whose deficit is greatest for its share gives the largest of its items that fits, until nothing fits and the container is
closed; in the last three eighths of a container the deficits choose among the CLOSE largest items of all sources that fit, so
that little room is left. The deficits go on to the next container. Across shards they go on too: a shard starts with the
deficits all shards before it leave behind, which prefix sums over (shard, source) totals give without packing anything.

Containers that a shard leaves with room to spare (its last ones, mostly) are opened again: their items go to a second
round over groups of shards, and from there to a third, each packed the same way. A round starts with the deficits that the
containers closed before it leave behind, and carries them across its shards by prefix sums too. ``mixture`` reports how far
every window of containers is from the target shares.

An item that exceeds the capacity is cut into pieces of the full capacity and a rest; no other item is split.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SHARD_ITEMS = 8192
#: Containers filled to less are packed again in the next round.
GOOD_FILL = 0.99
#: So many shards meet in one group of the next round.
FAN_IN = 64
#: In the last part of a container the deficits choose among so many items, the largest that fit.
LAST_PART, CLOSE = 3 / 8, 16
#: Containers in a window of the mixture report.
WINDOW = 16
#: Shards in a block of the two-level prefix sums.
BLOCK = 1024


class Queues:
    """The queues of all sources, and their deficits for their shares (what a source has got by its share, less than which others have got is due)."""

    def __init__(self, items, shares, deficits):
        self.by_source: dict[str, list] = {}
        for item in items:  # (size, id, ..., source)
            self.by_source.setdefault(item[-1], []).append(item)
        for q in self.by_source.values():
            q.sort()
        self.all = sorted(items)
        self.shares = shares
        self.got = {s: self._of(s, -deficits.get(s, 0.0)) for s in self.by_source}
        self.heap = [(v, s) for s, v in self.got.items()]
        heapq.heapify(self.heap)

    def _of(self, source, tokens: float) -> float:
        share = self.shares.get(source, 0.0)
        return tokens / share if share > 0 else float("inf")

    def take(self, item) -> None:
        for q in (self.all, self.by_source[item[-1]]):
            del q[bisect_left(q, item)]
        self.got[item[-1]] += self._of(item[-1], item[0])

    def by_deficit(self, room: int):
        """The largest item that fits of the source with the greatest deficit that has one, or None."""
        aside, found = [], None
        while self.heap and found is None:
            got, s = self.heap[0]
            if not self.by_source[s]:
                heapq.heappop(self.heap)
            elif got != self.got[s]:
                heapq.heapreplace(self.heap, (self.got[s], s))
            elif i := bisect_right(self.by_source[s], (room, _LAST)):
                found = self.by_source[s][i - 1]
            else:
                aside.append(heapq.heappop(self.heap))
        for x in aside:
            heapq.heappush(self.heap, x)
        return found

    def next(self, room: int, last_part: bool):
        """The item to take next, or None if nothing fits."""
        if not self.all or self.all[0][0] > room:
            return None
        item = self.by_deficit(room)
        i = bisect_right(self.all, (room, _LAST))
        if not last_part or item[0] >= self.all[max(0, i - CLOSE)][0]:
            return item
        return min(self.all[max(0, i - CLOSE) : i], key=lambda x: (self.got[x[-1]], -x[0], x[1]))


class _Last:
    """Sorts after any id."""

    def __lt__(self, other):
        return False

    def __gt__(self, other):
        return True


_LAST = _Last()


def pack(items, capacity: int, shares: dict, deficits: dict):
    """Containers (lists of items) for items (size, id, ..., source), each of at most ``capacity``; empty items ride along.

    Ids must be unique and comparable.
    """
    queues, containers = Queues(items, shares, deficits), []
    while queues.all:
        room, held = capacity, []
        while (item := queues.next(room, last_part=room <= capacity * LAST_PART)) is not None:
            queues.take(item)
            held.append(item)
            room -= item[0]
        containers.append(held)
    return containers


def _round(level: int, last: bool, good_fill: float):
    """For applyInArrow by (spec_id, shard): one row for each item with its container; container -1: for the next round."""

    def run(key, rows):
        spec, shard = key[0].as_py(), key[1].as_py()
        data = rows.to_pydict()
        capacity = data["capacity"][0] if data["capacity"] else 1
        shares, deficits = {}, {}
        for s, share, due in zip(data["source"], data["share"], data["due"], strict=True):
            shares[s], deficits[s] = share, due
        items = [(n, i, s) for i, (n, s) in enumerate(zip(data["n"], data["source"], strict=True))]
        order = sorted(range(len(items)), key=lambda i: (data["n"][i], data["tie"][i], data["piece"][i], data["source"][i]))
        items = [(data["n"][j], i, data["source"][j]) for i, j in enumerate(order)]
        at, fill = [0] * len(items), [0] * len(items)
        for c, held in enumerate(pack(items, capacity, shares, deficits)):
            size = sum(x[0] for x in held)
            again = not last and size < good_fill * capacity
            for x in held:
                at[order[x[1]]], fill[order[x[1]]] = (-1 if again else (level << 58) + (shard << 30) + c), size
        out = {k: data[k] for k in ("capacity", "id", "source", "share", "tie", "piece", "offset", "n")} | {"container": at, "filled": fill}
        k = len(items)
        schema = pa.schema([("spec_id", pa.int32()), ("capacity", pa.int64()), ("shard", pa.int64()), ("id", rows.schema.field("id").type), ("source", pa.string()), ("share", pa.float64()), ("tie", pa.int64()), ("piece", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()), ("container", pa.int64()), ("filled", pa.int64())])
        return pa.Table.from_pydict({"spec_id": [spec] * k, "shard": [shard] * k, **out}, schema=schema)

    return run


def _before(totals: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``totals`` (one row for each ``by`` and shard) with the sum of a value over all shards before, within ``by``: sums within blocks of shards on top of sums of blocks."""
    t = totals.withColumn("_block", F.floor(F.col("shard") / BLOCK))
    up_to = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*by, "_block").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(up_to(by, "_block")), F.lit(0))).drop("_sum")
    inner = t.withColumn(name, F.coalesce(F.sum(value).over(up_to([*by, "_block"], "shard")), F.lit(0)))
    return inner.join(blocks, [*by, "_block"]).withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


def _carried(left: DataFrame, closed: DataFrame) -> DataFrame:
    """``left``, the items of the next round, with what their source is due when their shard begins: its share of what stands in
    ``closed`` containers and in the shards before, less what it has got there."""
    got = left.groupBy("spec_id", "shard", "source").agg(F.sum("n").alias("got"))
    by_shard = _before(got.groupBy("spec_id", "shard").agg(F.sum("got").alias("shard_got")), ["spec_id"], "shard_got", "packed").drop("shard_got")
    got = _before(got, ["spec_id", "source"], "got", "got_before").drop("got")
    by_source = closed.groupBy("spec_id", "source").agg(F.sum("n").alias("closed_got"))
    by_spec = by_source.groupBy("spec_id").agg(F.sum("closed_got").alias("closed"))
    dues = got.join(by_shard, ["spec_id", "shard"]).join(by_spec, "spec_id", "left").join(by_source, ["spec_id", "source"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    dues = dues.select("spec_id", "shard", "source", (of("closed") + of("packed")).alias("all_before"), (of("closed_got") + of("got_before")).alias("own_before"))
    return left.join(dues, ["spec_id", "shard", "source"], "left").withColumn("due", F.col("share") * of("all_before") - of("own_before")).drop("all_before", "own_before")


def pack_items(sizes: DataFrame, specs: list[tuple[int, int]], *, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", shard_items: int = SHARD_ITEMS, good_fill: float = GOOD_FILL, fan_in: int = FAN_IN, targets: dict[str, float] | None = None, keep_source: bool = False) -> DataFrame:
    """One row for each item or piece: spec_id, container_id, id, piece_no, piece_start, piece_size, filled, capacity, fill, and the source if it is to be kept.

    ``specs`` are (spec_id, capacity), a handful. A null source is the source ''. Null sizes count as 0; items of size 0
    stand in some container too. Repeated rows and repeated ids are items of their own. ``sizes`` is read several times:
    hand in a table that is cheap to read. ``targets`` are the token shares of sources to aim at in every container (a source
    without one has 0); by default those of the whole table. Every item is packed whatever the targets: a source with more
    than its share fills the last containers.
    """
    if not specs or any(c < 1 for _, c in specs):
        raise ValueError("capacities must be positive")
    base = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in specs]))
    n_items = base.count()
    shards = max(1, -(-n_items // shard_items))
    base = base.withColumn("tie", F.xxhash64("id")).withColumn("shard", F.pmod("tie", F.lit(shards)).cast("long"))
    # totals by shard and source, their shares, and what each source is due when a shard begins
    total = base.groupBy("shard", "source").agg(F.sum("size").alias("got"))
    by_source = total.groupBy("source").agg(F.sum("got").alias("all_got"))
    every = by_source.agg(F.sum("all_got").alias("all")).first()["all"] or 0
    share = F.col("all_got") / F.lit(max(every, 1))
    if targets is not None:
        whole = sum(targets.values()) or 1.0
        share = F.coalesce(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v / whole)])[F.col("source")], F.lit(0.0))
    by_shard = _before(total.groupBy("shard").agg(F.sum("got").alias("shard_got")), [], "shard_got", "packed").drop("shard_got")
    dues = _before(total, ["source"], "got", "got_before").join(by_source, "source").join(by_shard, "shard").select("shard", "source", share.alias("share"), (share * F.col("packed") - F.col("got_before")).alias("due"))
    items = base.join(dues, ["shard", "source"]).select("*", spec.alias("s")).select("s.*", "shard", "id", "source", "share", "due", "tie", "size")
    pieces = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("int")
    items = items.select("*", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).withColumn("offset", F.col("piece") * F.col("capacity"))
    items = items.withColumn("n", F.least(F.col("capacity"), F.col("size") - F.col("offset"))).drop("size")
    id_type = sizes.schema[id_col].dataType.simpleString()
    out = f"spec_id int, capacity bigint, shard bigint, id {id_type}, source string, share double, tie bigint, piece int, offset bigint, n bigint, container bigint, filled bigint"
    done, level = None, 0
    while True:
        last = shards == 1
        packed = items.groupBy("spec_id", "shard").applyInArrow(_round(level, last, good_fill), out)
        if last:
            done = packed if done is None else done.unionByName(packed)
            break
        packed = _cut(packed)
        closed = packed.where("container >= 0")
        done = closed if done is None else done.unionByName(closed)
        shards, level = -(-shards // fan_in), level + 1
        left = packed.where("container < 0").drop("container", "filled").withColumn("shard", F.floor(F.col("shard") / fan_in).cast("long"))
        items = _carried(left, done)
    return done.select("spec_id", F.col("container").alias("container_id"), F.col("id").alias(id_col), *([F.col("source").alias(source_col)] if keep_source else []), F.col("piece").alias("piece_no"), F.col("offset").alias("piece_start"), F.col("n").alias("piece_size"), "filled", "capacity", (F.col("filled") / F.col("capacity")).alias("fill"))


def _cut(df: DataFrame) -> DataFrame:
    from labloom.session import cut

    return cut(df)


def mixture(packed: DataFrame, *, source_col: str = "source", window: int = WINDOW, targets: dict[str, float] | None = None) -> DataFrame:
    """(spec_id, window_id, n_containers, n_tokens, error): how far each window of that many containers of a shard, in the order packed, is from the target shares.

    error is the total variation distance, half the sum over all sources of the difference between the share of tokens and
    the target: 0 for equal shares, near 1 for a single small source. Targets are as in ``pack_items``. A window without
    tokens has error 0.
    """
    boxes = packed.select("spec_id", "container_id").distinct().withColumn("shard", F.shiftright("container_id", 30))
    place = F.row_number().over(Window.partitionBy("spec_id", "shard").orderBy("container_id")) - 1
    boxes = boxes.select("spec_id", "container_id", (F.shiftleft("shard", 30) + F.floor(place / window)).alias("window_id"))
    per_box = packed.groupBy("spec_id", "container_id", F.col(source_col).alias("source")).agg(F.sum("piece_size").alias("n")).join(boxes, ["spec_id", "container_id"])
    got = per_box.groupBy("spec_id", "window_id", "source").agg(F.sum("n").alias("n"))
    per = got.groupBy("spec_id", "window_id").agg(F.sum("n").alias("n_tokens")).join(boxes.groupBy("spec_id", "window_id").agg(F.count("*").alias("n_containers")), ["spec_id", "window_id"])
    shares = got.groupBy("spec_id", "source").agg(F.sum("n").alias("all_got"))
    share = F.col("all_got") / F.greatest(F.col("every"), F.lit(1))
    if targets is not None:
        whole = sum(targets.values()) or 1.0
        share = F.coalesce(F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, v / whole)])[F.col("source")], F.lit(0.0))
    shares = shares.join(shares.groupBy("spec_id").agg(F.sum("all_got").alias("every")), "spec_id").select("spec_id", "source", share.alias("share"))
    both = got.join(shares, ["spec_id", "source"]).join(per, ["spec_id", "window_id"])
    apart = F.abs(F.col("n") / F.greatest(F.col("n_tokens"), F.lit(1)) - F.col("share")) - F.col("share")  # a source without tokens is apart by its share
    out = both.groupBy("spec_id", "window_id").agg(F.first("n_containers").alias("n_containers"), F.first("n_tokens").alias("n_tokens"), F.sum(apart).alias("apart"))
    return out.select("spec_id", "window_id", "n_containers", "n_tokens", F.when(F.col("n_tokens") > 0, (F.col("apart") + 1) / 2).otherwise(0.0).alias("error"))


def pack_documents(docs: DataFrame, container_spec: DataFrame, *, folder: str | None = None, **kwargs) -> DataFrame:
    """Pages into the containers of every row of container_spec, sized in the tokens of its tokenizer."""
    from labloom.llm.tokens import TOKENIZER_DIR, encode

    specs = container_spec.select("spec_id", "capacity_tokens", "tokenizer").limit(1001).collect()
    if len(specs) > 1000:
        raise ValueError("container_spec is a list of at most 1000 kinds of containers")
    out = None
    for tokenizer in sorted({s.tokenizer for s in specs}):
        sizes = _cut(encode(docs, extra_col="source", tokenizer=tokenizer, folder=folder or TOKENIZER_DIR, counts=True))
        part = pack_items(sizes, [(s.spec_id, s.capacity_tokens) for s in specs if s.tokenizer == tokenizer], **kwargs)
        out = part if out is None else out.unionByName(part)
    return out
