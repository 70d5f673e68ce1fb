"""N-gram Jaccard join by PartEnum signatures, and the groups its links make.

A document is its set of distinct word shingles. Two documents link when their sets have a
Jaccard similarity of ``SIMILAR`` (3/4) or more. Equal sets are one class, known by a 128-bit
sum of its hashes; only one member of a class per task makes signatures.

Set sizes are cut into bands [l, r] with r = floor(4 l / 3), so similar sets lie in the same
or in neighbouring bands. Similar sets whose larger one is in band t differ in at most
k = floor(2 r / 7) shingles. The shingle domain is dealt by a hash into k + 1 partitions, and
so at least one of them (an enumeration of subsets of size one, k2 = 0) has no difference: a
set's signatures for band t are the hashes of its shingles in each partition. A set makes
signatures for its own and the next band. Where a small set (under ``SMALL`` shingles) has an
empty partition, that partition's signature is refined by each of its first floor(n/4)+1
shingles in hash order, of which similar sets share one; for larger sets the chance that all
undivided partitions are empty is under 1e-10, and they are left out.

Signatures are sorted; a bucket is those who share one. First each document is compared, by
its whole text, with the one that is the least member of most of its buckets (if sizes and
sketches, see below, allow it), then, in a few rounds, with one of another component of its
buckets. Then, for every bucket whose members are
not yet in one component, all pairs between different components are taken up, and pairs whose
counts of shingles by ranges of a hash alone (the
sketches) differ by more than two similar sets may are passed over: that difference is never
larger than the true one. What is left is
compared by whole text. All links between different classes are thus either found or between
documents that other links already join, so components are exact.

Buckets of more than ``BLOCK_ROWS`` members, mostly unlike documents that share a passage, are dealt
anew first: the shingles of their members are put in one order, by the number of members that
have them, and a member goes to the buckets of its first floor(n/4)+1 shingles. Similar sets meet
at the first shingle they share, which is in both beginnings, and what follows it has to be enough;
a common passage stands at the end of that order. Such buckets that are still large are compared
in pairs of blocks.

Defined cases: null texts and texts without words have no set and link with nothing; fewer
words than a shingle are one shingle; rows that share an id are linked; a row without an id
makes no links and shows the component of its class (null if there is none); an empty table
gives no rows; other columns are not looked at; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm import shingles
from tramline.llm.common import kept, table
from tramline.llm.components import components
from tramline.llm.shingles import mixed

SIMILAR = (75, 100)
SMALL = 128
SKETCH_BITS = (10, 14)
STAR_ROUNDS = 2
BLOCK_ROWS = 512
PAIRS_AT_ONCE = 1 << 20
MOST_SENT = 1 << 20

U = np.uint64
SALTS = [U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
MEMBERS = "doc_id bigint, n_shingles bigint, high bigint, low bigint, sketch binary"


def bands(largest: int) -> np.ndarray:
    """The last size of each band, up to the band after that of ``largest``."""
    upper = [1]
    while len(upper) < 2 or upper[-2] < largest:
        upper.append((upper[-1] + 1) * SIMILAR[1] // SIMILAR[0])
    return np.array(upper, dtype=np.int64)


def sums(values: np.ndarray, cells: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, dtype=np.uint64)
    np.add.at(out, cells, values)
    return out


def class_of(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    return (sums(mixed(hashes ^ SALTS[0]), of, len(begin) - 1).view(np.int64),
            sums(mixed(hashes ^ SALTS[1]), of, len(begin) - 1).view(np.int64))


def sketches(hashes: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Of each set, how many shingles are in each of 2**b partitions, two bits each (3 or more: 3).

    Partitions are ranges of a hash, at least two for each shingle within the limits, so the
    sketch of a larger set is folded to that of a smaller one by adding neighbours.
    """
    spread = mixed(hashes ^ SALTS[2])
    out = []
    for at, end in zip(begin[:-1], begin[1:]):
        bits = min(max(int(2 * (end - at) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
        found = np.bincount((spread[at:end] >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        four = np.minimum(found, 3).astype(np.uint8).reshape(-1, 4)
        out.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes())
    return out


UNPACKED = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


def member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shingles.slices(batch, 1):
            hashes, begin = shingles.sets(part.column(1))
            high, low = class_of(hashes, begin)
            sketch = sketches(hashes, begin)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(np.diff(begin)), pa.array(high), pa.array(low),
                 pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "high", "low", "sketch"])


def signatures(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) rows of non-empty sets given by sorted hashes and where each begins."""
    n = np.diff(begin)
    rows = len(n)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(rows), n)
    upper = bands(int(n.max()))
    own = np.searchsorted(upper, n)
    marks, sets = [], []
    for band in (own, own + 1):
        parts = 2 * upper[band] // 7 + 1
        at = np.concatenate([[0], np.cumsum(parts)])
        part = ((mixed(hashes ^ SALTS[3]) >> U(32)) * parts[of].astype(np.uint64)) >> U(32)
        cells = at[of] + part.astype(np.int64)
        total = sums(mixed(hashes ^ ~SALTS[1]), cells, int(at[-1]))
        some = np.bincount(cells, minlength=int(at[-1])) > 0
        of_cell = np.repeat(np.arange(rows), parts)
        name = mixed((np.arange(int(at[-1])) - at[of_cell]).astype(np.uint64) * U(0x10001)
                     + band[of_cell].astype(np.uint64) + SALTS[0])
        marks.append(mixed(total[some] ^ name[some]))
        sets.append(of_cell[some])
        empty = np.flatnonzero(~some & (n[of_cell] < SMALL))
        prefix = n[of_cell[empty]] // 4 + 1
        if len(empty):
            cell = np.repeat(empty, prefix)
            step = np.arange(len(cell)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            marks.append(mixed(hashes[begin[of_cell[cell]] + step] ^ mixed(name[cell] ^ SALTS[2])))
            sets.append(of_cell[cell])
    return np.concatenate(marks), np.concatenate(sets)


def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()   # classes this task has done: copies add nothing
    for batch in batches:
        for part in shingles.slices(batch, 1, 1 << 21):
            hashes, begin = shingles.sets(part.column(1))
            ids = part.column(0).cast(pa.int64()).to_pylist()
            high, low = class_of(hashes, begin)
            fresh = []
            for i, (key, size) in enumerate(zip(ids, np.diff(begin).tolist())):
                if key is not None and size and (mark := (int(high[i]), int(low[i]))) not in seen:
                    seen.add(mark)
                    fresh.append(i)
            if not fresh:
                continue
            take = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in fresh])
            sizes = np.diff(begin)[fresh]
            marks, sets = signatures(hashes[take], np.concatenate([[0], np.cumsum(sizes)]))
            keys = np.array([ids[i] for i in fresh], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks.view(np.int64)), pa.array(keys[sets])], names=["signature", "id"])


def similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, text_u, text_v) whose sets are similar, as (u, v)."""
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        at = 0
        for part in shingles.slices(batch, 3, 1 << 21):
            left, begin_left = shingles.sets(part.column(2))
            right, begin_right = shingles.sets(part.column(3))
            for i in range(len(part)):
                a, b = left[begin_left[i]:begin_left[i + 1]], right[begin_right[i]:begin_right[i + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                keep[at + i] = union > 0 and SIMILAR[1] * both >= SIMILAR[0] * union
            at += len(part)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


class Sketches:
    """Sketches of a batch by row, folded to any smaller size once."""

    def __init__(self, column: pa.Array):
        self.own = column.to_pylist()
        self.bits = np.array([len(b).bit_length() + 1 for b in self.own])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrix of all sketches of ``bits`` or more, its odd counts as bits, and each row's place in it."""
        if bits not in self.folded:
            rows = np.flatnonzero(self.bits == bits)
            raw = np.frombuffer(b"".join(self.own[r] for r in rows), np.uint8)
            counts = UNPACKED[raw].reshape(len(rows), 1 << bits)
            place = np.full(len(self.own), -1)
            if (self.bits > bits).any():
                larger, _, known = self.at(bits + 1)
                place = np.where(known >= 0, known + len(rows), -1)
                counts = np.concatenate([counts, larger[:, ::2] + larger[:, 1::2]])
            place[rows] = np.arange(len(rows))
            odd = np.packbits(counts & 1, axis=1).view(np.uint64)
            self.folded[bits] = counts, odd, place
        return self.folded[bits]

    def near(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether at most ``most`` shingles may be in one of two sets only.

        Counts differ at least where one is odd and the other is not, so these are looked at first.
        """
        out = np.zeros(len(a), dtype=bool)
        least = np.minimum(self.bits[a], self.bits[b])
        for bits in np.unique(least):
            counts, odd, place = self.at(int(bits))
            where = np.flatnonzero(least == bits)
            step = max(1, (1 << 25) >> int(bits))
            for i in range(0, len(where), step):
                w = where[i:i + step]
                differ = np.bitwise_count(odd[place[a[w]]] ^ odd[place[b[w]]]).sum(axis=1, dtype=np.int64)
                w = w[differ <= most[w]]
                for j in range(0, len(w), step >> 3 or 1):
                    x = w[j:j + (step >> 3 or 1)]
                    one, two = counts[place[a[x]]], counts[place[b[x]]]
                    apart = (np.maximum(one, two) - np.minimum(one, two)).sum(axis=1, dtype=np.int64)
                    out[x] = apart <= most[x]
        return out


def pairs_within(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs of different components in each group of rows (bucket, one, two) that may link.

    Rows of a group come by component. ``place`` is the bucket's place in the order of the row's
    shingles: no more than those from there on are in both sets.
    """
    column = {n: batch.column(n).to_numpy() for n in (
        "bucket", "one", "two", "block", "id", "component", "n_shingles", "place")}
    size, n = column["n_shingles"], len(batch)
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([column[c][1:] != column[c][:-1] for c in ("bucket", "one", "two")], axis=0)
    end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    new[1:] |= column["component"][1:] != column["component"][:-1]
    other_component = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
    ids, known = np.unique(column["id"], return_index=True)
    of = np.searchsorted(ids, column["id"])
    sketch = Sketches(batch.column("sketch").take(pa.array(known)))
    size_of, left = size[known], size - column["place"]
    one_block = column["one"] == column["two"]
    u, v, waiting, count = [], [], [], 0

    def settle() -> None:
        both = np.sort(np.concatenate(waiting))
        both = both[np.append(True, both[1:] != both[:-1])[:len(both)]]
        a, b = both // len(ids), both % len(ids)
        near = sketch.near(a, b, (size_of[a] + size_of[b]) // 7)
        u.append(ids[a[near]])
        v.append(ids[b[near]])
        waiting.clear()

    active, other = np.arange(n), other_component
    while True:
        more = other < end[active]
        active, other = active[more], other[more]
        if not len(active):
            break
        a, b = size[active], size[other]
        may = SIMILAR[0] * np.maximum(a, b) <= SIMILAR[1] * np.minimum(a, b)
        may &= 7 * np.minimum(left[active], left[other]) >= 3 * (a + b)
        may &= one_block[active] | (column["block"][active] != column["block"][other])
        a, b = of[active[may]], of[other[may]]
        waiting.append(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        count += len(a)
        if count > PAIRS_AT_ONCE:
            settle()
            count = 0
        other = other + 1
    if waiting:
        settle()
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(whole(u)), pa.array(whole(v))], names=["u", "v"])


def allowed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, n_u, n_v, sketch_u, sketch_v) that sizes and sketches allow, as (u, v)."""
    for batch in batches:
        n = len(batch)
        a, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        both = Sketches(pa.chunked_array([batch.column(4), batch.column(5)]).combine_chunks())
        keep = SIMILAR[0] * np.maximum(a, b) <= SIMILAR[1] * np.minimum(a, b)
        keep &= both.near(np.arange(n), np.arange(n) + n, (a + b) // 7)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of each row (id, component, text), with the row's size and class."""
    for batch in batches:
        for part in shingles.slices(batch, 2, 1 << 21):
            hashes, begin = shingles.sets(part.column(2))
            high, _ = class_of(hashes, begin)
            of = np.repeat(np.arange(len(part)), np.diff(begin))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)),
                 pa.array(high[of]), pa.array(np.diff(begin)[of])], names=["bucket", "id", "component", "class", "n"])


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pairs_within`` of a sorted stream; a group that a batch cuts waits for its rest."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        last = {n: batch.column(n)[len(batch) - 1].as_py() for n in ("bucket", "one", "two")}
        same = np.all([batch.column(n).to_numpy() == x for n, x in last.items()], axis=0)
        cut = len(batch) - int(same.sum())
        if cut:
            yield pairs_within(batch.slice(0, cut))
        rest = batch.slice(cut)
    if rest is not None:
        yield pairs_within(rest)


def members_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, representative) per row; (id, n_shingles, sketch) per representative."""
    rows = kept(docs.mapInArrow(member_rows, MEMBERS), "join-members")
    some = rows.filter("n_shingles > 0")
    classes = some.groupBy("n_shingles", "high", "low").agg(F.min("doc_id").alias("representative"))
    members = kept(rows.join(classes, ["n_shingles", "high", "low"], "left").select(
        "doc_id", "n_shingles", F.coalesce("representative", "doc_id").alias("representative")), "join-classes")
    sketched = (
        some.join(classes, ["n_shingles", "high", "low"]).filter("doc_id = representative")
        .select(F.col("doc_id").alias("id"), "n_shingles", "sketch").dropDuplicates(["id"])
    )
    return members, sketched


def buckets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(bucket, id): classes that share a signature, each such set of classes once."""
    together = W.partitionBy("signature")
    found = (
        docs.mapInArrow(signature_rows, "signature bigint, id bigint")
        .withColumn("rows", F.count(F.lit(1)).over(together))
        .withColumn("all", F.expr("bit_xor(xxhash64(id))").over(together))
        .withColumn("least", F.min("id").over(together))
        .filter("rows > 1")
        .select(F.xxhash64("all", "rows", "least").alias("bucket"), "id")
        .distinct()
    )
    copies = members.filter("doc_id != representative").select(F.col("doc_id").alias("id"), "representative").distinct()
    found = (
        found.join(copies, "id", "left")
        .select("bucket", F.coalesce("representative", "id").alias("id")).distinct()
    )
    return kept(found, "join-buckets")


def sent(ids: DataFrame) -> DataFrame:
    """Ids to join texts with: to every task up to ``MOST_SENT``, so that no other texts are shuffled."""
    ids = kept(ids, "join-ids")
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that link, judged on whole texts."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = docs.join(sent(ids), "doc_id", "left_semi")
    u = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    v = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    both = pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(similar_rows, "u bigint, v bigint").distinct()


def allowed(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that may link by sizes and sketches."""
    side = lambda x: sketched.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(
        allowed_rows, "u bigint, v bigint")


def labelled(buckets: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Buckets whose members are in several components, with each member's component."""
    found = buckets.join(components(edges, name), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    several = found.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.count(F.lit(1)).alias("rows")).filter("least != most").select("bucket", "rows")
    return found.join(several, "bucket")


def dealt_anew(large: DataFrame, docs: DataFrame) -> DataFrame:
    """(bucket, id, component, place, rows): members of large buckets under their rarest shingles.

    A bucket is a shingle with members of several components; ``place`` is the shingle's in the
    member's order.
    """
    ids = sent(large.select(F.col("id").alias("doc_id"), "component").distinct())
    together, order = W.partitionBy("bucket"), W.partitionBy("id", "class")
    return (
        docs.join(ids, "doc_id").select(F.col("doc_id").alias("id"), "component", "text")
        .mapInArrow(shingle_rows, "bucket bigint, id bigint, component bigint, class bigint, n bigint")
        .withColumn("met", F.count(F.lit(1)).over(together)).filter("met > 1")
        .withColumn("place", F.dense_rank().over(order.orderBy("met", "bucket")))
        .withColumn("place", F.expr("n - 1") - F.max("place").over(order) + F.col("place"))
        .filter("4 * place <= n")
        .withColumn("rows", F.count(F.lit(1)).over(together))
        .withColumn("least", F.min("component").over(together))
        .withColumn("most", F.max("component").over(together)).filter("least != most")
        .select("bucket", "id", "component", "place", "rows")
    )


def across(open_rows: DataFrame) -> DataFrame:
    """For each id the other component's member to try: the least of the first or the last
    component of a bucket, the one that stands so in most of the id's buckets; as pairs (u, v)."""
    ends = open_rows.groupBy("bucket").agg(
        F.min(F.struct("component", "id")).alias("low"),
        F.max(F.struct("component", (-F.col("id")).alias("minus"))).alias("high"))
    other = F.when(F.col("low.component") != F.col("component"), F.col("low.id")).otherwise(-F.col("high.minus"))
    chosen = (
        open_rows.join(ends, "bucket").select("id", other.alias("other")).groupBy("id", "other").count()
        .groupBy("id").agg(F.max_by("other", F.struct("count", -F.col("other"))).alias("other"))
    )
    return chosen.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id that links lead to)."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    members, sketched = members_of(docs)
    buckets = buckets_of(docs, members)
    lead = buckets.groupBy("bucket").agg(F.min("id").alias("lead"))
    nearest = (
        buckets.join(lead, "bucket").filter("id != lead").groupBy("id", "lead").count()
        .groupBy("id").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("u"))
        .select("u", F.col("id").alias("v"))
    )
    nearest = kept(nearest, "join-pairs")
    ids = W.partitionBy("doc_id")
    repeated = members.filter("doc_id is not null").select("doc_id", "representative").withColumn(
        "u", F.min("representative").over(ids)).filter("u != representative").select(
        "u", F.col("representative").alias("v")).distinct()
    near = kept(allowed(nearest, sketched), "join-near")
    links = kept(similar(near, docs).unionByName(repeated), "join-links")
    tried = nearest
    for _ in range(STAR_ROUNDS):
        pairs = kept(across(kept(labelled(buckets, links, "join-star"), "join-open")), "join-pairs")
        near = kept(allowed(pairs.join(tried, ["u", "v"], "left_anti"), sketched), "join-near")
        links = kept(links.unionByName(similar(near, docs)), "join-links")
        tried = tried.unionByName(pairs)
    last = kept(labelled(buckets, links, "join-last"), "join-open")
    compared = last.filter(F.col("rows") <= BLOCK_ROWS).withColumn("place", F.lit(0).cast("bigint")).select(
        "bucket", "id", "component", "place", "rows").unionByName(
        dealt_anew(last.filter(F.col("rows") > BLOCK_ROWS), docs))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    dealt = (
        compared
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                "block", "id", "component", "place")
        .join(sketched, "id")
    )
    sorted_groups = dealt.repartition("bucket", "one", "two").sortWithinPartitions(
        "bucket", "one", "two", "component", "id")
    more = sorted_groups.mapInArrow(pair_rows, "u bigint, v bigint").distinct()
    more = kept(more.join(tried, ["u", "v"], "left_anti"), "join-more")
    links = kept(links.unionByName(similar(more, docs)), "join-all-links")
    found = components(links, "join-components")
    return members.join(
        found.select(F.col("id").alias("representative"), "component"), "representative", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"))


def op8_partenum_join(spark, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct([array_to_string(words[i:i + 4], ' ')
                                          FOR i IN range(1, len(words) - 3)]) END AS shingles
  FROM worded),
flat AS (SELECT doc_id, unnest(shingles) AS shingle FROM shingled),
sized AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM shingled),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sized a ON a.doc_id = u JOIN sized b ON b.doc_id = v
  WHERE 100 * n_both >= 75 * (a.n_shingles + b.n_shingles - n_both)),
reached AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.seen = l.u)
SELECT s.doc_id, s.n_shingles, m.component_id
FROM sized s JOIN (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id) m USING (doc_id)
"""
