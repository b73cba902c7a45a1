"""Near-duplicate groups by bottom-k sketches of one hash function.

Every text becomes its set of distinct word shingles, hashed once; the ``k``
least hashes are its sketch. Texts with equal sets are one class from then on.
Inverted lists of the retained values bring classes together, an estimate from
the union's sketch filters the pairs, and the full sets, made again from the
texts, confirm them.

Which lists a class enters: linked sets share at least ``shared_least`` retained
values (exactly for sets no larger than the sketch, else but for a chance of
about 1e-7 a pair at the threshold), so with the values in one order, rarest
first, two linked classes also meet in the first ``size - shared_least + 1``.
Values of a passage that many documents share are the last in that order, and
only documents made of little else get so far.

No list is expanded into all pairs. First every class is held against the least
member of its lists, which joins most copies to one component. Where a list still
has members of several components, blocks of members meet, and pairs between
different components that were not compared yet come up, the most alike of each
class and component first, then more, finally all that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, light, narrow
from .fingerprints import split_all, windows, word_hashes
from .substring_dedup import slices

#: Words of a shingle, retained hashes, least similarity in hundredths.
SHINGLE, RETAINED, SIMILARITY = 5, 256, 75
#: Retained values that enter lists, and how many of them linked sets share, at least.
LISTED, SHARED = 64, 28
#: Standard deviations that an estimate may lie below the similarity.
SLACK = 5
#: Members of a list in a block; pairs of one id, and bytes of their other ends' texts, that are held against it at a time.
BLOCK, PAIRS, PAIR_BYTES = 1024, 256, 8 << 20
#: Bytes of sketches or texts that a task reads.
READ_BYTES = 8 << 20
#: Columns of an incidence table at a time.
COLUMNS = 4096
#: Pairs of a class with other components that come up in each further round.
ROUNDS = (4, None)
#: Links up to which one task finds the components, without any shuffle.
ONE_TASK = 200_000


def sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A-Z is lower-cased. A text of fewer words than a shingle has one, all its words.
    """
    words, counts = split_all([t.lower() if t else t for t in texts])
    hashes = word_hashes(words)
    rolled, out, at = windows(hashes, shingle), [], 0
    for n in counts.tolist():
        if n >= shingle:
            out.append(np.unique(rolled[at : at + n - shingle + 1]))
        else:
            out.append(windows(hashes[at : at + n], n) if n else rolled[:0])
        at += n
    return out


def signatures(docs: DataFrame, shingle: int = SHINGLE, retained: int = RETAINED) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_shingles, set_hash, listed and sketch of every row.

    ``sketch`` has the retained hashes, of which the upper halves do for
    estimates, ``listed`` those that may enter lists, whole.
    """
    names = ["doc_id", "text_hash", "n_bytes", "n_shingles", "set_hash", "listed", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch):
                own = sets(texts, shingle)
                halves = [(s[:retained] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in own]
                made = [[len(t or b"") for t in texts], [len(s) for s in own], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own], [s[: min(LISTED, retained)].view(np.int64) for s in own], halves]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first : first + len(texts)] for c in (0, 2)), *(pa.array(c, t) for c, t in zip(made, types[2:], strict=True))], names=names)

    narrow(docs.sparkSession)
    schema = "doc_id long, text_hash long, n_bytes long, n_shingles long, set_hash binary, listed array<long>, sketch array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(run), schema)


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, holders, id, hub): the lists that classes (id, n, listed) enter; hub is the least holder."""
    values = classes.select("id", "n", F.explode("listed").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("holders"), F.min("id").alias("hub")).where("holders > 1")
    by_class = Window.partitionBy("id")
    size = F.least("n", F.lit(LISTED))
    entered = size - least_shared(F.col("n")) + 1 - (size - F.count("*").over(by_class))
    listed = values.join(common, "value").withColumn("entered", entered).withColumn("place", F.row_number().over(by_class.orderBy("holders", "value")))
    return listed.where("place <= entered").select("value", "holders", "id", "hub")


def least_shared(n: Column) -> Column:
    """Retained values that a set of n shingles shares with any linked one, at least."""
    return F.least(F.ceil(n * SIMILARITY / 100), F.lit(SHARED)).cast("int")


def _sketched(ids: DataFrame, sketches: DataFrame, rows: int) -> DataFrame:
    """Classes (id, text_hash, n, ...) of a counted number with their sketches; few go to the sketches, not the other way round."""
    own = sketches.select(F.col("doc_id").alias("id"), "text_hash", "sketch")
    found = own.join(light(ids.select("id", "text_hash", "n"), rows), ["id", "text_hash"])
    return found if len(ids.columns) == 3 else found.join(ids.drop("text_hash", "n"), "id")


def likely(shared: np.ndarray, union: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether shared values out of a union's sketch of a given size speak for a link.

    The sketch is a draw without replacement from a union that has, at the
    similarity asked for, ``sizes / (1 + similarity)`` values, sizes being those
    of both sets together; a draw of all of it leaves no slack.
    """
    least = SIMILARITY / 100
    left = np.maximum(0.0, 1 - union * (1 + least) / np.maximum(sizes, 1))
    slack = SLACK * np.sqrt(least * (1 - least) / np.maximum(union, 1) * left)
    return shared >= (least - slack) * union - 1e-9


def _tops(sketches: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Up to which hash each sketch has all values of its set."""
    full = np.iinfo(np.uint64).max
    return np.array([full if len(s) >= size else s[-1] for s, size in zip(sketches, n, strict=True)], dtype=np.uint64)


def _unsigned(sketch: np.ndarray) -> np.ndarray:
    return np.asarray(sketch, dtype=np.int32).view(np.uint32).astype(np.uint64)


def _met_at(pairs: DataFrame, facts: DataFrame, fields: list[str], weight: str, size: int) -> DataFrame:
    """For every pair (a, b) the facts of both ends, in order: a's row, with b null, before those of its b.

    The pairs of one a are dealt to blocks by their number and the ``weight``
    (bytes) of a's facts, so an id that meets a third of all others is spread
    over many tasks; a's facts go once to each block. Both tables are read by as
    many tasks as the ``size`` of the facts (bytes) asks for, not one for each of
    their files.
    """
    readers = max(1, -(-size // READ_BYTES))
    pairs, facts = pairs.coalesce(readers), facts.coalesce(readers)
    # linked ends are of like size, so a's weight speaks for b's
    heavy = pairs.groupBy("a").agg(F.count("*").alias("_n")).join(facts.select(F.col("id").alias("a"), F.col(weight).alias("_w")), "a")
    parts = F.ceil(F.greatest(F.col("_n") / PAIRS, F.col("_n") * F.col("_w") / PAIR_BYTES)).cast("int")
    heavy = cut(heavy.select("a", parts.alias("_parts")).where("_parts > 1"), "heavy")
    dealt = pairs.join(light(heavy, heavy.count()), "a", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    own = facts.select("id", *fields)
    right = dealt.join(own.withColumnRenamed("id", "b"), "b").select("a", "block", "b", *fields)
    left = dealt.select("a", "block").distinct().join(own.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), *fields)
    return left.unionByName(right).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())


def estimated(pairs: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose union's sketch speaks for a link."""
    pairs = cut(pairs, "candidates")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    n = ids.count()
    own = classes.select("id", "text_hash", "n").join(light(ids, n), "id")
    own = cut(_sketched(own, sketches, n).withColumn("n_bytes", 4 * F.size("sketch")), "sketches")
    both = _met_at(pairs, own, ["n", "sketch"], "n_bytes", 4 * RETAINED * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_a, a, top_a = 0, np.zeros(0, dtype=np.uint64), 0
        for batch in batches:
            ids, n = batch.column("b"), batch.column("n").to_numpy()
            column = batch.column("sketch")
            flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            keep = np.zeros(len(n), dtype=bool)
            first = ids.is_null().to_numpy(zero_copy_only=False)
            for k, nb in enumerate(n.tolist()):
                b = _unsigned(flat[cuts[k] : cuts[k + 1]])
                top_b = _tops([b], np.array([nb]))[0]
                if first[k]:
                    n_a, a, top_a = nb, b, top_b
                elif 100 * min(n_a, nb) >= SIMILARITY * max(n_a, nb):
                    top = min(top_a, top_b)
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    union = np.searchsorted(a, top, "right") + np.searchsorted(b, top, "right") - shared
                    keep[k] = likely(shared, union, n_a + nb)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n", "sketch").mapInArrow(lean(run), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough; docs: doc_id, text, text_hash."""
    pairs = cut(pairs, "pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "text_hash", "n_bytes"), "id"), "ids")
    n, size = ids.agg(F.count("*"), F.sum("n_bytes")).first()
    if not n:
        return pairs
    own = docs.select(F.col("doc_id").alias("id"), "text", "text_hash").join(light(ids.select("id", "text_hash", "n_bytes"), n), ["id", "text_hash"])
    # rows of one id and text are equal: one is enough
    own = cut(own.select("id", "n_bytes", "text"), "texts")
    if own.count() > n:
        own = own.dropDuplicates(["id"])
    both = _met_at(pairs, own, ["text"], "n_bytes", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            first, texts = batch.column("b").is_null().to_numpy(zero_copy_only=False), batch.column("text").cast(pa.binary())
            keep = np.zeros(len(first), dtype=bool)
            for k in range(len(first)):
                b = sets([texts[k].as_py()], shingle)[0]
                if first[k]:
                    a = b
                else:
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    keep[k] = 100 * shared >= SIMILARITY * (len(a) + len(b) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text").mapInArrow(lean(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all linked ids but the least of each component.

    Large and small stars in turn: all larger neighbours, then all smaller ones,
    are linked to the least, until nothing changes. Links stay as many as ids.
    Few links, as counted, are followed in one task.
    """
    edges, before = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"), None
    if edges.count() <= ONE_TASK:
        return cut(edges.coalesce(1).mapInPandas(lean(_roots), "id long, component long"), "components")
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v"))
        edges = cut(stars.distinct(), "links")


def _roots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, component) of the links (u, v) of one task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for part in parts:
        for u, v in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in [*root]]
    yield pd.DataFrame([r for r in found if r[0] != r[1]], columns=["id", "component"])


def across(lists: DataFrame, classes: DataFrame, sketches: DataFrame, found: DataFrame, tested: DataFrame, take: int | None) -> DataFrame | None:
    """Untested likely pairs (a, b) of members of one list and different components; None if no list has such members.

    A pair comes up from the side of the smaller component, at most ``take``
    for each class, the most alike first. Members that have no such pair in a
    list are left out of it before the sketches are sent.
    """
    placed = lists.select("value", "holders", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mark = F.xxhash64("id")
    per_list = placed.groupBy("value").agg(F.first("holders").alias("holders"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor"))
    # lists with the same members need one look: the first in the order of rarity
    open_ = per_list.where("low <> high").groupBy("members", "sum", "xor").agg(F.min(F.struct("holders", "value")).alias("first"))
    open_ = cut(open_.select("first.value", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "open")
    n = open_.count()
    if not n:
        return None
    sizes = found.groupBy("component").agg((F.count("*") + 1).alias("size"))
    rows = cut(placed.join(light(open_, n), "value").join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1))), "members")
    ids = cut(rows.select("id").distinct(), "ids")
    n = ids.count()
    near = light(ids, n)
    seen = tested.select("a", F.col("b").alias("id")).join(near, "id").groupBy("id").agg(F.collect_set("a").alias("seen"))
    order = lists.join(near, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("holders", "value"))).alias("e")).select("id", F.col("e.value").alias("entered"))
    plain = cut(classes.join(near, "id").select("id", "text_hash", "n").join(order, "id").join(seen, "id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<long>"))), "facts")
    first = _met(rows.join(plain.drop("text_hash"), "id"), ["id", "component", "size", "n", "entered", "seen"])

    def open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, same, left, right in _blocks(batches):
            ids, table = _open(value, left, right, same)
            used = np.unique(np.concatenate([ids[0][table.any(1)], ids[1][table.any(0)]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), value)), pa.array(used)], names=["value", "id"])

    used = cut(first.mapInArrow(lean(open_members), "value long, id long").distinct(), "used")
    facts = cut(_sketched(plain, sketches, n).drop("text_hash"), "sketched")
    second = _met(rows.join(used, ["value", "id"]).join(facts, "id"), ["id", "component", "size", "n", "entered", "seen", "sketch"])

    def likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, same, left, right in _blocks(batches):
            columns = [*zip(*_pairs(value, left, right, same, take), strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, pa.float64()], strict=True)], names=["id", "a", "b", "share"])

    pairs = second.mapInArrow(lean(likely_pairs), "id long, a long, b long, share double")
    if take:
        best = Window.partitionBy("id").orderBy(F.desc("share"), "a", "b")
        pairs = pairs.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= take)
    return pairs.select("a", "b").distinct()


def _met(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value, x, y, first, second): the members of every list in blocks, block x meeting block y once, x <= y."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = cut(rows.groupBy("value", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("rows")), "blocks")
    left = held.select("value", F.col("block").alias("x"), F.col("rows").alias("first"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    return left.join(held.select("value", F.col("block").alias("y"), F.col("rows").alias("second")), ["value", "y"]).select("value", "x", "y", "first", "second")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, dict, dict]]:
    """(value, whether a block meets itself, first, second): the members' fields as columns, arrays as lists of arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = []
            for side in ("first", "second"):
                members = batch.column(side)[k].values
                fields = {}
                for name in (f.name for f in members.type):
                    own = members.field(name)
                    if pa.types.is_list(own.type):
                        flat, cuts = own.values.to_numpy(zero_copy_only=False), own.offsets.to_numpy()
                        fields[name] = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                    else:
                        fields[name] = own.to_numpy(zero_copy_only=False).astype(np.int64)
                sides.append(fields)
            yield batch.column("value")[k].as_py(), batch.column("x")[k].as_py() == batch.column("y")[k].as_py(), *sides


def _both(first: dict, second: dict, name: str, same: bool) -> list | np.ndarray:
    if same:
        return first[name]
    return [*first[name], *second[name]] if isinstance(first[name], list) else np.concatenate([first[name], second[name]])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right``; tables of COLUMNS values at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    both = np.intersect1d(*flat)
    found = []
    for own, all_ in zip((left, right), flat, strict=True):
        row, code = np.repeat(np.arange(len(own)), [len(a) for a in own]), np.searchsorted(both, all_)
        ok = code < len(both)
        ok[ok] = both[code[ok]] == all_[ok]
        order = np.argsort(code[ok], kind="stable")
        found.append((row[ok][order], code[ok][order]))
    for at in range(0, len(both), COLUMNS):
        tables = []
        for own, (row, code) in zip((left, right), found, strict=True):
            x, y = np.searchsorted(code, [at, at + COLUMNS])
            table = np.zeros((len(own), min(COLUMNS, len(both) - at)), dtype=np.float32)
            table[row[x:y], code[x:y] - at] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _open(value: int, first: dict, second: dict, same: bool) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Ids of both blocks, and which pairs are of different components, of sizes that allow a link, and not tested yet.

    A pair counts in one list alone, that of the first value in the order of
    rarity that both have entered; and once, from the smaller component, or
    from the larger id between equals.
    """
    k = len(first["id"])
    left, right = slice(0, k), slice(0, k) if same else slice(k, None)
    before = [e[: int(np.flatnonzero(e == value)[0])] for e in _both(first, second, "entered", same)]
    n, comp, ids = (_both(first, second, c, same) for c in ("n", "component", "id"))
    low, high = np.minimum(n[left, None], n[None, right]), np.maximum(n[left, None], n[None, right])
    table = (_shared(before[left], before[right]) == 0) & (100 * low >= SIMILARITY * high) & (comp[left, None] != comp[None, right])
    at_left, at_right = ({int(i): j for j, i in enumerate(ids[side])} for side in (left, right))
    for i, seen in zip(ids.tolist(), _both(first, second, "seen", same), strict=True):
        # a pair is noted at its larger id
        for s in seen.tolist():
            if i in at_left and s in at_right:
                table[at_left[i], at_right[s]] = False
            if i in at_right and s in at_left:
                table[at_left[s], at_right[i]] = False
    return (ids[left], ids[right]), table


def _pairs(value: int, first: dict, second: dict, same: bool, take: int | None) -> list[tuple[int, int, int, float]]:
    """(member, a, b, share) of the likely open pairs of two blocks of the list of ``value``."""
    (own_left, own_right), table = _open(value, first, second, same)
    if not table.any():
        return []
    k = len(first["id"])
    left, right = slice(0, k), slice(0, k) if same else slice(k, None)
    sketches = [_unsigned(s) for s in _both(first, second, "sketch", same)]
    n, weight = (_both(first, second, c, same) for c in ("n", "size"))
    tops, shared = _tops(sketches, n), _shared(sketches[left], sketches[right])
    size = np.array([len(s) for s in sketches])

    def upto(rows: slice, limits: slice) -> np.ndarray:
        """How many values of each row lie within each limit."""
        return np.stack([np.searchsorted(s, tops[limits], side="right") for s in sketches[rows]])

    top = np.minimum(tops[left, None], tops[None, right])
    in_left = np.where(tops[left, None] <= tops[None, right], size[left, None], upto(left, right))
    in_right = np.where(tops[None, right] <= tops[left, None], size[None, right], upto(right, left).T)
    union = in_left + in_right - shared
    table &= likely(shared, union, n[left, None] + n[None, right])
    share = np.where(table, shared / np.maximum(union, 1), -1.0)
    mine = weight[left, None] < weight[None, right]
    mine |= (weight[left, None] == weight[None, right]) & (own_left[:, None] > own_right[None])
    out = []
    for own, other, part in ((own_left, own_right, np.where(mine, share, -1.0)), (own_right, own_left, np.where(mine, -1.0, share).T)):
        for i in np.flatnonzero((part >= 0).any(1)):
            at = np.flatnonzero(part[i] >= 0)
            if take and len(at) > take:
                at = at[np.lexsort((other[at], -part[i, at]))[:take]]
            out += [(int(own[i]), int(min(own[i], other[j])), int(max(own[i], other[j])), float(part[i, j])) for j in at]
        if same:
            break
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, retained: int = RETAINED) -> DataFrame:
    """Components of near duplicates among all rows of ``docs`` (doc_id, text).

    Returns doc_id, text_hash, n_shingles, component_id (the least doc_id that
    can be reached, its own included) and kept (whether that is its own). Null
    and empty texts have no shingles and are linked with nothing. Rows of one
    doc_id are one document with the links of each. Rows without doc_id are not
    linked: their component is null, and they are kept. An empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(signatures(docs, shingle, retained), "signatures")
    alike = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash")
    classes = alike.agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "n_bytes", "listed")).alias("rep"))
    classes = cut(classes.select(F.col("rep.doc_id").alias("id"), "rep.text_hash", F.col("rep.n_shingles").alias("n"), "rep.n_bytes", "set_hash", "rep.listed"), "classes")
    nodes, sketches = classes.drop("set_hash", "listed"), signed.select("doc_id", "text_hash", "sketch")
    if sketches.groupBy("doc_id", "text_hash").count().where("count > 1").take(1):
        sketches = cut(sketches.dropDuplicates(["doc_id", "text_hash"]), "unrepeated")
    lists = cut(inverted_lists(classes), "lists")
    tested = cut(lists.where("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "hubs")
    links = cut(confirmed(estimated(tested, nodes, sketches), docs, nodes, shingle), "confirmed")
    found = components(links)
    for take in ROUNDS:
        pairs = across(lists, nodes, sketches, found, tested, take)
        if pairs is None:
            break
        pairs = cut(pairs, "across")
        if not pairs.take(1):
            break
        tested = tested.unionByName(pairs)
        more = cut(confirmed(pairs, docs, nodes, shingle), "confirmed")
        if more.take(1):
            links = links.unionByName(more)
            found = components(links)
    linked = classes.select(F.col("set_hash").alias("_set"), "id").join(found, "id", "left").select("_set", F.coalesce("component", "id").alias("component_id"))
    # rows of one doc_id may be in several classes: the least component is theirs
    joined = signed.join(linked, (F.col("set_hash") == F.col("_set")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
