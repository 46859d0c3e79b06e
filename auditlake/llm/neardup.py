"""MinHash near-duplicates by an inverted join of signature coordinates.

1. A text's set of word shingles gives its size, a 128-bit hash of the set and
   a signature of ``COORDS`` minimum hashes.  Texts of equal sets are one class,
   which stands for its documents from here on.
2. Every class is posted under each (coordinate, value) of its prefix.  Classes
   that agree in at least ``MATCHES`` coordinates share one of the first
   ``COORDS - MATCHES + 1`` in any order of all values, so other postings aren't needed.
   Hot values, those of more than a block of classes, come last in that order: classes that
   share a frequent passage and little else meet in no list.  Lists of one
   class, nearly all, are skipped before anything but keys is moved.
3. In each list collisions are counted coordinate by coordinate.  A pair counts
   in the first list it shares and is skipped in the others; a class is skipped
   as soon as the coordinates left can't bring it to ``MATCHES`` with any
   other.  Pairs above the threshold whose sizes allow the similarity are
   candidates; their components are families.
4. The full sets of each family are compared exactly; the components of the
   confirmed links are the answer.

Groups of any size, lists and families alike, are dealt into blocks.  First
every block meets the group's first block, which joins the members of a large
group of near copies at the cost of two rows a member.  Only members outside
the largest component then meet all others.  Only spanning forests leave a
task, never all pairs of a group.

A pair at the threshold of 0.8 fails the match threshold with a probability of
about 1e-7; links are confirmed exactly, so none is reported below it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.components import connected_components
from auditlake.llm.scratch import discard, materialize, scratch_scope
from auditlake.llm.words import mix, run_hashes, word_hashes

COORDS, MATCHES = 48, 22
PREFIX = COORDS - MATCHES + 1
#: Rows of a posting list, and sets of a family, that a block takes; a task holds two blocks.
BLOCK, FAMILY_BLOCK = 2048, 400
#: Coordinates that collisions are counted over first: most members of a list then can't reach the threshold any more.
_FIRST = 36
#: Columns of a block pair's incidence matrix that are held at once.
_COLUMNS = 4096
_SEEDS = mix(np.arange(1, COORDS + 1, dtype=np.uint64))
_FACTORS = np.uint64(0x9E3779B97F4A7C15) + 2 * np.arange(COORDS, dtype=np.uint64)
_STRETCH = 1024
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles; of all words, if fewer; none without words."""
    raw = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not raw:
        return np.empty(0, np.uint64)
    hashes = word_hashes(raw)
    return np.unique(run_hashes(hashes, min(k, len(raw)), 0) ^ np.uint64(0 if len(raw) >= k else len(raw)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over the set, a stretch of it at a time."""
    out = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STRETCH):
        part = (shingles[None, i : i + _STRETCH] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


SETS = "doc_id long, th long, n_shingles long, set_hi long, set_lo long, sig binary"


def _text_hash(text: Column) -> Column:
    """With the id, what tells rows of ``docs`` apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Set size, set hash and signature (``SETS``) of every row; no signature without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                n.append(len(s))
                hi.append(int(digest[0]))
                lo.append(int(digest[1]))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], names=[x.split()[0] for x in SETS.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SETS)


#: A short signature: 32 bits for each coordinate of the prefix, which tell lists apart, and 8 for the others.
_SHORT = 4 * PREFIX + COORDS - PREFIX


def _short(batch: pa.RecordBatch, column: int) -> pa.Array:
    """Short signatures of a batch."""
    sig = mix(np.frombuffer(b"".join(batch.column(column).to_pylist()), "<u8").reshape(batch.num_rows, COORDS))
    head = np.ascontiguousarray(sig[:, :PREFIX].astype("<u4")).view(np.uint8)
    return pa.array([x.tobytes() for x in np.concatenate([head, sig[:, PREFIX:].astype(np.uint8)], axis=1)], pa.binary())


def _long(sig: list[bytes]) -> np.ndarray:
    """Short signatures as numbers, a column a coordinate."""
    raw = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, _SHORT)
    return np.concatenate([np.ascontiguousarray(raw[:, : 4 * PREFIX]).view("<u4"), raw[:, 4 * PREFIX :]], axis=1)


def _keys() -> list[Column]:
    """Names of a class's values: 64-bit hashes of coordinate and value."""
    return [F.xxhash64(F.lit(i), F.substring("sig", 8 * i + 1, 8)) for i in range(COORDS)]


def _posted(classes: DataFrame) -> DataFrame:
    """``id, hot, late, at, key``: a row per class and value of the prefix, whose hot values (``hot``: bits of their coordinates) come last (``late``)."""
    ordered = F.sort_array(F.array(*(F.struct((F.col("hot").bitwiseAND(F.lit(1 << i)) != 0).alias("late"), F.lit(i).alias("at"), key.alias("key")) for i, key in enumerate(_keys()))))
    first = F.when(F.col("hot") == 0, F.array(*(F.struct(F.lit(False).alias("late"), F.lit(i).alias("at"), key.alias("key")) for i, key in enumerate(_keys()[:PREFIX])))).otherwise(F.slice(ordered, 1, PREFIX))
    return classes.select("id", "hot", F.explode(first).alias("p")).select("id", "hot", "p.late", "p.at", "p.key")


def _marked(classes: DataFrame, counted: DataFrame) -> DataFrame:
    """``id, n, sig, hot`` of all classes; ``counted``: how many classes have each value."""
    hot = materialize(counted.filter(F.col("c") > BLOCK).select("key"), "hot")
    rows = classes.select("id", "n", "sig")
    if hot.isEmpty():
        return rows.withColumn("hot", F.lit(0).cast("long"))
    values = classes.select("id", F.posexplode(F.array(*_keys())).alias("at", "key"))
    masks = values.join(hot, "key").groupBy("id").agg(F.expr("bit_or(shiftleft(1L, at))").alias("hot"))
    return materialize(rows.join(masks, "id", "left").fillna(0, ["hot"]), "marked")


def _shared_lists(classes: DataFrame) -> DataFrame:
    """Posting lists of two classes or more: ``key, c`` (length, or more where it is no more than a block)``, id, at`` (coordinate)``, hot, n, sig``."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), _short(batch, 2)], names=["id", "n", "sig"])

    counted = classes.select(F.explode(F.array(*_keys())).alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    counted = materialize(counted, "keys")
    marked = _marked(classes, counted)
    posted = _posted(marked)
    late = posted.filter("late").groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    lists = counted.filter(F.col("c") <= BLOCK).union(late)
    # Signatures join what is left, as most postings are in lists of their own.
    posted = posted.drop("late").join(lists.hint("merge"), "key")
    signed = classes.select("id", "n", "sig").mapInArrow(shorten, "id long, n long, sig binary")
    out = materialize(posted.join(signed.hint("merge"), "id"), "postings")
    discard(counted, marked)
    return out


def _size_ok(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (node, root) of the components of ``n`` nodes under batches of links."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of sorted batches, with the cuts between the groups (both ends included)."""
    parts: list[pa.Table] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            parts.append(pa.Table.from_batches([batch]))
            last = [[parts[i].column(c)[-k].as_py() for c in keys] for i, k in ((0, parts[0].num_rows), (-1, 1))]
            if last[0] == last[1]:  # a group that goes on
                continue
        if not parts:
            continue
        table = pa.concat_tables(parts).combine_chunks()
        new = np.zeros(table.num_rows - 1, bool)
        for c in keys:
            x = table.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), *[table.num_rows] * (batch is None)]  # the last group may go on in the next batch
        yield table.slice(0, cuts[-1]), cuts
        parts = [table.slice(cuts[-1])] if cuts[-1] < table.num_rows else []


def _before(at: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which coordinates come before a posting's own in the order of values, hot ones last; of the first ``PREFIX``, whose values are told apart."""
    place = np.arange(PREFIX)
    warm = (hot[:, None] >> place) & 1 == 0
    late = ((hot >> at) & 1 == 1)[:, None]
    return np.where(late, warm | (place < at[:, None]), warm & (place < at[:, None]))


def list_forest(sig: np.ndarray, n: np.ndarray, before: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the candidates of a list: pairs that agree in ``MATCHES`` coordinates at least, and in none ``before`` the list's.

    ``label``: members of one component aren't compared, so copies are met once.
    Collisions are counted over the first coordinates, then over the others
    where these can still bring a member to the threshold.
    """
    names, root = np.unique(label, return_inverse=True)
    for i in range(len(n) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[_size_ok(n[rest], n[i], percent)]
        same = sig[rest, :_FIRST] == sig[i, :_FIRST]
        count = same.sum(axis=1)
        hope = count + (COORDS - _FIRST) >= MATCHES
        if before[i].any():
            hope &= ~same[:, :PREFIX][:, before[i]].any(axis=1)
        rest, count = rest[hope], count[hope]
        if len(rest):
            rest = rest[count + (sig[rest, _FIRST:] == sig[i, _FIRST:]).sum(axis=1) >= MATCHES]
        if len(rest):
            joined = np.append(np.unique(root[rest]), root[i])
            root[np.isin(root, joined)] = joined.min()
    # One member of each former component stands for it.
    first = np.full(len(names), len(n))
    np.minimum.at(first, root, np.arange(len(n)))
    old = np.unique(label, return_index=True)[1]
    node, top = old, first[root[old]]
    return node[node != top], top[node != top]


def _list_stars(table: pa.Table, cuts: list[int], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning stars of the candidates of each list or pair of its blocks."""
    ids, n, label, at, hot = (table.column(c).to_numpy() for c in ("id", "n", "label", "at", "hot"))
    before = _before(at, hot)
    sig = _long(table.column("sig").to_pylist())
    starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
    two = starts[sizes == 2]  # most lists, all at once
    if len(two):
        same = sig[two] == sig[two + 1]
        earlier = (same[:, :PREFIX] & before[two]).any(axis=1)
        good = (same.sum(axis=1) >= MATCHES) & ~earlier & (label[two] != label[two + 1]) & _size_ok(n[two], n[two + 1], percent)
        yield ids[two[good]], ids[two[good] + 1]
    for a, z in zip(starts[sizes > 2].tolist(), (starts + sizes)[sizes > 2].tolist()):
        node, root = list_forest(sig[a:z], n[a:z], before[a:z], label[a:z], percent)
        yield ids[a:z][node], ids[a:z][root]


def set_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of sets with ``100 * intersection >= percent * union``, by products of incidence matrices."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * common >= percent * (n.sum() - common):
            yield np.array([0]), np.array([1])
        return
    owner = np.repeat(np.arange(len(sets)), n)
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(items)) > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(shared.sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, total, _COLUMNS):
        a, z = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((len(sets), min(_COLUMNS, total - start)), np.float32)
        part[owner[a:z], column[a:z] - start] = 1
        common += part @ part.T  # counts below 2 ** 24 are exact
    linked = 100 * common.astype(np.float64) >= percent * (n[:, None] + n[None, :] - common.astype(np.float64))
    yield np.nonzero(np.triu(linked, 1))


def _set_stars(table: pa.Table, cuts: list[int], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning stars of the links of each family or pair of its blocks."""
    ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
    items = table.column("items")
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z - a < 2 or (label[a:z] == label[a]).all():
            continue
        node, root = _forest(z - a, set_links([np.frombuffer(x.as_py(), "<u8") for x in items.slice(a, z - a)], percent))
        yield ids[a:z][node], ids[a:z][root]


def _spanning(rows: DataFrame, key: str, block: int, stars: Callable, percent: int) -> DataFrame:
    """Components (``node, component``) of the links within groups, from ``key, c`` (group size)``, id`` and what ``stars`` compares.

    The second round is for groups of more than a block: members outside the
    group's largest component so far meet all members, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for table, cuts in _groups(batches, (key, "lo", "hi")) for x in stars(table, cuts, percent)]
        if found:  # the stars of all groups of the task, joined where they share members; numbers of classes ascend in ``names``
            a, b = (np.concatenate(x) for x in zip(*found))
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            node, root = _forest(len(names), iter([(place[: len(a)], place[len(a) :])]))
            yield pa.record_batch([pa.array(names[node]), pa.array(names[root])], names=["a", "b"])

    def links(dealt: DataFrame) -> DataFrame:
        """``mine``: a row's block, ``others``: the blocks that it meets."""
        dealt = dealt.withColumn("other", F.explode("others")).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
        dealt = dealt.drop("c", "mine", "other", "others").repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
        return dealt.mapInArrow(run, "a long, b long")

    def blocks(n: Column) -> Column:
        return F.ceil(n / F.lit(block)).cast("long")

    none = F.array().cast("array<long>")

    def up_to(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(none)

    mine = F.pmod(F.xxhash64("id"), blocks(F.col("c")))
    first = links(rows.withColumn("label", F.col("id")).withColumn("mine", mine).withColumn("others", F.when(F.col("mine") == 0, up_to(blocks(F.col("c")))).otherwise(F.array(F.lit(0).cast("long")))))
    found = connected_components(first, forests=True)
    hot = rows.filter(F.col("c") > block)
    if not rows.agg(F.max("c") > block).first()[0]:
        return found
    known = hot.join(found.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    sizes = known.groupBy(key, "label").agg(F.count("*").alias("m"))
    rest = sizes.groupBy(key).agg(F.max(F.struct("m", "label")).alias("big"), F.sum("m").alias("all")).select(key, F.col("big.label").alias("big"), F.col("big.m").alias("inside"), (F.col("all") - F.col("big.m")).alias("outside"))
    rest = materialize(rest.filter("outside > 0"), "rest")
    out, mine = blocks(F.col("outside")), F.xxhash64("id")
    dealt = known.join(rest.hint("merge"), key)
    is_out = F.col("label") != F.col("big")
    dealt = dealt.withColumn("mine", F.when(is_out, F.pmod(mine, out)).otherwise(out + F.pmod(mine, blocks(F.col("inside")))))
    dealt = dealt.withColumn("others", F.when(is_out, up_to(out + blocks(F.col("inside")))).otherwise(up_to(out))).drop("big", "inside", "outside")
    second = links(dealt)
    return connected_components(found.toDF("a", "b").union(second), forests=True)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, null_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows' sets (``SETS``); classes (``id``: a number, ``doc_id, th`` of the smallest row ...); components of class numbers."""
    # Set hashes are as good as the sets for equality: 128 bits.
    sets = materialize(shingle_sets(docs, id_col, text_col, shingle), "sets")
    worded = sets.filter("n_shingles > 0" if null_ids else "n_shingles > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", F.col("n_shingles").alias("n"), "sig")).alias("r")
    classes = worded.groupBy("set_hi", "set_lo").agg(least).select("set_hi", "set_lo", "r.*")
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    lists = _shared_lists(classes)
    with scratch_scope():
        families = _spanning(lists, "key", BLOCK, _list_stars, percent).withColumnsRenamed({"node": "id", "component": "fam"})
        # Joins of written tables, not windows: adaptive execution can split a family that holds a third of all rows.
        families = materialize(families, "members")
        sizes = families.groupBy("fam").agg(F.count("*").alias("c"))
        families = materialize(families.join(sizes.hint("merge"), "fam").select("id", "fam", "c"), "families", kept=True)
    discard(lists)

    # Full sets of the families' members, hashed from their whole texts again.
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(3)], pa.binary())], names=["fam", "c", "id", "items"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    wanted = families.join(classes.select("id", "doc_id", "th"), "id")
    same = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("no_id"), "th"]
    members = texts.select(*same, "text").join(wanted.select(*same, "fam", "c", "id"), ["k", "no_id", "th"])
    members = members.dropDuplicates(["k", "no_id", "th"]).select("fam", "c", "id", "text")
    members = materialize(members.mapInArrow(items, "fam long, c long, id long, items binary"), "items")
    with scratch_scope():
        found = materialize(_spanning(members, "fam", FAMILY_BLOCK, _set_stars, percent), "found", kept=True)
    discard(members, families)
    return sets, classes, found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Words are lower-cased in A-Z and parted by ASCII white space.  Rows with
    null or wordless text have an empty set and link with nothing.  Rows with a
    null id have a null component and are kept.  Rows that repeat an id share its component.
    Further columns are ignored; an empty table gives no rows.  A text of any
    length is read whole; its set takes 8 bytes a word in memory.
    """
    sets, classes, found = _components(docs, id_col, text_col, shingle, percent, null_ids=False)
    # An id that repeats with other texts stands for all of them.
    own = F.struct("set_hi", "set_lo")
    worded = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_hi", "set_lo")
    several = worded.groupBy("doc_id").agg(F.min(own).alias("other"), F.max(own).alias("last")).filter("other < last").drop("last")
    again = worded.join(several.hint("merge"), "doc_id").filter(F.col("other") != own).select("set_hi", "set_lo", "other").distinct()
    names = classes.select("set_hi", "set_lo", F.col("id").alias("a"))
    others = classes.select(own.alias("other"), F.col("id").alias("b"))
    again = materialize(again.join(names, ["set_hi", "set_lo"]).join(others, "other").select("a", "b"), "again")
    if not again.isEmpty():
        found = connected_components(found.toDF("a", "b").union(again))
    named = found.join(classes.select(F.col("id").alias("node"), "doc_id"), "node")
    named = materialize(named.select("node", "component", "doc_id"), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least.hint("merge"), "component").select(F.col("node").alias("id"), "component_id")
    classes = classes.join(known, "id", "left").select("set_hi", "set_lo", F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = sets.select("doc_id", "n_shingles", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo"], "left")
    linked = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", linked.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, in its columns.

    Rows are documents here, whatever their ids: of a group the row with the
    smallest id stays (rows without an id come last), of equal ids the one whose
    text has the smallest hash, of rows that agree in both the first by their
    other columns.  Rows without words link with nothing and stay.  Texts of any length are
    compared whole; columns may have any names.
    """
    sets, classes, found = _components(docs, id_col, text_col, shingle, percent, null_ids=True)
    named = found.join(classes.select(F.col("id").alias("node"), "no_id", "doc_id", "th"), "node")
    first = named.groupBy("component").agg(F.min(F.struct("no_id", "doc_id", "th", "node")).alias("r")).select("r.node")
    gone = named.join(first, "node", "left_anti").select(F.col("node").alias("id"))
    stay = classes.join(gone, "id", "left_anti").select(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("no_id").alias("_no_id"), "th")
    copies = sets.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_no_id"), "th").agg(F.count("*").alias("_c"), F.min("n_shingles").alias("_n"))
    keep = stay.withColumn("_stay", F.lit(True)).join(copies, ["_k", "_no_id", "th"], "right").filter("_stay OR _n = 0")
    keep = materialize(keep.select("_k", "_no_id", F.col("th").alias("_th"), ((F.col("_c") > 1) & (F.col("_n") > 0)).alias("_many")), "keep")
    own = F.col(id_col).cast("long")
    discard(sets, classes, found)
    # The input goes along as one struct, so that no name of its columns can meet one of these.
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.coalesce(own, F.lit(0)).alias("_k"), own.isNull().alias("_no_id"), _text_hash(F.col(text_col)).alias("_th"))
    rows = rows.join(keep, ["_k", "_no_id", "_th"])
    once = rows.filter("_many").groupBy("_k", "_no_id", "_th").agg(F.min("row").alias("row"))
    return rows.filter("NOT _many").select("row").unionByName(once.select("row")).select("row.*")
