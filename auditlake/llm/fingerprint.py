"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, with DataFrame functions only.

*Sketch.*  A text is cut into paragraphs (lines, long ones at ends of sentences), and each
different paragraph is hashed.  A digest goes into one cell of each of ``TABLES`` tables of
``SLOTS`` cells: its count grows by one, digest and check hash are added by exclusive or.
The sketch of the whole text is its fingerprint, of one size for any text.

*Comparison.*  Two fingerprints are subtracted cell by cell, so that what both texts hold
goes.  A cell of count 1 or -1 whose check fits its digest gives that digest away; taken out
of its other cells, it frees more.  When all cells are empty, the differing digests of either
side are known, and with them the similarity of the two sets of paragraphs (Jaccard).

*Retrying larger.*  Where peeling gets stuck, the digests are parted by their leading bits, and each
part gets a sketch of its own, so the cells grow with the number of digests; parts that get stuck again are
parted further, until none is left.  Digests that differ end in different cells or parts at last, so this ends.

No window or group holds more than a partition of ids: the next document by
descending id comes from ranges of ids and the first id of each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.scratch import discard, materialize

TABLES, SLOTS = 3, 8
#: Digests of both sides that a part is made for.
LOAD = 6
#: Peeling rounds at most; each frees at least one digest.
_ROUNDS = 24
#: Rows that repeat and are written out by one task.
_COPIES = 65536
# Each cell's place: how far its table's bits stand in a digest, and their value.
_CELLS = "array(" + ", ".join(f"named_struct('s', {3 * t}, 'p', {p}L)" for t in range(TABLES) for p in range(SLOTS)) + ")"
_ZERO = "named_struct('c', 0, 'k', 0L, 'h', 0L)"


def paragraphs(text: str, least: int = 80, most: int = 400) -> str:
    """SQL for a text's paragraphs: lines; from ``least`` characters on a line is cut where a sentence ends, and after ``most`` anywhere."""
    return rf"regexp_extract_all({text}, '[^\\n]{{{least},{most - 1}}}?[.!?](?= |\\n|$)|[^\\n]{{1,{most}}}', 0)"


def digests(text: str) -> str:
    """SQL for the different digests of a text's paragraphs."""
    return f"array_distinct(transform({paragraphs(text)}, p -> xxhash64(p)))"


def _meets(digest: str) -> str:
    """SQL for whether a digest belongs to the cell ``q``."""
    return f"(shiftrightunsigned({digest}, q.s) & {SLOTS - 1}L) = q.p"


def sketch(digest: str) -> str:
    """SQL for the cells of an array of digests."""
    return f"transform({_CELLS}, q -> aggregate({digest}, {_ZERO}, (z, d) -> if({_meets('d')}, named_struct('c', z.c + 1, 'k', z.k ^ d, 'h', z.h ^ xxhash64(d)), z)))"


def peeled(a: str, b: str) -> str:
    """SQL for the peeling of sketch ``a`` less sketch ``b``: ``only_a, only_b`` (digests), ``whole`` (nothing is left)."""
    less = f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    pure = "array_distinct(transform(filter(st.cells, x -> abs(x.c) = 1 AND xxhash64(x.k) = x.h), x -> named_struct('c', x.c, 'k', x.k)))"
    taken = f"zip_with(st.cells, {_CELLS}, (x, q) -> aggregate(pure, x, (z, y) -> if({_meets('y.k')}, named_struct('c', z.c - y.c, 'k', z.k ^ y.k, 'h', z.h ^ xxhash64(y.k)), z)))"
    # A fold over one item names it, so that it is evaluated once.
    step = f"aggregate(array({pure}), st, (old, pure) -> if(size(pure) = 0, named_struct('cells', old.cells, 'got', old.got, 'go', false), named_struct('cells', {taken.replace('st.cells', 'old.cells')}, 'got', concat(old.got, pure), 'go', true)))"
    start = f"named_struct('cells', {less}, 'got', CAST(array() AS array<struct<c:int,k:bigint>>), 'go', true)"
    end = "named_struct('only_a', transform(filter(st.got, g -> g.c = 1), g -> g.k), 'only_b', transform(filter(st.got, g -> g.c = -1), g -> g.k), 'whole', NOT exists(st.cells, x -> x.c != 0 OR x.k != 0))"
    return f"aggregate(sequence(1, {_ROUNDS}), {start}, (st, i) -> if(st.go, {step}, st), st -> {end})"


def _parted(digest: str, used: str, bits: str) -> str:
    """SQL for an array of digests in ``2 ** bits`` parts by the bits after the leading ``used`` ones, in two steps."""
    first, last = f"({bits} DIV 2)", f"({bits} - {bits} DIV 2)"

    def cut(of: str, skip: str, n: str, d: str) -> str:
        return f"transform(sequence(0L, shiftleft(1L, {n}) - 1L), p{d} -> filter({of}, {d} -> (shiftrightunsigned({d}, 64 - {skip} - {n}) & (shiftleft(1L, {n}) - 1L)) = p{d}))"

    # With no bits the shift is a whole turn, and the mask leaves nothing of it.
    return f"flatten(transform({cut(digest, used, first, 'd')}, c -> {cut('c', f'({used} + {first})', last, 'e')}))"


def _try(rows: DataFrame) -> DataFrame:
    """Peels parts of two sides (``rid, kind, used, a, b``).  Those that get stuck are parted; a part that is stuck again keeps its digests.

    Returns ``rid, kind, only_a, only_b, used, a, b``; the last two are null for what is peeled.
    """

    def once(expr: str, name: str) -> Column:
        """A value that is evaluated once however often it is used."""
        return F.explode(F.expr(f"array({expr})")).alias(name)

    keys = ["rid", "kind"]
    rows = rows.select(*keys, "used", "a", "b", once(peeled(sketch("a"), sketch("b")), "r"))
    bits = F.expr(f"CAST(least(greatest(2, ceil(log2((size(a) + size(b)) / {LOAD}.0))), 55 - used) AS INT)")
    rows = rows.select(*keys, "used", "a", "b", "r", bits.alias("bits"))
    none = "CAST(NULL AS array<bigint>)"
    parts = f"if(r.whole, array(named_struct('a', {none}, 'b', {none})), zip_with({_parted('a', 'used', 'bits')}, {_parted('b', 'used', 'bits')}, (x, y) -> named_struct('a', x, 'b', y)))"
    rows = rows.select(*keys, F.expr("used + bits").alias("used"), "r", F.explode(F.expr(parts)).alias("p"))
    rows = rows.select(*keys, "used", "p", once(f"if(p.a IS NULL, r, {peeled(sketch('p.a'), sketch('p.b'))})", "r"))
    stuck = ~F.col("r.whole")
    return rows.select(*keys, F.when(~stuck, F.col("r.only_a")).alias("only_a"), F.when(~stuck, F.col("r.only_b")).alias("only_b"), "used", F.when(stuck, F.col("p.a")).alias("a"), F.when(stuck, F.col("p.b")).alias("b"))


def differing(pairs: DataFrame, counted: bool = False) -> DataFrame:
    """Digests on one side only, for pairs of digest sets (``rid, kind, a, b``): ``rid, kind, only_a, only_b``, a row for each part.

    ``counted``: numbers of digests instead.
    """
    todo = pairs.select("rid", "kind", F.lit(0).alias("used"), "a", "b")
    done, size = [], F.size if counted else F.col
    while True:
        tried = materialize(_try(todo).select("rid", "kind", size("only_a").alias("only_a"), size("only_b").alias("only_b"), "used", "a", "b"), "peeled")
        done.append(tried.filter("a IS NULL").select("rid", "kind", "only_a", "only_b"))
        todo = tried.filter("a IS NOT NULL")
        if todo.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fingerprint_text(digest: str) -> Column:
    """The fingerprint of an array of digests: how many there are, and its cells, in hexadecimal."""
    cells = f"transform({sketch(digest)}, x -> concat(lpad(hex(CAST(x.c AS bigint)), 8, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 16, '0')))"
    return F.expr(f"concat(size({digest}), ':', array_join({cells}, ''))")


_KEY = ["no_id", "place", "h"]


def _next_keys(keys: DataFrame) -> DataFrame:
    """Each key with the one that follows it, and the first after the last: ``no_id, place, h, n, next``.

    Only the first key of each range of keys meets in one task.
    """
    ranges = materialize(keys.repartitionByRange(*_KEY).withColumn("range", F.spark_partition_id()), "order")
    key = F.struct(*_KEY)
    heads = ranges.groupBy("range").agg(F.min(key).alias("head"))
    over = Window.partitionBy(F.lit(0)).orderBy("range")
    after = F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("range", after.alias("after"))
    follows = F.lead(key).over(Window.partitionBy("range").orderBy(*_KEY))
    return ranges.withColumn("next", follows).join(F.broadcast(heads), "range").select(*_KEY, "n", F.coalesce("next", "after").alias("next"))  # a row a range


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each different (id, text) with its edited text's checksum, and the paragraph digests of both and of the next document.

    Returns ``rid, doc_id, copies, next_copies, n_chars, edited_sha256, a, e, x``.
    """
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Ascending places are descending ids; no id comes last.
    rows = rows.select(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("place"), F.xxhash64("text").alias("h"), "text")
    keys = rows.select(*_KEY, F.char_length("text").cast("long").alias("n")).groupBy(*_KEY).agg(F.first("n").alias("n"))
    links = _next_keys(keys)
    each = rows.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    wanted = links.select(*(F.col(f"next.{c}").alias(c) for c in _KEY), F.struct(*_KEY).alias("for"), F.expr("n DIV 2").cast("int").alias("m"), "n")
    # ``next_copies`` is only carried along: with the same columns, both uses of ``each`` read one shuffle of the texts.
    given = each.join(wanted.hint("merge"), _KEY).select(*(F.col(f"for.{c}").alias(c) for c in _KEY), "n", F.col("copies").alias("next_copies"), F.expr("substring(text, 1, m)").alias("head"), F.expr(digests("text")).alias("x"))
    met = each.join(given.hint("merge"), _KEY)
    edited = F.expr("concat(substring(text, 1, CAST(n - n DIV 2 AS INT)), head)")
    met = met.select("no_id", "place", "copies", "next_copies", "n", "x", F.explode(F.array(F.struct(F.expr(digests("text")).alias("a"), edited.alias("edited")))).alias("v"))
    doc_id = F.when(~F.col("no_id"), F.bitwise_not("place"))
    met = met.select(doc_id.alias("doc_id"), "copies", "next_copies", F.col("n").alias("n_chars"), F.sha2("v.edited", 256).alias("edited_sha256"), "v.a", F.expr(digests("v.edited")).alias("e"), "x")
    return materialize(met.withColumn("rid", F.monotonically_increasing_id()), "versions")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has the last half of a text replaced by the beginning of the next document's,
    in descending order of ids, the first document after the last.  Rows that agree in id and text are one
    document in that order and get equal results; different texts of one id follow each other by hash; rows without an id come last.
    A null text is empty; two texts without paragraphs are alike (1).  A text of any length
    counts whole, its sketches grow with its paragraphs; further columns are ignored; an empty table gives no rows.
    """
    made = versions(docs, id_col, text_col)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("e").alias("b")), F.struct(F.lit(1).alias("kind"), F.col("x").alias("b")))).alias("o")
    pairs = made.select("rid", "a", kinds).select("rid", "o.kind", "a", "o.b")
    apart = differing(pairs, counted=True).groupBy("rid").agg(*(F.sum(F.when(F.col("kind") == k, F.col("only_a") + F.col("only_b"))).alias(f"d{k}") for k in (0, 1)))
    rows = made.join(apart.hint("merge"), "rid")

    def near(other: str, d: str) -> Column:
        both = F.size("a") + F.size(other)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(d)).cast("double") / F.greatest(both + F.col(d), F.lit(1)).cast("double"))

    rows = rows.select("doc_id", "n_chars", "edited_sha256", fingerprint_text("a").alias("fingerprint"), fingerprint_text("e").alias("edited_fingerprint"), near("e", "d0").alias("near_edited"), near("x", "d1").alias("near_next"), "copies")
    once = rows.filter("copies = 1").drop("copies")
    again = rows.filter("copies > 1")
    dealt = again.withColumn("lot", F.expr(f"explode(sequence(0L, (copies - 1) DIV {_COPIES}))")).repartition("doc_id", "edited_sha256", "lot")
    again = dealt.withColumn("copy", F.expr(f"explode(sequence(1L, least({_COPIES}L, copies - lot * {_COPIES})))")).drop("copies", "lot", "copy")
    return once.unionByName(again)
