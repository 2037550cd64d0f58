"""Near duplicates by bottom-k sketches from one hash function.

1. Each text becomes its set of hashed shingles. Texts with one set form a class.
2. A class keeps the k least hashes of its set as its sketch. Two sets of similarity 0.8 share
   all but a few of them, so they share one of the rarest ``k - T + 1``: only these enter the
   inverted lists, which keeps frequent shingles out of them.
3. Each list is first a star around its most copied class. Pairs whose union sketch estimates
   enough overlap are confirmed on the full sets, and the links give components.
4. Where members of a list still lie in several components, those outside the star's component
   meet the rest, if there is another component among sizes near theirs, in blocks of at most some ``BLOCK`` x ``BLOCK`` rows per task step,
   first by sketches, then by full sets. A block yields rows or links that join components, never its pairs. Pairs inside
   one component need no check, so a large group of copies costs about one pair per member.

A pair at the limit is missed if the sketches share fewer than ``T`` values: for k = 48 a chance
under 1e-8 at similarity 0.8, falling fast above. Sets of up to 38 shingles are exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.llm.components import components
from sigscreen.llm.corpus import LAST, by_key, identified, maybe_among
from sigscreen.llm.texts import SPACED, U, Poly, chunks, find_words, giving_back, word_hashes
from sigscreen.runtime import cut_lineage

K = 48                 # values kept in a sketch
T = 21                 # values that two sketches of similar sets share at least
WHOLE = 38             # up to this size all similar sets fit into their sketches
BLOCK = 128            # rows on either side of a block
BITS = 1 << 25         # of the map of wanted texts, 4 MB


def shingle_sets(part, size: int):
    """The sorted distinct shingle hashes of each text of a chunk, as positive longs."""
    words = find_words(part, SPACED)
    hashes = word_hashes(part, words, fold=True)
    poly = Poly(hashes)
    windows = (poly.windows(size) >> U(1)).view(np.int64)
    first = words.first
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= size:
            yield np.unique(windows[lo:hi - size + 1])
        elif hi > lo:
            yield (poly.runs(np.array([lo]), np.array([hi])) >> U(1)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, k: int = K, whole: bool = False,
             keys: tuple[str, ...] = ("doc_id", "did", "fp")) -> DataFrame:
    """The ``keys``, which are longs, n_shingles, digest and sketch (or the whole set) of each text."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(len(keys))):
                n, digest, kept = [], [], []
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    digest.append(_digest(s))
                    kept.append(s if whole else s[:k])
                ends = np.append(0, np.cumsum([len(s) for s in kept])).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                rows = [batch.column(j).slice(part.lo, part.hi - part.lo) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    [*keys, "n_shingles", "digest", "sketch"])

    return docs.select(*keys, "text").mapInArrow(
        giving_back(run), ", ".join(f"{c} long" for c in keys) + ", n_shingles long, digest binary, sketch array<long>")


def _enough(n: str, sketch: str):
    """The number of sketch values that a similar set shares at least, 4 in 5 or T."""
    exact = F.ceil(F.col(n) * 0.8).cast("int")
    return F.when(F.col(n) <= WHOLE, exact).otherwise(F.least(F.lit(T), exact))


def _rare_entries(classes: DataFrame) -> DataFrame:
    """(value, c, n): the sketch values of each class that its inverted lists need.

    Values of one class only can't make a pair, but count as its rarest.
    """
    entries = classes.select("c", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # dealt by class as plain rows; summed up before the shuffle, each would travel as a list of one
    mine = entries.join(shared, "value").select("c", "df", "value").repartition("c").groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    room = F.col("k") - _enough("n", "sketch") + 1                  # the prefix of the sketch
    left = room - (F.col("k") - F.size("values"))                   # after its lone values
    return mine.join(classes.select("c", "n", F.size("sketch").alias("k")), "c").where(left > 0).select(
        "c", "n", F.explode(F.slice("values", F.lit(1), left)).alias("x")).select(
        F.col("x.value").alias("value"), "c", "n")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """The pairs (a, b) whose union sketch leaves a similarity of 0.8 possible."""
    side = classes.select("c", "n", "sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    return both.where(_close()).select("a", "b")


def _close(k: int = K):
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    small = (F.col("na") <= WHOLE) | (F.col("nb") <= WHOLE)
    least = F.when(small, F.ceil(F.size(union) * 0.5)).otherwise(F.least(F.lit(T), F.size(union)))
    return ((F.least("na", "nb") * 10 >= F.greatest("na", "nb") * 8) & (shared >= least))


def _maybe_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The docs whose (did, fp) may be among the wanted ones: all that are, and few others.

    A wanted key sets one bit of a map of ``BITS`` bits, which every executor gets; more keys let more others through, the map
    stays as it is. So texts that nobody wants are not shuffled.
    """
    return maybe_among(docs, wanted, ["did", "fp"], BITS)[0]


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(c, sketch) with the full sets of the classes that ``wanted`` lists, read from their texts.

    A text meets its class, and equal rows each other, before it becomes a set, so no set is shuffled here.
    """
    wanted = cut_lineage(classes.join(wanted, "c").select("c", "did", "fp"))
    texts = _maybe_wanted(docs, wanted.drop("c")).join(wanted.hint("merge"), ["did", "fp"])     # one plan, however few are wanted
    return cut_lineage(sketches(texts.dropDuplicates(["did", "fp"]), size, whole=True, keys=("c",)).select("c", "sketch"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    sets = _sets(ends, classes, docs, size)
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * percent).select("a", "b")


# ---- blocks: members of a hub's lists against those outside its component ------------

def _comparable(placed: DataFrame, percent: int) -> DataFrame:
    """The rows (hub, c, n, comp, out) that may have a partner: of another component, of a size within ``percent``, one of the two out.

    Sizes fall into bands as wide as two similar sets can be apart, so partners lie in one band or in neighboring ones.
    """
    width = 1.001 * math.log(100 / percent) if percent < 100 else 1e-6
    banded = placed.withColumn("band", F.floor(F.ln("n") / F.lit(width)))
    here = banded.groupBy("hub", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("out").alias("out"))
    about = Window.partitionBy("hub").orderBy("band").rangeBetween(-1, 1)         # a hub has a row per band, some fifty at most
    open_bands = here.select("hub", "band", F.min("lo").over(about).alias("lo"), F.max("hi").over(about).alias("hi"),
                             F.max("out").over(about).alias("any")).where(F.col("any") & (F.col("lo") != F.col("hi")))
    return banded.join(open_bands.select("hub", "band"), ["hub", "band"], "left_semi").drop("band")


def _blocks(rows: DataFrame, values: DataFrame, step, schema: str) -> DataFrame:
    """Run ``step`` on every block of rows (hub, c, n, comp, out, of): the out ones against all. ``values`` has the of of each c.

    The rows of a hub are dealt into blocks by their class, so no task step holds more than one block. Where
    one block holds them all, each is sent once.
    """
    sizes = rows.groupBy("hub").agg(F.ceil(F.count_if("out") / BLOCK).alias("oi"),
                                    F.ceil(F.count(F.lit(1)) / BLOCK).alias("mj")).where("oi > 0")
    dealt = rows.join(cut_lineage(sizes), "hub").join(values, "c").withColumn("x", F.xxhash64("c"))     # the long column comes last
    row = ["hub", "c", "n", "comp", "out", "of"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = dealt.select(*row, F.lit(False).alias("asks"), upto("oi").alias("i"), F.pmod("x", "mj").alias("j"), (F.col("mj") == 1).alias("alone"))
    asking = dealt.where("out and mj > 1").select(*row, F.lit(True).alias("asks"), F.pmod("x", "oi").alias("i"), upto("mj").alias("j"),
                                                  F.lit(False).alias("alone"))
    key = ["hub", "i", "j"]

    def run(batches):
        for block in by_key(batches, key):
            asks = block.column("asks").to_numpy(zero_copy_only=False)
            if block.column("alone")[0].as_py():
                left = np.flatnonzero(block.column("out").to_numpy(zero_copy_only=False))
                block = pa.concat_tables([block, block.take(pa.array(left))])
                asks = np.arange(len(block)) >= len(asks)
            if asks.any() and not asks.all():
                yield from step(block, np.flatnonzero(asks), np.flatnonzero(~asks))

    return members.union(asking).repartition(*key).sortWithinPartitions(*key).mapInArrow(giving_back(run), schema)


def _overlaps(block, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of the arrays of the left rows with those of the right rows."""
    col = block.column("of").combine_chunks()
    flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy()
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(col)), np.diff(ends))
    side = np.zeros(len(col), bool)
    side[right] = True
    of_right = side[row]
    common = np.intersect1d(flat[~of_right], flat[of_right])
    if not len(common):
        return np.zeros((len(left), len(right)), np.float32)
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    hit = common[at] == flat
    place = np.zeros(len(col), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    order = np.argsort(at[hit], kind="stable")
    at, row, of_right = at[hit][order], row[hit][order], of_right[hit][order]
    cuts = np.searchsorted(at, np.arange(0, len(common) + step, step))
    for lo, hi, base in zip(cuts[:-1], cuts[1:], range(0, len(common), step)):
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        v, r, s = at[lo:hi] - base, place[row[lo:hi]], of_right[lo:hi]
        a[r[~s], v[~s]] = 1
        b[r[s], v[s]] = 1
        out += a @ b.T
    return out


def _sides(block, left, right):
    """Sizes, and the pairs of two components whose sizes allow a similarity of 0.8; each pair once."""
    n = block.column("n").to_numpy().astype(np.float64)
    comp, c = block.column("comp").to_numpy(), block.column("c").to_numpy()
    out = block.column("out").to_numpy(zero_copy_only=False)
    na, nb = n[left][:, None], n[right][None, :]
    ok = (comp[left][:, None] != comp[right][None, :])
    ok &= ~out[right][None, :] | (c[left][:, None] < c[right][None, :])
    return c, comp, na, nb, ok


def _sketch_flags(block, left, right):
    """The rows with a partner that their sketches leave possible."""
    c, _, na, nb, ok = _sides(block, left, right)
    ok &= np.minimum(na, nb) * 10 >= np.maximum(na, nb) * 8
    if not ok.any():
        return
    least = np.minimum(T, np.ceil(np.minimum(na, nb) * 0.5))
    ok &= _overlaps(block, left, right) >= least
    hit = np.unique(np.concatenate([c[left[ok.any(axis=1)]], c[right[ok.any(axis=0)]]]))
    if len(hit):
        hub = np.full(len(hit), block.column("hub")[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(hit)], ["hub", "c"])


def _set_links(percent: int):
    def links(block, left, right):
        """For each row the links to one member of every other component."""
        c, comp, na, nb, ok = _sides(block, left, right)
        if not ok.any():
            return
        shared = _overlaps(block, left, right)
        a, b = np.nonzero(ok & (shared * 100 >= (na + nb - shared) * percent))
        if len(a):
            _, first = np.unique(np.stack([a, comp[right[b]]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[left[a[first]]]), pa.array(c[right[b[first]]])], ["a", "b"])
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of (doc_id, text).

    Words are runs of other than white space with A-Z in lower case; a set holds the distinct
    ``size``-word shingles, or the whole sequence where it is shorter. Texts with 100 x
    intersection >= ``percent`` x union are linked; component_id is the least doc_id reached over
    links. Texts without words have an empty set, stand alone, and keep their own id. Rows
    with a null doc_id take part; they get the least id of their component, or null where it has
    none; kept says that the row's id is the component's, and of a component without ids one text is kept. A repeated row gets the same result as the first. Other columns are left out. With ``keys`` did and fp, which
    identify the row as ``identified`` does, come along.
    """
    if not 80 <= percent <= 100:
        raise ValueError("sketches of this length find similarities from 80 percent on")
    docs = identified(docs)
    base = cut_lineage(sketches(docs, size))
    full = base.where("n_shingles > 0")
    classes = cut_lineage(full.groupBy("digest").agg(
        F.min(F.struct("did", "fp")).alias("rep"), F.first("n_shingles").alias("n"),
        F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
        .select("digest", "rep.did", "rep.fp", "n", "copies", "sketch")
        .withColumn("c", F.monotonically_increasing_id()))
    entries = cut_lineage(_rare_entries(classes).join(classes.select("c", "copies"), "c"))

    # stars: every member of a list meets the list's most copied class
    hubs = entries.groupBy("value").agg(
        F.max(F.struct(F.col("copies"), -F.col("c"), F.col("n"))).alias("h"), F.count(F.lit(1)).alias("members")
    ).where("members > 1").select("value", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    listed = cut_lineage(entries.join(hubs, "value"))
    alike = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    stars = listed.where(alike & (F.col("c") != F.col("hub"))).select(
        F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    stars = cut_lineage(_estimated(stars, classes))
    links = cut_lineage(_confirmed(stars, classes, docs, size, percent))

    # the rest of each list: members outside the hub's component against members of other ones
    found = cut_lineage(components(links))
    placed = listed.join(found.toDF("c", "comp"), "c", "left").join(found.toDF("hub", "hub_comp"), "hub", "left")
    placed = placed.select("hub", "c", "n", F.coalesce("comp", "c").alias("comp"),
                           (F.coalesce("comp", "c") != F.coalesce("hub_comp", "hub")).alias("out"))
    placed = cut_lineage(placed.where(F.col("out") | (F.col("c") != F.col("hub"))).distinct())
    placed = cut_lineage(_comparable(placed, percent))
    # half of each value is enough to count what two sketches share
    halves = classes.select("c", F.transform("sketch", lambda v: v.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("of"))
    near = cut_lineage(_blocks(placed, halves, _sketch_flags, "hub long, c long").distinct())
    sets = _sets(near.select("c").distinct(), classes, docs, size)
    more = _blocks(placed.join(near, ["hub", "c"]), sets.toDF("c", "of"), _set_links(percent), "a long, b long")
    found = components(found.toDF("a", "b").union(more))      # components so far are stars

    # back to the rows: the least id of each component
    labelled = classes.join(found.toDF("c", "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = labelled.groupBy("comp").agg(F.min(F.struct("did", "fp")).alias("least"))
    ids = cut_lineage(labelled.join(least, "comp").select("digest", "least"))
    out = base.drop("sketch").join(ids, "digest", "left")
    own = F.coalesce("least", F.struct("did", "fp"))
    first = (own["did"] == F.col("did")) & ((own["did"] != LAST) | (own["fp"] == F.col("fp")))
    return out.select("doc_id", *(["did", "fp"] if keys else []), "n_shingles",
                      F.when(own["did"] != LAST, own["did"]).alias("component_id"), first.alias("kept"))
