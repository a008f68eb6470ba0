"""Similarity join of texts by the Jaccard similarity of their word shingles, by vertical partitioning.

Every link at ``percent`` or more is found, whatever the data; nothing is estimated.

1. One scan takes each text's set of shingle hashes. Equal sets are one from here on.
2. Screen: of two linked sets, the first ``n - ceil(n percent/100) + m`` shingles by hash
   share m at least. Sets of whose first shingles fewer are met twice have no link.
3. The sets that are left put their shared shingles into one global order, rare ones
   first, and of two linked sets the first shingles in that order meet.
   Shingles of a set that no other has come before all others and need not travel.
4. Sets that meet are candidates. Their sizes, places in the order and parity bits
   (lower bounds of the difference) rule most of them out.
5. The global order is cut into fragments. Of each candidate pair the overlap is counted
   in each fragment apart, and the parts are summed.

A first shingle that many copies share would make all their pairs: so it is first
compared with one leader, the set with the fewest rare shingles, linked sets become classes,
and only sets of different classes are compared after that. That loses no component. What is
then left in one shingle's list is compared by a join that Spark may split, and only pairs that
pass the bounds leave it: not at every shingle that both share, but where none of the few
shingles before it is shared too, as is so at the first.

Shingles are 64-bit hashes. Two that collide count as one only if both are in the two
sets compared, some 2**-44 for sets of a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.llm import simhash
from laborlens.llm.common import cut, in_one
from laborlens.llm.graph import EDGES_A_PART, components, labels
from laborlens.llm.windows import _mixed, apart, as_bytes, named

WORDS, PERCENT = 5, 80
#: Parity bits of a set, eight longs.
BITS = 512
#: Rounds in which long lists of candidates are compared with one leader each.
LEADERS = 3
#: Keys before its own that a row of the last join carries.
BEFORE = 8
#: Share of a set that the screen asks to be met twice: one in so many shingles.
SCREEN = 10
#: Names of nodes and pairs, of four longs each at most, that are broadcast at most.
BROADCAST_NODES = 1_000_000
#: Fingerprints; nodes, their first shingles and all their shared ones: up to so many stay in one partition, without a shuffle.
FEW_PRINTS, FEW_NODES, FEW_KEYS, FEW_SHINGLES = 20_000, 50_000, 200_000, 2_000_000
#: Fragments of the global order: ranges of how often a shingle is met, each cut in two by hash.
FRAGMENTS = (2, 3, 5, 17)
_TIMES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, size=64, dtype=np.uint64) | np.uint64(1)
_AT_ONCE = 1 << 18  # words taken at once; a longer text goes alone


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle, none an empty set."""

    def flush() -> Iterator[np.ndarray]:
        tokens = pa.array([w for x in waiting for w in x], pa.binary()).dictionary_encode()
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens.dictionary.to_pylist()), dtype=np.uint64, count=len(tokens.dictionary))
        units = hashed[tokens.indices.to_numpy()] if len(tokens) else np.zeros(0, dtype=np.uint64)
        grams = sum((units[i : len(units) - words + 1 + i] * _TIMES[i] for i in range(1, words)), units[: len(units) - words + 1] * _TIMES[0]) if len(units) >= words else units[:0]
        grams, at = _mixed(grams), 0
        for x in waiting:
            n, at = len(x), at + len(x)
            if n >= words:
                yield np.unique(grams[at - n : at - words + 1])
            else:
                yield _mixed(np.array([np.sum(units[at - n : at] * _TIMES[:n]) + np.uint64(n)])) if n else units[:0]

    waiting, held = [], 0
    for t in texts:
        waiting.append(as_bytes(t).lower().split())
        held += len(waiting[-1])
        if held > _AT_ONCE:
            yield from flush()
            waiting, held = [], 0
    if waiting:
        yield from flush()


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` classes of hashes whether the set holds an odd number of them, as signed longs.

    Elements that only one of two sets holds are all that can tell their bits apart, so
    the bits that differ are never more than those elements.
    """
    odd = np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _least(n, percent: int):
    """The least overlap that a set of n shingles needs with a partner, in numbers or columns."""
    return -((-n * percent) // 100) if isinstance(n, int) else F.ceil(n * percent / F.lit(100)).cast("long")


def _scanned(texts: DataFrame, words: int) -> DataFrame:
    """``(k1, k2, doc_id, n, d1, d2)``: size and 128-bit digest of each row's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(grams), *_digest(grams)) for grams in shingle_sets(b.column(3).to_pylist(), words)]
            columns = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], names=["k1", "k2", "doc_id", "n", "d1", "d2"])

    return cut(texts.select("k1", "k2", "doc_id", "text").mapInArrow(scan, "k1 long, k2 long, doc_id long, n long, d1 long, d2 long"))


def _digest(grams: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _first(n: int, percent: int, screen: int) -> int:
    """How many shingles the screen takes of a set of n."""
    return n - _least(n, percent) + max(1, n // screen)


def _hits(texts: DataFrame, words: int, percent: int, screen: int, buckets: int) -> DataFrame:
    """``(d1, hits)``: how many of the first shingles of the sets with that digest are met twice, or more than that.

    A task emits a set once. First shingles travel packed, in ``buckets`` ranges of their
    hash; one that a task has met twice already travels once, so a common one is
    no load for its bucket. Copies that two tasks met count as met twice, which only lets more sets through.
    """
    pivots = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    names = ["bucket", "grams", "owner", "ids", "hits"]

    def packed(group: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids = np.array([d for d, _ in group], dtype=np.int64)
        grams, owner = np.concatenate([low for _, low in group]), np.repeat(np.arange(len(group)), [len(low) for _, low in group])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        times = np.diff(np.append(at, len(grams)))
        twice = np.repeat(times > 1, times)
        own = np.bincount(owner[twice], minlength=len(group))
        some = np.flatnonzero(own)
        rows = [(int(ids[0]) % buckets, b"", b"", ids[some].tobytes(), own[some].astype(np.int64).tobytes())]
        grams, owner = grams[at], np.where(times > 1, -1, owner[at])
        edges = [0, *np.searchsorted(grams, pivots).tolist(), len(grams)]
        for bucket, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo < hi:
                here, index = np.unique(owner[lo:hi], return_inverse=True)
                with_none = here[0] < 0
                index = index - 1 if with_none else index
                rows.append((bucket, grams[lo:hi].tobytes(), index.astype(np.int32).tobytes(), ids[here[1:] if with_none else here].tobytes(), None))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, group, held = set(), [], 0
        for b in batches:
            for grams in shingle_sets(b.column(0).to_pylist(), words):
                if len(grams) and (digest := _digest(grams)) not in seen:
                    seen.add(digest)
                    group.append((digest[0], grams[: _first(len(grams), percent, screen)]))
                    held += len(group[-1][1])
                    if held > 4 * _AT_ONCE:
                        yield packed(group)
                        group, held = [], 0
        if group:
            yield packed(group)

    def met(table: pa.Table) -> pa.Table:
        found, grams, owners = [], [], []
        for g, o, i, h in zip(*(table[c].to_pylist() for c in names[1:])):
            ids = np.frombuffer(i, dtype=np.int64)
            if h is not None:
                found.append((ids, np.frombuffer(h, dtype=np.int64)))
            else:
                at = np.frombuffer(o, dtype=np.int32)
                grams.append(np.frombuffer(g, dtype=np.uint64))
                owners.append((np.append(ids, 0)[at], at >= 0))
        if grams:
            all_grams = np.concatenate(grams)
            order = np.argsort(all_grams, kind="stable")
            same = all_grams[order][1:] == all_grams[order][:-1]
            hit = (np.append(same, False) | np.append(False, same)) & np.concatenate([ok for _, ok in owners])[order]
            found.append(np.unique(np.concatenate([d for d, _ in owners])[order][hit], return_counts=True))
        columns = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["d1", "hits"])

    sent = texts.select("text").mapInArrow(scan, "bucket int, grams binary, owner binary, ids binary, hits binary")
    return sent.groupBy("bucket").applyInArrow(met, "d1 long, hits long").groupBy("d1").agg(F.sum("hits").alias("hits"))


def _ranked(texts: DataFrame, nodes: DataFrame, words: int, by_simhash: bool = False) -> DataFrame:
    """``(node, n, bits, fp, order, cuts)``: its fingerprint, if asked for, shingles that another node has too, in the global order, and where its fragments end there.

    The order is by class of how often a shingle is met (``FRAGMENTS``), then by hash; each class is cut in two at hash 0.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(1).to_pylist()
            found = list(shingle_sets(of, words))
            prints = np.array([simhash.fingerprint(t) for t in of], dtype=np.uint64).view(np.int64) if by_simhash else np.zeros(len(of), dtype=np.int64)
            columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([parity(x) for x in found], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(prints)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["node", "n", "bits", "grams", "fp"])

    # Few nodes go to where the texts are; else the texts travel once.
    hint = "broadcast" if nodes.count() <= BROADCAST_NODES else "shuffle_hash"

    def texts_of(some: DataFrame) -> DataFrame:
        return texts.select("k1", "k2", "text").join(some.select("k1", "k2", "node").hint(hint), ["k1", "k2"]).select("node", "text")

    chosen, again = texts_of(nodes.where("times = 1")), nodes.where("times > 1")
    if not again.isEmpty():
        chosen = chosen.union(texts_of(again).groupBy("node").agg(F.first("text").alias("text")))
    whole = cut(chosen.mapInArrow(sets, "node long, n long, bits array<long>, grams array<long>, fp long"))
    each = whole.select("node", F.explode("grams").alias("gram"))
    met = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(apart(met, "gram"), F.col("gram") == F.bitwise_not("not_gram"))
    seldom = sum((F.when(F.col("df") >= low, 1).otherwise(0) for low in FRAGMENTS[1:]), F.lit(0)).cast("byte")
    order = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(seldom.alias("c"), "gram"))).alias("x"))

    def below(i: int) -> Column:
        """How many shingles stand before the end of a fragment."""
        return F.size(F.filter("x", lambda y: (y["c"] < i // 2) | ((y["c"] == i // 2) & ((y["gram"] < 0) | F.lit(bool(i % 2))))))

    order = order.select("node", F.transform("x", lambda y: y["gram"]).alias("order"), F.array(*(below(i) for i in range(2 * len(FRAGMENTS)))).alias("cuts"))
    return whole.select("node", "n", "bits", "fp").join(order, "node")


def _room(percent: int) -> Column:
    """Whether sizes and places in the order of ``a`` and ``b`` leave room for a link.

    ``at`` counts the shingles up to the shared one that other sets have too, ``place`` all of them.
    """
    n, m = F.col("a.n"), F.col("b.n")
    most = F.least("a.at", "b.at") + F.least(n - F.col("a.place"), m - F.col("b.place"))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (most * (100 + percent) >= (n + m) * percent)


def _alike(a: str, b: str, n: Column, percent: int) -> Column:
    """Whether parity bits leave room for a link of sets of n shingles together."""
    differ = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    return sum(differ[1:], differ[0]) * (100 + percent) <= n * (100 - percent)


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` that connect all ``nodes (node, fp)`` whose SimHash fingerprints chain by 2 differing bits or fewer."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    few = first.count() <= FEW_PRINTS
    first = first.coalesce(1) if few else first
    least = first.withColumnRenamed("node", "v")
    same = nodes.join(F.broadcast(least) if few else least, "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    links = simhash.near_links(first, few=few).union(same)
    return (links.coalesce(1) if few else links).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of two classes in one list that the bounds allow, at the first key that both hold and at few others."""
    a, b = lists.alias("a"), lists.alias("b")
    bounds = _room(percent) & ~F.arrays_overlap("a.before", "b.before") & _alike("a.bits", "b.bits", F.col("a.n") + F.col("b.n"), percent)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & bounds)


def _verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The links among ``pairs (u, v, nu, nv)``, and how many pairs there were: overlaps counted by fragment and summed by pair; only fragments of their nodes travel."""
    pairs = cut(pairs)
    n = pairs.count()
    one = n <= EDGES_A_PART
    pairs = pairs.coalesce(1) if one else pairs
    here = F.broadcast if n <= BROADCAST_NODES else (lambda x: x)
    wanted = [fragments.join(here(pairs.select(F.col(end).alias("node")).distinct()), "node", "left_semi") for end in ("u", "v")]
    a, b = (w.select(F.col("node").alias(end), F.col("fragment").alias(f"f{end}"), F.col("grams").alias(f"g{end}")) for w, end in zip(wanted, ("u", "v")))
    parts = here(pairs).join(a, "u").withColumnRenamed("fu", "fv").join(b, ["v", "fv"])
    both = parts.groupBy("u", "v", "nu", "nv").agg(F.sum(F.size(F.array_intersect("gu", "gv"))).alias("shared"))
    found = both.where(F.col("shared") * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent).select("u", "v")
    return in_one(found) if one else cut(found), n


def _links(ranked: DataFrame, percent: int, leaders: int, by_simhash: bool = False) -> DataFrame | None:
    """Links ``(u, v)`` between nodes that connect every component; None if no two nodes meet.

    With ``by_simhash`` pairs of near fingerprints are verified before any others and start the classes.
    """
    ranked = cut(ranked)
    unique = F.col("n") - F.size("order")
    first = F.col("n") - _least(F.col("n"), percent) + 1 - unique
    held = ranked.agg(F.count("*"), F.coalesce(F.sum(F.greatest(first, F.lit(0))), F.lit(0)), F.coalesce(F.sum(F.size("order")), F.lit(0))).first()
    small = all(n <= most for n, most in zip(held, (FEW_NODES, FEW_KEYS, FEW_SHINGLES)))
    keep, here = (in_one, F.broadcast) if small else (cut, lambda x: x)
    ranked = in_one(ranked) if small else ranked
    marks = ranked.select("node", "bits")
    # A set's shingles by how rare they are, as a share of its size; the centre of a class has few that are rare.
    rare = sum((unique + F.col("cuts")[2 * i + 1] for i in range(len(FRAGMENTS))), F.lit(0)) * 1000 / F.col("n")
    starts = ranked.where(first > 0).select("node", "n", unique.alias("unique"), rare.cast("int").alias("rare"), F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("i", "x"))
    starts = starts.select(F.col("x").alias("key"), "node", "n", "rare", (F.col("i") + 1).alias("at"), (F.col("unique") + F.col("i") + 1).alias("place"))
    met = starts.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    keys = keep(starts.join(here(apart(met, "key")), F.col("key") == F.bitwise_not("not_key")).drop("not_key"))
    if keys.isEmpty():
        return None

    def fragment(i: int) -> Column:
        start = F.col("cuts")[i - 1] if i else F.lit(0)
        return F.struct(F.lit(i).alias("fragment"), F.slice("order", start + 1, F.col("cuts")[i] - start).alias("grams"))

    mine = ranked.join(here(keys.select("node").distinct()), "node", "left_semi")
    cuts = F.explode(F.array(*(fragment(i) for i in range(2 * len(FRAGMENTS)))))
    fragments = mine.select("node", cuts.alias("x")).select("node", "x.*").where(F.size("grams") > 0)

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (u, v, nu, nv)`` whose parity bits allow a link."""
        a, b = (marks.select(F.col("node").alias(end), F.col("bits").alias(f"b{end}")) for end in ("u", "v"))
        return pairs.join(here(a), "u").join(here(b), "v").where(_alike("bu", "bv", F.col("nu") + F.col("nv"), percent)).select("u", "v", "nu", "nv")

    u_first = F.col("a.node") < F.col("b.node")
    ends = [F.when(u_first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(x) for x, c in (("u", "node"), ("nu", "n"))] + [F.when(u_first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(x) for x, c in (("v", "node"), ("nv", "n"))]
    links, roots, tried = None, None, 0
    if by_simhash:
        a, b = (ranked.select(F.col("node").alias(end), F.col("n").alias(f"n{end}")) for end in ("u", "v"))
        sized = _near_prints(ranked.select("node", "fp")).join(here(a), "u").join(here(b), "v").where((F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent))
        links, tried = _verified(alike(sized.select("u", "v", "nu", "nv")), fragments, percent)
        roots = cut(labels(links, 2 * tried)) if tried else None
    for turn in range(leaders + 1):
        mine = keys.withColumn("root", F.col("node")) if roots is None else keys.join(here(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # After the first turn a leader is one that no class has taken yet, if there is one.
        chosen = F.struct(*([(F.col("node") != F.col("root")).alias("o")] if turn else []), *(["rare"] if turn < 2 else []), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "n", "at", "place")
        open_ = mine.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(chosen).alias("x")).where("r1 <> r2")
        mine = mine.join(here(apart(open_.select("key", "x"), "key")), F.col("key") == F.bitwise_not("not_key")).drop("not_key")
        if 0 < turn < leaders:  # a list of one class stays one
            mine = keep(mine)
            keys = mine.select("key", "node", "n", "rare", "at", "place")
        if turn < leaders:
            pairs = mine.where("root <> x.root").select(F.struct("node", "n", "at", "place").alias("a"), F.col("x").alias("b")).where(_room(percent))
            pairs = alike(pairs.select(*ends).distinct())
        else:  # the exact rest: lists by key, of which only pairs of two classes that pass the bounds come out
            # All sets keep their shingles in one order, so where both hold one of those before, the pair has been met there.
            before = F.collect_list("key").over(Window.partitionBy("node").orderBy("at").rowsBetween(-BEFORE, -1))
            lists = mine.drop("x", "rare").withColumn("before", before).join(here(marks), "node")
            pairs = _met(cut(lists.repartition("node") if small else lists), percent)  # this join is for all tasks
            pairs = pairs.select(*ends).distinct()
        found, n = _verified(pairs, fragments, percent)
        tried += n
        links = found if links is None else links.union(found)
        if turn < leaders and n:  # what two nodes have in common shows in the next turns, all of it at the end
            known = links if roots is None else links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v"))
            roots = cut(labels(known, 2 * tried))
    return links.coalesce(tried // EDGES_A_PART + 1)


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", leaders: int = LEADERS, screen: int = SCREEN, by_simhash: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, set_id, k1, k2)`` for each row of ``docs``.

    ``set_id`` names the component of the row's set by a digest, for rows with and without an id.
    Texts without words, null too, have an empty set and no links: their component is their own id.
    Null ids don't count as a smallest id; a component of nothing else has none. Rows that
    repeat an id with another text are rows of their own. Other columns don't matter; an empty table gives
    no rows. k1 and k2 name the row as ``windows.named`` does. A task holds the shingles of one text, and those in one Arrow batch.
    """
    texts = named(docs, id_col, text_col)
    scanned = _scanned(texts, words)
    rows = scanned.where("n > 0").groupBy("d1", "d2", "k1", "k2").agg(F.count("*").alias("times"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    sets = rows.groupBy("d1", "d2").agg(F.min("least").alias("least"), F.first("n").alias("n"), F.min(F.struct("k1", "k2", "times")).alias("rep"))
    hits = _hits(texts, words, percent, screen, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    need = F.greatest(F.lit(1), F.floor(_least(F.col("n"), percent) / screen))
    open_ = sets.join(hits, "d1").where(F.col("hits") >= need).select("d1", "d2", "least", "rep.*")
    open_ = cut(open_)
    n_open = open_.count()
    few = n_open <= FEW_NODES
    nodes = cut((open_.coalesce(1) if few else open_).withColumn("node", F.monotonically_increasing_id()))
    nodes = nodes.coalesce(1) if few else nodes
    links = None if not n_open else _links(_ranked(texts, nodes, words, by_simhash), percent, leaders, by_simhash)
    sets = sets.select("d1", "d2", "least")
    if links is not None:
        roots = components(links)
        here = F.broadcast if few else (lambda x: x)
        of = nodes.select("d1", "d2", "least", "node").join(here(roots), "node").drop("node")
        top = of.groupBy("root").agg(F.min("least").alias("top"), F.min(F.struct("d1", "d2")).alias("first"))
        of = of.drop("least").join(here(top), "root")
        sets = sets.join(here(of), ["d1", "d2"], "left").select("d1", "d2", F.when(F.isnull("root"), F.col("least")).otherwise(F.col("top")).alias("least"), F.coalesce("first", F.struct("d1", "d2")).alias("set_id"))
    else:
        sets = sets.withColumn("set_id", F.struct("d1", "d2"))
    sets = cut(sets.select(F.bitwise_not("d1").alias("not_d1"), F.col("d2").alias("e2"), "least", "set_id"))
    out = scanned.select("k1", "k2", "doc_id", "n", "d1", "d2").join(sets, (F.col("d1") == F.bitwise_not("not_d1")) & (F.col("d2") == F.col("e2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "set_id", "k1", "k2")
