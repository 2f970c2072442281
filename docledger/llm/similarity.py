"""Exact n-gram Jaccard join by vertical partitioning.

Equal shingle sets are one class, known by a 64-bit sum of mixed hashes; classes are joined, not documents. Three steps:

1. A screen over one range of the hash space counts, for each class, shingles that no other text has. A class with more of
   them than the threshold lets any partner miss has no partner. The rest, some near copies and texts made of shared
   passages, go on with their whole sets.
2. Their shingles get a global order, rare first, which is cut into fragments. A set becomes one segment per fragment. Partial
   overlaps of a pair are counted fragment by fragment and summed per pair, which decides the link.
3. Pairs come from shingles that both hold within the prefix that any two linked sets must share. Not all pairs of a shingle's
   group are made: each round compares the group with a few of its members, which are then done with; members that earlier
   links already connect are not compared again. The number of chosen members grows from round to round, until no group joins
   two components. A large group is first cut up by what its members have other than its chosen one, see `_differences`. Hence a
   group of thousands of near copies costs about one comparison each, linked or not, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.graph import components, small
from docledger.llm.rows import numbered
from docledger.llm.shared import NONE, buckets_for, shared_hashes, signature
from docledger.llm.words import LOWER, WHITE, mix, phrases, slices, words
from docledger.session import bound_batches, keep

PERCENT = 85
WORDS = 4
#: The share of the hash space that the screen looks at.
SCREEN = 3
EDGE = np.uint64((1 << 64) // SCREEN)
#: Members above which a group is cut up by differences, and the rounds in which this may happen.
LARGE, CUTS = 16, 1


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of k words; fewer words are one shingle; none, none."""
    w = words(column, WHITE, LOWER)
    h, whole = phrases(w, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            few = w.hash[a : a + 1].copy()
            for i in range(a + 1, b):
                few = few * np.uint64(0xD1342543DE82EF95) + w.hash[i : i + 1]
            out.append(mix(few + np.uint64((b - a) * 0x632BE59BD9B4E019 % (1 << 64))))
        else:
            out.append(NONE)
    return out


def _classes(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """(rid, key, class, n, screened) of every row; screened: shingles in the screen's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(part.column(2), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([signature(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(np.searchsorted(s, EDGE)) for s in sets], pa.int64()),
                    ],
                    ["rid", "key", "class", "n", "screened"],
                )

    return rows.mapInArrow(run, f"rid long, key {kind}, class long, n long, screened long")


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, n, shingles) of the wanted rows (rid, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), k)
                flat = np.concatenate([*sets, NONE]).view(np.int64)
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts).astype(np.int64)), lists], ["class", "n", "shingles"])

    return rows.join(small(wanted), "rid").select("class", "text").mapInArrow(run, "class long, n long, shingles array<long>")


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs: partial overlaps by fragment, summed per pair."""
    a = segments.select(F.col("class").alias("a"), "fragment", F.col("shingles").alias("of_a"))
    b = segments.select(F.col("class").alias("b"), "fragment", F.col("shingles").alias("of_b"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).alias("part"))
    both = F.col("common")
    return (
        partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common")).filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    )


def _possible(hub: str, percent: int) -> Column:
    """Whether a row may link to the hub: shingles that no other class has cannot be in common, nor can those before the first
    that is."""
    most, sizes = F.least(F.col("held"), F.col(f"{hub}.held")), F.col("n") + F.col(f"{hub}.n")
    return (100 * most >= percent * (sizes - most)) & ((100 + percent) * (F.col("pos") + F.col(f"{hub}.pos")) <= (100 - percent) * sizes)


def _differences(met: DataFrame, ordered: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members with the hubs they met, and rows of the members by what sets them apart from those; met: (hub, class,
    n, held, ratio).

    Tokens are shingles that only the member has and shingles that only the hub has. A and B that link have a token in common
    unless both link to the hub: without one they are as far apart as the sum of their distances from it, and if B does not link to the
    hub that is too far. Shingles that no other class has are only counted; those of the hub are one token. Tokens are ordered by
    the members of the hub that have them, rare first, and as many are looked at as may set apart two that link.
    """
    hub = ordered.select(F.col("class").alias("hub"), F.col("n").alias("nh"), F.col("unique").alias("hub_unique"), F.col("order.h").alias("of_hub"))
    both = met.join(hub, "hub").join(ordered.select("class", F.col("order.h").alias("of_a")), "class")
    both = both.withColumn("extra", F.array_except("of_a", "of_hub")).withColumn("missing", F.array_except("of_hub", "of_a"))
    differ = F.col("n") + F.col("nh") - 2 * (F.size("of_a") - F.size("extra"))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))
    last = F.expr("if(hub_unique > 0, array(named_struct('kind', 3, 'token', 0L)), array())")
    tokens = F.concat(F.transform("extra", named(1)), F.transform("missing", named(2)), last).alias("tokens")
    both = keep(both.select(*met.columns, "nh", differ.alias("differ"), tokens), "differences")
    links = both.filter(F.col("differ") * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("nh"))).select(F.col("hub").alias("a"), F.col("class").alias("b"))
    each = both.select(*met.columns, F.explode("tokens").alias("o")).withColumn("h", F.xxhash64("hub", "o.kind", "o.token")).drop("o")
    often = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    kept = each.join(often, "h").groupBy(*met.columns).agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
    kept = kept.join(both.select("hub", "class", F.size("tokens").alias("all")), ["hub", "class"])  # the others come first: no other member has them
    kept = kept.withColumn("unique", F.col("n") - F.col("held") + F.col("all") - F.size("order"))
    prefix = F.greatest(F.lit(0), F.expr(f"int({_apart(percent)} + 1 - unique)"))
    cut = kept.select("class", "n", "held", "ratio", "unique", F.posexplode(F.slice("order", 1, prefix)).alias("at", "o"))
    return links, cut.select("o.h", "class", "n", "held", "ratio", (F.col("unique") + F.col("at")).alias("pos"))


def _apart(percent: int) -> str:
    """Shingles, at most, that only one of two linked classes has, by the size of either."""
    return f"n * {100 - percent} div {percent}"


def _links(ordered: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of classes with more than one member; ordered: (class, n, unique, order) with the shared
    shingles as (level, h), rare first.

    Members are chosen by ratio, n to held shingles, least first: a text with few shingles of its own can link to many, while
    two with many of their own cannot link to each other. Rows that the group's least ratio rules out go, and rows with too many
    shingles before the group's (pos): those before the first common one set two texts apart.
    """
    sum_of_ratios = (100 + percent) / percent + 1e-9  # n / held of two classes that link add up to this at most, with room for rounding
    segments = keep(
        ordered.select("class", F.explode("order").alias("o")).groupBy("class", F.col("o.level").alias("fragment")).agg(F.collect_list("o.h").alias("shingles")), "segments"
    )  # a class's own shingles, at most one text's words
    prefix = F.expr(f"int(n - (n * {percent} + 99) div 100 + 1 - unique)")
    held = (F.col("n") - F.col("unique")).alias("held")
    own = ("h", "class", "n", "held", "ratio", "pos")
    rows = ordered.filter(prefix > 0).select("class", "n", held, (F.col("n") / held).alias("ratio"), "unique", F.posexplode(F.slice("order", 1, prefix)).alias("at", "o"))
    rows = keep(rows.withColumn("pos", F.col("unique") + F.col("at")).select("o.h", *own[1:]), "prefixes")
    hubs = rows.groupBy("h").agg(F.min(F.struct("ratio", "class", "n", "held", "pos")).alias("hub"))
    first = rows.join(keep(hubs, "hubs"), "h").filter((F.col("class") != F.col("hub.class")) & _possible("hub", percent))
    first = first.groupBy("class", "n", F.col("hub.class").alias("b"), F.col("hub.n").alias("nb")).count()
    first = first.groupBy("class", "n").agg(F.max_by(F.struct("b", "nb"), F.struct("count", "b")).alias("best"))
    pairs = first.select(F.col("class").alias("a"), F.col("best.b").alias("b"), F.col("n").alias("na"), F.col("best.nb").alias("nb"))
    links = keep(_overlaps(keep(pairs, "pairs"), segments, percent), "links")
    labels = components(links)
    salts = 1
    for turn in count():
        live = keep(rows.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")), "live")
        about = F.min("label").alias("low"), F.max("label").alias("high"), F.min("ratio").alias("best"), F.min("pos").alias("least"), F.count("*").alias("members")
        mixed = keep(live.groupBy("h").agg(*about).filter("low < high").select("h", "best", "least", "members"), "mixed")
        live = live.join(mixed, "h").filter((F.col("ratio") + F.col("best") <= sum_of_ratios) & (F.col("pos") + F.col("least") <= F.expr(_apart(percent))))
        live = keep(live.withColumn("large", (F.col("members") > LARGE) & F.lit(turn < CUTS)).drop("best", "least", "members"), "live")
        if live.isEmpty():
            return labels
        spot = F.when(F.col("large"), 0).otherwise(F.pmod(F.xxhash64("class", F.lit(salts)), F.lit(salts)))
        hubs = keep(live.groupBy("h", spot.alias("spot")).agg(F.min(F.struct("ratio", "class", "n", "held", "pos", "label")).alias("hub")).select("h", "hub"), "hubs")
        pairs = live.filter(~F.col("large")).join(hubs, "h").filter((F.col("label") != F.col("hub.label")) & _possible("hub", percent))
        less = F.col("class") < F.col("hub.class")
        pairs = pairs.select(
            F.when(less, F.col("class")).otherwise(F.col("hub.class")).alias("a"),
            F.when(less, F.col("hub.class")).otherwise(F.col("class")).alias("b"),
            F.when(less, F.col("n")).otherwise(F.col("hub.n")).alias("na"),
            F.when(less, F.col("hub.n")).otherwise(F.col("n")).alias("nb"),
        ).distinct()
        found = _overlaps(keep(pairs, "pairs"), segments, percent)
        done = hubs.select("h", F.col("hub.class").alias("class"))
        rows = live.filter(~F.col("large")).join(done, ["h", "class"], "left_anti").select(*own)
        if turn < CUTS:
            met = live.filter("large").join(hubs.select("h", F.col("hub.class").alias("hub")), "h").filter(F.col("class") != F.col("hub"))
            met = keep(met.select("hub", "class", "n", "held", "ratio").distinct(), "met")
            linked, cut = _differences(met, ordered, percent)
            found, rows = found.unionByName(linked), rows.unionByName(cut)
        rows = keep(rows, "prefixes")
        found = keep(found, "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        salts *= 4


def _grouped(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(rid, key, n, group) of numbered rows (rid, key, text): rows with one group are linked; without words it is null."""
    bound_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    all_rows = keep(_classes(rows, k, kind), "classes")
    known = all_rows.filter(F.col("n") > 0)
    parts = buckets_for(all_rows.agg(F.sum("screened")).first()[0])

    def screen(column: pa.Array) -> tuple[list[np.ndarray], list[int]]:
        sets = shingle_sets(column, k)
        return [s[: np.searchsorted(s, EDGE)] for s in sets], [signature(s) for s in sets]

    shared = keep(shared_hashes(rows.select("rid", "text"), screen, parts, counted=True), "shared")
    spare = F.expr(f"n - (n * {percent} + 99) div 100")
    alive = known.join(shared, "rid").filter(F.col("screened") - F.col("shared") <= spare)
    alive = alive.unionByName(known.filter(F.col("screened") <= spare).withColumn("shared", F.lit(0).cast("long")))
    wanted = keep(alive.groupBy("class").agg(F.min("rid").alias("rid")), "wanted")
    sets = keep(_sets(rows.select("rid", "text"), wanted, k), "sets")
    each = sets.select("class", "n", F.explode("shingles").alias("h"))
    often = keep(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    level = F.floor(F.log2("df")).cast("int")
    ordered = each.join(often, "h").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct(level.alias("level"), "h"))).alias("order"))
    ordered = keep(ordered.withColumn("unique", F.col("n") - F.size("order")).filter(F.col("unique") <= spare), "ordered")
    labels = keep(_links(ordered, percent).select(F.col("node").alias("class"), "label"), "groups")
    told = known.select("rid", "key", "class", "n").join(labels, "class", "left").select("rid", "key", "n", F.coalesce("label", "class").alias("group"))
    return told.unionByName(all_rows.filter(F.col("n") == 0).select("rid", "key", "n", F.lit(None).cast("long").alias("group")))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the smallest key that links reach.

    Two rows link when their sets of k-word shingles (A-Z in lower case) have at least `percent` hundredths of their union in
    common. Rows without words, null texts among them, link with nothing and are their own component. Repeated rows each give a
    row. A null key never names a component unless no other key is in it. Other columns are not read.
    """
    told = keep(_grouped(numbered(docs, key=F.col(key), text=F.col(text)), k, percent), "grouped")
    least = keep(told.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("key").alias("least")), "least")
    linked = told.filter(F.col("group").isNotNull()).join(least, "group").select("key", "n", F.col("least").alias("component_id"))
    alone = told.filter(F.col("group").isNull()).select("key", "n", F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: the one with the smallest key, of equal keys the first.
    Rows without words all stay."""
    rows = numbered(docs, **{f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    told = keep(_grouped(rows.select("rid", at[key].alias("key"), at[text].alias("text")), k, percent).filter(F.col("group").isNotNull()), "grouped")
    first = keep(told.groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), "key", "rid")).alias("first")).select("group", F.col("first.rid").alias("first")), "first")
    gone = keep(told.join(first, "group").filter(F.col("rid") != F.col("first")).select("rid"), "gone")
    return rows.join(small(gone), "rid", "left_anti").select(*[c.alias(n) for n, c in at.items()])
