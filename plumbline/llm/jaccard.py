"""Exact n-gram Jaccard join with set-relation skipping, and its connected components.

A document is the set of its distinct word n-grams, as 64-bit hashes. Index lists hold, for each gram, the sets whose prefix has it,
rare grams first, with their sizes and its position. A list is read in blocks of similar sizes; entries whose position is too late to
link within a block skip it. In a short block every pair that sizes and positions allow is compared. In a long one all sets are
compared with one of them, and the answers of the others follow from those differences: what two sets do not share is what only one
of their differences has. Pairs that are in one component already are not looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import LOWER, components, drop_tables, hash_spans, materialize, mix, steps, table, words

#: Grams of a share of the hash range, this many times the share of grams that a linked set can have for itself, are counted before any
#: list is made: they tell which documents have too many grams of their own, and their counts order the lists.
COUNTED = 1.75
#: Lists of up to this many sets are compared pair by pair; in longer ones, answers follow from a representative's.
SHORT = 6


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each row of a flat buffer: (row, hash), ordered by both. A row with fewer words is one gram, without words none."""
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = hash_spans(LOWER[data], start, end)
    del start, end
    per_row = np.bincount(row, minlength=n)
    last = np.cumsum(per_row)[row]  # index after the row's last word
    short = per_row[row] < size
    first = np.concatenate(([True], row[1:] != row[:-1]))
    begin = np.flatnonzero(np.where(short, first, np.arange(len(row)) + size <= last))
    grams = np.full(len(begin), np.uint64(size), np.uint64)
    for k in range(size):
        at = begin + k
        real = at < last[begin]
        grams = mix(grams * np.uint64(0x100000001B3) + np.where(real, hashes[np.minimum(at, len(row) - 1)], np.uint64(0)))
    rows = row[begin]
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])))
    return rows[new], grams[new]


def _signed(h: np.ndarray) -> np.ndarray:
    """Unsigned order kept in signed integers."""
    return (h ^ np.uint64(1 << 63)).view(np.int64)


def _sums(grams: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each row's grams, the same for equal sets."""
    out = []
    for seed in (1, 2):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(seed)), dtype=np.uint64)))
        out.append((s[edge[1:]] - s[edge[:-1]]).view(np.int64))
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2): the size of each document's set and 128 bits that equal sets share."""
    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, "text"):
                rows, grams = gram_sets(data, offsets, size)
                n = np.bincount(rows, minlength=part.num_rows)
                sums = _sums(grams, np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *map(pa.array, sums)], names=["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _limit(percent: int) -> np.uint64:
    """The end of the hash range whose grams are counted."""
    return np.uint64(int(min(0.99, COUNTED * (100 - percent) / 100) * 2**64))


def gram_counts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the grams of the counted hash range, rows (own, key, c): own, how many grams c the document key has that no other has; not own,
    the binary logarithm c of the number of documents that have the gram key. Grams of several documents are combined before the shuffle."""
    limit = _limit(percent)

    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, "text"):
                rows, grams = gram_sets(data, offsets, size)
                at = np.flatnonzero(grams < limit)
                order = at[np.argsort(grams[at], kind="stable")]
                grams, rows = grams[order], rows[order]
                if not len(grams):
                    continue
                new = np.concatenate(([True], grams[1:] != grams[:-1]))
                many = np.diff(np.append(np.flatnonzero(new), len(grams)))
                owner = part.column(0).to_numpy(zero_copy_only=False)[rows[new]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(grams[new])), pa.array(owner), pa.array(many.astype(np.int32))], names=["gram", "owner", "many"])

    found = docs.select("doc_id", "text").mapInArrow(run, "gram long, owner long, many int")
    counted = found.groupBy("gram").agg(F.sum("many").alias("c"), F.min("owner").alias("owner"))
    own = F.col("c") == 1
    keyed = counted.select(own.alias("own"), F.when(own, F.col("owner")).otherwise(F.col("gram")).alias("key"), F.when(own, F.lit(1)).otherwise(F.floor(F.log2("c"))).alias("c"))
    return keyed.groupBy("own", "key").agg(F.sum("c").alias("c"))


def _needed(n: Column, percent: int) -> Column:
    """Grams of a set of n that its prefix has: a linked set shares one of them, in whatever order all sets are."""
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def full_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, grams, near, extra) of docs(doc_id, s1, text) whose set has the sum s1: the whole set, ascending; how many of its
    grams are in the counted hash range; and, where those are fewer than its prefix, the grams after them that the prefix needs."""
    limit = _limit(percent)

    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, "text"):
                rows, grams = gram_sets(data, offsets, size)
                n = np.bincount(rows, minlength=part.num_rows)
                edge = np.concatenate(([0], np.cumsum(n)))
                near = np.bincount(rows[grams < limit], minlength=part.num_rows)
                mine = pa.array(_sums(grams, edge)[0] == part.column(1).to_numpy())
                signed = _signed(grams)
                lacking = np.maximum(n - (n * percent + 99) // 100 + 1 - near, 0)
                extra = [signed[e + k : e + k + m] for e, k, m in zip(edge[:-1], near, lacking, strict=True)]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edge.astype(np.int32), signed), pa.array(near.astype(np.int32)), pa.array(extra, pa.list_(pa.int64()))], names=["doc_id", "grams", "near", "extra"])
                yield out.filter(mine)

    return docs.select("doc_id", "s1", "text").mapInArrow(run, "doc_id long, grams array<long>, near int, extra array<long>")


def _by_count(rows: DataFrame, *key: str) -> DataFrame:
    """rows with c, how many of them have their key, or null for one. Counts combine before they are shuffled, and Spark can split the join."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
    return rows.join(shared, list(key), "left")


def prefix_lists(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Rows (gram, doc_id, n, pos) of the prefixes in an order of all grams: those of the counted range first, by the binary
    logarithm k of the number of sets that have them, from shared(gram, k), rare ones first, then by hash. pos is how many grams of the
    set come before. Grams that one set alone has take their places in its prefix, but make no list."""
    n = F.size("grams").cast("long")
    rows = sets.select("doc_id", n.alias("n"), "near", F.explode(F.slice("grams", F.lit(1), F.col("near"))).alias("gram"))
    each = rows.join(shared, "gram").groupBy("doc_id").agg(F.first("n").alias("n"), F.first("near").alias("near"), F.sort_array(F.collect_list(F.struct("k", "gram"))).alias("rest"))
    own = F.col("near") - F.size("rest")
    room = F.greatest(_needed(F.col("n"), percent) - own, F.lit(0)).cast("int")
    near = each.select("doc_id", "n", own.alias("own"), F.posexplode(F.slice("rest", F.lit(1), room)).alias("i", "g")).select(F.col("g.gram").alias("gram"), "doc_id", "n", (F.col("own") + F.col("i")).alias("pos"))
    far = sets.where(F.size("extra") > 0).select("doc_id", n.alias("n"), "near", F.posexplode("extra").alias("i", "gram")).select("gram", "doc_id", "n", (F.col("near") + F.col("i")).alias("pos"))
    return near.unionByName(far)


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """Grams that linked sets of these sizes share at least."""
    return F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)


def _fits(percent: int) -> Column:
    """Whether two entries of a list, whose gram is the first that their sets share, can be of linked sets."""
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (left >= _overlap(F.col("na"), F.col("nb"), percent))


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lists(gram, doc_id, n, pos, c) of SHORT entries at most that sizes and positions allow."""
    entry = F.struct("doc_id", "n", "pos")
    each = lists.where(F.col("c") <= SHORT).groupBy("gram").agg(F.collect_list(entry).alias("l"))
    pairs = each.select("l", F.explode("l").alias("x")).select("x", F.explode("l").alias("y")).where("x.doc_id > y.doc_id")
    pairs = pairs.select(F.col("x.doc_id").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("pa"), F.col("y.doc_id").alias("b"), F.col("y.n").alias("nb"), F.col("y.pos").alias("pb"))
    return pairs.where(_fits(percent)).select("a", "b").distinct()


def block_stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set of a long list with its block's least set.

    Sizes of class k lie between ratio^k and ratio^(k+1), the ratio a little over that of the sizes that can link. Block k of a list
    holds classes k and k + 1, so two sets that can link meet in one. An entry skips a block if so few grams of its set are left at its
    position that it cannot link with the smallest set that the block may hold.
    """
    ratio = 100 / percent * 1.0001
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio))).cast("int")
    rows = lists.where(F.col("c") > SHORT).withColumn("k", size).select("gram", "doc_id", "n", "pos", F.explode(F.array(F.col("k") - 1, F.col("k"))).alias("block"))
    smallest = F.greatest(F.pow(F.lit(ratio), "block") * (1 - 1e-9), F.col("n") * percent / 100)
    rows = rows.where(F.col("n") - F.col("pos") >= _overlap(F.col("n"), smallest, percent))
    least = rows.groupBy("gram", "block").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("gram", "block", "least")
    return rows.join(least, ["gram", "block"]).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, na, nb, diff) of pairs(a, b): the sizes and the symmetric difference of their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    diff = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))
    return both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), diff.alias("diff"))


def _near(percent: int, diff: Column | None = None) -> Column:
    """Whether a compared pair links, by the size of its difference."""
    return (100 + percent) * (F.size("diff") if diff is None else diff) <= (100 - percent) * (F.col("na") + F.col("nb"))


def link(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n, component) of docs(doc_id, text): the size of its set, and the least doc_id that links reach. Null doc_ids are left out."""
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = materialize(signatures(docs, size), "signatures")
    count = each.count()
    # Rows of one doc_id are one document, with the greatest of their sets.
    one = each.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2")).alias("s"), (F.min("s1") != F.max("s1")).alias("several")).select("doc_id", "s.*", "several")
    groups = one.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # rep is the least doc_id with the same set; a document without words is its own.
    reps = materialize(one.join(groups, ["n", "s1", "s2"], "left").select("doc_id", "n", "s1", "several", F.coalesce("rep", "doc_id").alias("rep")), "representatives", count)
    heads = reps.where("n > 0 AND doc_id = rep")
    # A linked set has at most 100 - percent of its grams outside the other one.
    counts = materialize(gram_counts(docs, size, percent), "gram-counts")
    own, shared = counts.where("own").select(F.col("key").alias("doc_id"), F.col("c").alias("own")), counts.where("NOT own").select(F.col("key").alias("gram"), F.col("c").alias("k"))
    few = 100 * F.coalesce("own", F.lit(0)) <= (100 - percent) * F.col("n")
    hopeful = heads.join(own, "doc_id", "left").where(F.col("several") | few).select("doc_id", "s1")
    sets = materialize(full_sets(docs.join(hopeful, "doc_id"), size, percent).dropDuplicates(["doc_id"]), "sets", count)

    lists = materialize(_by_count(prefix_lists(sets, shared, percent), "gram").where("c IS NOT NULL"), "lists", 4 * count)
    drop_tables(counts)
    direct = materialize(compare(short_pairs(lists, percent), sets).where(_near(percent)).select("a", "b"), "direct", 4 * count)
    known = materialize(compare(block_stars(lists, percent), sets), "stars", 4 * count)
    drop_tables(lists, sets)
    sure = direct.unionByName(known.where(_near(percent)).select("a", "b")).unionByName(_certain(known, percent))
    found = materialize(components(sure, "linked"), "found", count)
    derived = _derived(known, found, percent, count)
    labels = [found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    over = derived.join(labels[0], "a", "left").join(labels[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = materialize(components(over, "over"), "over", count)
    drop_tables(direct, known, derived)
    named = reps.select("doc_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("node"))
    named = named.join(over, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return each.select("doc_id", "n").join(named, "doc_id")


def _gap(percent: int) -> Column:
    """Two members of a family link exactly if their gaps' sum is at most 2 (100 + percent) times the grams common to their differences."""
    return ((100 + percent) * F.size("diff") - (100 - percent) * F.col("na")).alias("gap")


def _certain(known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that follow from differences alone: members of a family whose gap and the family's least gap sum to 0 or less
    link with the member that has the least. Any two members with such a sum are connected by that."""
    own = known.select(F.col("b").alias("family"), "a", _gap(percent))
    heads = known.select(F.col("b").alias("family"), F.col("b").alias("a"), (-(100 - percent) * F.col("nb")).alias("gap")).distinct()
    least = own.unionByName(heads).groupBy("family").agg(F.min_by("a", F.struct("gap", "a")).alias("b"), F.min("gap").alias("least"))
    return own.join(least, "family").where("gap + least <= 0 AND a <> b").select("a", "b").distinct()


def _derived(known: DataFrame, found: DataFrame, percent: int, count: int) -> DataFrame:
    """Links (a, b) between members of a family, the sets compared with one representative, that are in different components yet.

    Sets x and y differ by what is in one of their differences from the representative, but not in the other. So a link that is
    not certain needs common grams in the differences, and the first of them, in an order of the family's grams from rare to
    frequent, stands early in both. Families and lists of one component alone are left out before any pair is made.
    """
    labels = found.select(F.col("node").alias("a"), "component")
    member = known.join(labels, "a", "left").select(F.col("b").alias("family"), F.col("a").alias("x"), F.col("na").alias("n"), "diff", F.coalesce("component", "a").alias("comp"), F.size("diff").alias("d"), _gap(percent))
    mixed = member.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family")
    member = materialize(member.join(mixed, "family"), "members", 4 * count)
    most = F.floor((100 - percent) * (F.col("n") * (100 + percent) / percent) / (100 + percent)).cast("int") + 2
    rows = member.select("family", "x", "n", "d", "gap", "comp", most.alias("most"), F.explode("diff").alias("gram"))
    counted = _by_count(rows, "family", "gram")
    order = F.sort_array(F.collect_list(F.when(F.col("c").isNotNull(), F.struct(F.floor(F.log2("c")).alias("k"), "gram"))))
    each = counted.groupBy("family", "x").agg(*(F.first(c).alias(c) for c in ("n", "d", "gap", "comp", "most")), F.count_if(F.col("c").isNull()).cast("int").alias("own"), order.alias("rest"))
    room = F.greatest(F.col("most") - F.col("own"), F.lit(0))
    heads = each.select("family", "x", "n", "d", "gap", "comp", "own", F.posexplode(F.slice("rest", F.lit(1), room)).alias("i", "g"))
    # A member's needed grams in common with any other of the family: its partner's gap is the family's least, or more.
    least = member.groupBy("family").agg(F.min("gap").alias("least"))
    heads = heads.join(least, "family").select("family", F.col("g.gram").alias("gram"), "x", "n", "d", "gap", "comp", (F.col("own") + F.col("i")).alias("pos"), "least")
    heads = heads.where(F.col("pos") <= F.col("d") - F.ceil((F.col("gap") + F.col("least")) / (2 * (100 + percent)))).drop("least")
    heads = materialize(heads, "heads", 4 * count)
    several = heads.groupBy("family", "gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("family", "gram")
    left = heads.join(several, ["family", "gram"])
    a, b = left.toDF("family", "gram", "a", "na", "da", "ga", "ca", "ia"), left.toDF("family", "gram", "b", "nb", "db", "gb", "cb", "ib")
    need = F.ceil((F.col("ga") + F.col("gb")) / (2 * (100 + percent)))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    early = (F.col("ia") <= F.col("da") - need) & (F.col("ib") <= F.col("db") - need)
    pairs = a.join(b, ["family", "gram"]).where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & fits & early)
    pairs = pairs.groupBy("a", "b").agg(F.min("family").alias("family"))
    left = member.select("family", F.col("x").alias("a"), F.col("n").alias("na"), F.col("diff").alias("da"))
    right = member.select("family", F.col("x").alias("b"), F.col("n").alias("nb"), F.col("diff").alias("db"))
    both = pairs.join(left, ["family", "a"]).join(right, ["family", "b"])
    apart = F.size(F.array_except("da", "db")) + F.size(F.array_except("db", "da"))
    derived = materialize(both.where(_near(percent, apart)).select("a", "b"), "derived", count)
    drop_tables(member, heads)
    return derived


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of docs(doc_id, text): the least doc_id that links reach.

    Two documents link when 100 times their intersection is at least percent times their union; whole texts count. Null texts and
    texts without words have an empty set and link with nothing. A repeated doc_id gives a row for each of its rows, which count
    as one document with the greatest of their sets, by size; rows without doc_id are left out. An empty table gives none; other columns are ignored.
    """
    return link(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, and those without doc_id; of repeated such rows one."""
    kept = jaccard_components(docs, size, percent).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
