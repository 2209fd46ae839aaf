"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (copies share a row), columns are 64-bit hashes of word n-grams.  The
product with its own transpose counts the overlap of each pair of rows; pairs under the size-derived bounds go.

* A row of n n-grams must share one of its first n - ceil(0.8 n) + 1 columns, in any one order of the columns, with
  every row it links to.  So candidates need only these columns.  The order puts frequent (hot) columns last; they are
  estimated on a sample of the sets and named by a bitmap of bounded size - the order decides the work, never the
  result.
* Column blocks are hash partitions of the columns, sorted; a stream over a block keeps the entries of columns with
  two rows or more.  Hot columns are salted over tasks.
* The product is accumulated first against two rows of each column: the one with the largest degree, and the one
  with the least key.  Bounds from the sizes discard pairs (n_small >= 0.8 n_large, and an overlap on the first
  columns that leaves room for 0.8 in all); the exact overlap of what survives is counted from the complete rows,
  partner by partner, in streams that hold two rows at a time.
* Rows linked so far form components.  The rest of the product - pairs of a column whose rows are in different
  components - is then accumulated and checked in the same way, so no link that would join two components is lost,
  while a group of thousands of near copies never becomes all its pairs.
* The rest is blocked by size as well: a column at place p of a row of n can be the first that it shares with a row of
  m only where p <= n - 80 (n + m) / 180, that is up to a largest m.  Each row meets only the bands of sizes from its
  own up to that bound, and where the bound is under its own size it meets none.  So rows that share a long template,
  but not enough of it to link, never meet, however many they are.

Defined cases: texts without words (null, empty, blanks) have no n-grams, link with nothing and are their own
component; texts with fewer words than n have one n-gram, the whole sequence; null ids take part, but the id of a
component is the least that is not null (null if there is none); repeated rows are copies; an empty table gives an
empty result; extra columns are ignored.  Sets are told apart by 64-bit hashes of their sorted n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_shared, map_arrow, slices, write_shared
from .components import components

#: Bits of the bitmap of hot columns for each of them, and bits at most (16 MB).
HOT_BITS, MOST_HOT_BITS = 64, 1 << 27
#: Words of 64 bits of the bitmap that keeps unwanted texts out of a shuffle (2 MB).
FILTER_WORDS = 1 << 18
SAMPLE, HOT_IN_SAMPLE, SALTS = 16, 4, 64
#: Sizes of rows in one band differ by this factor at most.
BAND = 1.06
#: Rows of a document or a pair in one file of a small table.
FILE_ROWS = 20_000
SLICE = 2 << 20
_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The sorted distinct n-grams (uint64) of a text's words."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxh64_digest, words)), "<u8")
    width = min(n, len(h))
    g = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        g *= _K
        g += h[i : len(h) - width + 1 + i]
    g += np.uint64(width)
    g = np.sort(_mixed(g))
    keep = np.ones(len(g), bool)
    np.not_equal(g[1:], g[:-1], out=keep[1:])
    return g[keep]


def set_key(grams: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _sampled_sets(n: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = {}
                for t in batch.column("text").cast(pa.binary()).to_pylist():
                    if len(g := shingles(t or b"", n)):
                        found[set_key(g)] = g.view(np.int64)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "grams"])

    return run


class HotColumns:
    """A bitmap that holds all hot columns, and by chance a few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def among(self, grams: np.ndarray) -> np.ndarray:
        """Which of the columns (uint64) are hot."""
        if not len(self.bits):
            return np.zeros(len(grams), bool)
        word = self.bits[(grams >> np.uint64(6)) & np.uint64(len(self.bits) - 1)]
        return (word >> (grams & np.uint64(63)) & np.uint64(1)).astype(bool)

    @classmethod
    def of(cls, source: DataFrame, n: int) -> HotColumns:
        """Columns of ``HOT_IN_SAMPLE`` sampled sets or more, or of so many more that they fit the bitmap."""
        sample = source.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
        sets = map_arrow(sample, _sampled_sets(n), "node long, grams array<long>").dropDuplicates(["node"])
        counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= HOT_IN_SAMPLE)
        counts = write_shared(counts, "hot-columns")
        most, total, least = MOST_HOT_BITS // HOT_BITS, 0, HOT_IN_SAMPLE
        for r in counts.groupBy("count").agg(F.count("*").alias("k")).orderBy(F.desc("count")).collect():  # as many rows as different counts
            if total + r["k"] > most:
                least = r["count"] + 1
                break
            total += r["k"]
        if not total:
            return cls(np.empty(0, np.uint64))
        words = 1 << max(0, math.ceil(math.log2(total * HOT_BITS / 64)))
        word, bit = f"shiftrightunsigned(gram, 6) & {words - 1}", "shiftleft(1L, CAST(gram & 63 AS INT))"
        rows = counts.where(F.col("count") >= least).selectExpr(f"{word} AS w", f"{bit} AS b").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
        bits = np.zeros(words, np.int64)
        bits[[r["w"] for r in rows]] = [r["b"] for r in rows]
        drop_shared(counts)
        return cls(bits.view(np.uint64))


def _rows(n: int, percent: int, hot: HotColumns):
    """Per document its set's key and size, and the first columns of the row: ``cold`` of them not hot.

    Copies inside a batch have the columns once (null elsewhere).
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                seen, keys, sizes, colds, parts, lengths = set(), [], [], [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    g = shingles(text or b"", n)
                    key = set_key(g) if len(g) else None
                    keys.append(key)
                    sizes.append(len(g))
                    if key is None or key in seen:
                        colds.append(0)
                        lengths.append(-1)
                        continue
                    seen.add(key)
                    first = len(g) - -(-percent * len(g) // 100) + 1
                    late = hot.among(g)
                    cold = g[~late][:first]
                    parts.append(cold)
                    if len(cold) < first:
                        parts.append(g[late][: first - len(cold)])
                    colds.append(len(cold))
                    lengths.append(first)
                lengths = np.array(lengths)
                ends = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
                flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
                columns = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(lengths < 0, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(colds, pa.int32()), columns], names=["doc_id", "row_key", "node", "n", "cold", "columns"])

    return run


def _shared(hot: HotColumns):
    """From a sorted block: the entries of columns with several rows (of hot columns all, as other salts hold more)."""

    def run(batches):
        held = None
        names = ["gram", "node", "n", "top"]
        last_kept = None  # the last entry given out or passed over for good: (gram, node)

        def keep(gram, node, n, top, final):
            nonlocal last_kept
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
            before = np.zeros(len(gram), bool)
            before[1:] = gram[1:] == gram[:-1]
            if last_kept is not None and len(gram):
                before[0] = gram[0] == last_kept[0]
                fresh[0] = not (before[0] and node[0] == last_kept[1])
            gram, node, n, top, before = gram[fresh], node[fresh], n[fresh], top[fresh], before[fresh]
            after = np.zeros(len(gram), bool)
            after[:-1] = gram[1:] == gram[:-1]
            take = before | after | hot.among(gram.view(np.uint64))
            rest = None
            if not final and len(gram):  # the last entry waits for what follows
                rest = gram[-1:], node[-1:], n[-1:], top[-1:]
                take = take[:-1]
                gram, node, n, top = gram[:-1], node[:-1], n[:-1], top[:-1]
            if len(gram):
                last_kept = gram[-1], node[-1]
            return pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (gram, node, n, top)], names=names), rest

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            out, held = keep(*cols, final=False)
            if out.num_rows:
                yield out
        if held is not None:
            out, _ = keep(*held, final=True)
            if out.num_rows:
                yield out

    return run


def _maybe(bits: np.ndarray):
    """Texts whose row may be wanted: one bit per hashed id and row key, so a few unwanted ones pass.

    Rows that are repeated in a batch pass once.
    """

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            word = bits[(h >> np.uint64(6)) % np.uint64(len(bits))]
            take = (word >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True
            yield batch.filter(pa.array(take & first)).select(["doc_id", "row_key", "text"])

    return run


def texts_of(pairs: DataFrame, reps: DataFrame, source: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """(node, text) of all rows in pairs, each once; and the written table that they are read by.

    A row is known by its id and ``row_key``, so that null or repeated ids do not meet all rows of the id.  The wanted
    rows go to the scan as a bitmap of ``FILTER_WORDS`` words at most, which keeps most other texts out of
    the shuffle; the join after it is exact whatever the bitmap lets through.
    """
    nodes = pairs.select("node").unionByName(pairs.select(F.col("partner").alias("node"))).distinct()
    wanted = write_shared(nodes.join(reps, "node"), "wanted", files)
    word, bit = f"pmod(shiftrightunsigned(xxhash64(rep, rep_key), 6), {FILTER_WORDS})", "shiftleft(1L, CAST(xxhash64(rep, rep_key) & 63 AS INT))"
    words = wanted.selectExpr(f"{word} AS w", f"{bit} AS b").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[[r["w"] for r in words]] = [r["b"] for r in words]
    some = map_arrow(source.select("doc_id", "row_key", "text", F.xxhash64("doc_id", "row_key").alias("h")), _maybe(bits.view(np.uint64)), "doc_id long, row_key long, text string")
    found = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("row_key") == F.col("rep_key")))
    return found.select("node", "text").dropDuplicates(["node"]), wanted


def _overlaps(n: int, percent: int):
    """A sorted stream: of each partner first its own text, then those to compare with it."""

    def run(batches):
        partner, row = None, None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                a, b = [], []
                for p, own, node, text in zip(*(batch.column(c).to_pylist() for c in ("partner", "own", "node")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if own:
                        if p != partner:
                            partner, row = p, shingles(text, n)
                        continue
                    if p != partner:
                        raise ValueError("the partner's text is missing")
                    g = shingles(text, n)
                    both = len(np.intersect1d(g, row, assume_unique=True))
                    if 100 * both >= percent * (len(g) + len(row) - both):
                        a.append(node)
                        b.append(p)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, group: int = 512) -> DataFrame:
    """pairs (node, partner) -> edges (u, v) whose sets reach the threshold.

    A partner of many rows is dealt to several tasks, ``group`` rows each; its text goes to each of them.
    """
    tasks = pairs.groupBy("partner").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    wanted = pairs.join(tasks, "partner").select("node", "partner", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("own"))
    own = tasks.select(F.col("partner").alias("node"), "partner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"))
    rows = wanted.unionByName(own).join(texts, "node")
    n_parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(n_parts, "partner", "part").sortWithinPartitions("partner", "part", F.desc("own"))
    return map_arrow(dealt.select("partner", "own", "node", "text"), _overlaps(n, percent), "u long, v long")


def _fits(percent: int):
    """The smaller set is large enough for the larger."""
    return F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent


def _reaches(percent: int):
    """``overlap``, counted over the first columns of both rows, leaves room for a link.

    Up to the end of the first columns of one of the rows the count is complete, and what follows there is at most
    ceil(0.8 n) - 1 columns; a link needs 0.8 / 1.8 of both sizes.
    """
    least = F.ceil((F.col("n") + F.col("pn")) * percent / F.lit(100 + percent))
    return F.col("overlap") + F.ceil(F.greatest("n", "pn") * percent / F.lit(100)) - 1 >= least


def _first_shared(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, partner, n, pn) of rows in different components, n <= pn, for which a column can be the first shared.

    labelled: gram, node, n, top (the largest partner for which the column can be the first shared), component.  A
    row meets the rows of at least its size, band by band; rows of the column's most common component meet only the
    others.
    """
    heights = labelled.groupBy("gram", "component").agg(F.count("*").alias("height"))
    mixed = heights.groupBy("gram").agg(F.max(F.struct("height", "component")).alias("most"), F.count("*").alias("k")).where("k > 1").select("gram", F.col("most.component").alias("most"))
    left = labelled.join(mixed, "gram").withColumn("common", F.col("component") == F.col("most"))
    band = lambda size: F.floor(F.log(size) / math.log(BAND))
    far = F.least("top", F.floor(F.col("n") * 100 / percent))
    small = left.where(F.col("top") >= F.col("n")).select("gram", F.explode(F.sequence(band(F.col("n")), band(far))).alias("band"), "common", "node", "n", "top", "component")
    # each row is met by the others, and those of few in common by the rows of the most common component too
    meets = F.explode(F.when(F.col("common"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    large = left.select("gram", band(F.col("n")).alias("band"), meets.alias("common"), F.col("node").alias("partner"), F.col("n").alias("pn"), F.col("top").alias("ptop"), F.col("component").alias("pc"))
    met = small.join(large, ["gram", "band", "common"]).where((F.col("component") != F.col("pc")) & (F.col("pn") <= F.col("top")) & (F.col("n") <= F.col("ptop")) & _fits(percent))
    met = met.where((F.col("n") < F.col("pn")) | ((F.col("n") == F.col("pn")) & (F.col("node") < F.col("partner"))))
    return met.groupBy("node", "partner").agg(F.first("n").alias("n"), F.first("pn").alias("pn"))


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (node, partner, n, pn) those whose overlap on the first columns of both leaves room for a link."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("partner").alias("node"))).distinct()
    firsts = sets.where("columns IS NOT NULL").select("node", "columns").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(firsts, "node").join(firsts.select(F.col("node").alias("partner"), F.col("columns").alias("others")), "partner")
    return both.withColumn("overlap", F.size(F.array_intersect("columns", "others"))).where(_reaches(percent)).select("node", "partner")


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, linked): sets (doc_id, row_key, node, n) of every document, row_key a hash of its text; linked (node, component) of the sets with a link."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_key"))
    hot = HotColumns.of(source, n)
    sets = write_shared(map_arrow(source, _rows(n, percent, hot), "doc_id long, row_key long, node long, n int, cold int, columns array<long>"), "rows")
    files = -(-sets.count() // FILE_ROWS) or 1
    entries = sets.select("node", "n", "cold", F.posexplode("columns").alias("pos", "gram"))
    top = F.expr(f"CAST((n - pos) * {100 + percent}L DIV {percent} - n AS INT)")
    entries = entries.select("gram", F.when(F.col("pos") >= F.col("cold"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"), "node", "n", top.alias("top"))
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(blocks, "gram", "salt").sortWithinPartitions("gram", "node").select("gram", "node", "n", "top")
    shared = write_shared(map_arrow(dealt, _shared(hot), "gram long, node long, n int, top int"), "shared-columns")

    columns = shared.groupBy("gram").agg(F.count("*").alias("height")).where("height > 1")
    degrees = shared.join(columns, "gram").groupBy("node").agg(F.sum("height").alias("degree"))
    listed = shared.select("gram", "node", "n").join(degrees, "node")
    stars = listed.groupBy("gram").agg(F.max(F.struct("degree", "node", "n")).alias("best"), F.min(F.struct("node", "n")).alias("least")).where(F.col("best.node") != F.col("least.node"))
    partners = F.explode(F.array(F.struct(F.col("best.node").alias("partner"), F.col("best.n").alias("pn")), F.struct(F.col("least.node").alias("partner"), F.col("least.n").alias("pn"))))
    product = (
        shared.join(stars, "gram")
        .select("node", "n", partners.alias("p"))
        .select("node", "n", "p.*")
        .where((F.col("node") != F.col("partner")) & _fits(percent))
        .groupBy("node", "partner")
        .agg(F.count("*").alias("overlap"), F.first("n").alias("n"), F.first("pn").alias("pn"))
        .where(_reaches(percent))
    )
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("overlap"), "partner"))
    first_pairs = write_shared(product.withColumn("rank", rank).where("rank <= 2").select("node", "partner"), "first-pairs", files)

    reps = sets.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select("node", F.col("r.doc_id").alias("rep"), F.col("r.row_key").alias("rep_key"))

    texts, wanted = texts_of(first_pairs, reps, source, files)
    part = components(verified(first_pairs, texts, n, percent).repartition(files))
    labelled = shared.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # what is left of the product, but for the pairs that were tested
    tested = first_pairs.select("node", "partner").unionByName(first_pairs.select(F.col("partner").alias("node"), F.col("node").alias("partner")))
    rest = _first_shared(labelled, percent).join(tested, ["node", "partner"], "left_anti")
    pairs = write_shared(rest, "rest-pairs", files)
    rest = write_shared(_counted(pairs, sets, percent), "rest-counted", files)
    drop_shared(shared, first_pairs, wanted, pairs)
    if rest.isEmpty():
        return sets, part
    texts, wanted = texts_of(rest, reps, source, files)
    more = verified(rest, texts, n, percent).repartition(files)
    # these links join components: a graph whose nodes are the components
    to = part.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    for end in ("u", "v"):
        more = more.join(to, F.col(end) == F.col("x"), "left").withColumn(end, F.coalesce("cx", end)).select("u", "v")
    joined = components(more)
    drop_shared(rest, wanted)
    new = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    linked = part.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return sets, linked.unionByName(joined.join(part.select("node"), "node", "left_anti"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    sets, linked = jaccard_links(docs, n, percent, id_col, text_col)
    reps = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "component").select("node", "component_id")
    out = sets.join(named, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_kept(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, row_key (hash of the text), kept.

    Of a component the row with the least id that is not null stays, or where rows of different texts share that id
    or no id is known, the one with the least row_key.  Rows without n-grams stay.
    """
    sets, linked = jaccard_links(docs, n, percent, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    reps = sets.where("n > 0").groupBy("node").agg(F.min(row).alias("rep")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reps.groupBy("component").agg(F.min("rep").alias("stays"))
    named = reps.join(least, "component").select("node", "stays")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row_key") == F.col("stays.row_key"))
    return sets.join(named, "node", "left").select("doc_id", "row_key", ((F.col("n") == 0) | F.coalesce(stays, F.lit(False))).alias("kept"))
