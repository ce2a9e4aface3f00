"""SimHash near-deduplication by covering locality-sensitive hashing.

A document's words (A-Z lower-cased, split at ASCII white space) give shingles;
each shingle's XXH64 votes for 64 bits.  Bit i of a fingerprint belongs to the
non-zero vector m(i) of {0,1}^(r+1); mask v keeps the bits whose m(i) has odd
overlap with v.  At most r differing bits span at most r dimensions, so some
mask v is orthogonal to all of them: in that table the two fingerprints
collide, for certain.  There are 2^(r+1)-1 masks.

Fingerprints that collide with no other one are done.  The rest are linked
exactly and without pairing up a bucket: two fingerprints within 2k bits share
a midpoint within k bits of both, and all that share a midpoint are within 2k
of each other.  So each candidate lists its ball of radius k, equal points meet
in one aggregation, and each member is linked to the point's least document.

Defined results: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows each get a row;
an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, connected_components, freeing, join_spread, maybe_in, stored, table

#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 100_000


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the 64-bit fingerprint of each row's whole text, as a signed long."""
    block = BLOCK

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        h64 = xxhash.xxh64_intdigest
        lanes = np.arange(8, dtype=np.int64) * 256
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)

        def one(text: str | None) -> int:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(size)
            starts, stops = (ends - size)[:n].tolist(), (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
            del words
            votes = np.zeros((8, 8), np.int64)
            for at in range(0, n, block):
                h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[at : at + block], stops[at : at + block])], np.uint64)
                seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048).reshape(8, 256)
                votes += seen @ bits
            return int(weights[votes.ravel() * 2 > n].sum(dtype=np.uint64).astype(np.int64))

        for b in batches:
            fps = pa.array([one(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(freeing(run), "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1)-1 masks over 64 bits, as signed longs."""
    vectors = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(64) if (v & (i % vectors + 1)).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def ball(radius: int) -> list[int]:
    """All 64-bit words with at most ``radius`` bits set, as signed longs."""
    words = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id) for those of distinct (fp, rep) that have a link: the least rep reachable over links of at most ``radius`` (even) bits."""
    if radius % 2:
        raise ValueError("radius must be even")
    table_key = F.struct(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias(f"t{k}") for k, m in enumerate(covering_masks(radius))])
    keys = [f"t{k}" for k in range(len(covering_masks(radius)))]
    dealt = fps.select("fp", "rep", F.posexplode(F.array(*[table_key[k] for k in keys])).alias("t", "key"))
    crowded = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    candidates = dealt.join(crowded, ["t", "key"], "left_semi").select("fp", "rep").distinct()
    near = F.array(*[F.lit(w).cast("long") for w in ball(radius // 2)])
    points = candidates.select("rep", F.explode(near).alias("w"), "fp").select("rep", F.col("fp").bitwiseXOR(F.col("w")).alias("point"))
    least = points.groupBy("point").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    edges = points.join(least, "point").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    comps = connected_components(edges)
    return comps.join(fps, comps.node == fps.rep).select("fp", F.col("component").alias("component_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    linked = link_fingerprints(reps, radius)
    groups = reps.join(linked.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left").where("n > 1 OR component_id <> rep")
    groups = stored(groups.select("fp", "n", F.coalesce("component_id", "rep").alias("least")))  # all others are alone
    found = join_spread(fps, groups, ["fp"], "n", "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


#: Of a text's distinct shingle hashes: two-value bands of minima, and how many least ones are kept to compare.
BANDS, LOWEST, PAIR_UP = 16, 192, 16
#: Members of a crowded bucket's largest component that each of its other members is compared with.
STARS = 4
#: A pair is ruled out by its least hashes when they estimate its similarity this far too low: by Hoeffding's bound one close pair in 10^15 is.
MARGIN = 0.3
#: Set sizes of one class differ by at most this factor.
STEP = 1.03


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 of each shingle of the whole text, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    h64 = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts, stops = (ends - size)[:n].tolist(), (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, fp, same, n, bands, low): hash of the text, fingerprint, name and size of the set of distinct shingles, band keys, least hashes."""
    bands, lowest, hashes = BANDS, LOWEST, shingle_hashes

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        place = np.arange(8, dtype=np.int64) * 256
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)
        turns = np.random.default_rng(5).integers(1, 1 << 63, (2 * bands, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def one(text):
            h = hashes(text, shingle)
            if not len(h):
                return 0, 0, 0, [], []
            votes = np.bincount((h.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048).reshape(8, 256) @ bits
            fp = int(weights[votes.ravel() * 2 > len(h)].sum(dtype=np.uint64).astype(np.int64))
            own = np.unique(h)
            least = np.full(2 * bands, np.uint64(0xFFFFFFFFFFFFFFFF))
            for a in range(0, len(own), 20_000):
                x = own[a : a + 20_000]
                mixed = (x ^ (x >> np.uint64(31))) * turns
                least = np.minimum(least, (mixed ^ (mixed >> np.uint64(33))).min(1))
            keys = (least[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ least[1::2]).view(np.int64)
            return fp, xxhash.xxh3_64_intdigest(own.tobytes()) >> 1, len(own), keys.tolist(), own[:lowest].view(np.int64).tolist()

        for b in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            rows = list(zip(*(one(t.as_py()) for t in b.column(2))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(rows, kinds))], ["id", "hash", "fp", "same", "n", "bands", "low"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).mapInArrow(freeing(run), "id long, hash long, fp long, same long, n long, bands array<long>, low array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, set): all distinct shingle hashes of each ``wanted`` (rep, id, hash), read from the row with that id and hash of the text."""
    hashes = shingle_hashes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for rep, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.unique(hashes(text.as_py(), shingle))
                yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["rep", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    near = maybe_in(texts, wanted, "hash", "wanted").where("wanted").drop("wanted").alias("d")
    w = wanted.alias("w")
    found = near.join(w.hint("merge"), F.col("d.hash").eqNullSafe(F.col("w.hash")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select("rep", "text")
    return found.mapInArrow(freeing(run), "rep long, set array<long>").dropDuplicates(["rep"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole sets (rep, set) have a Jaccard similarity of ``similarity`` or more."""
    left = pairs.join(sets.hint("merge"), F.col("u") == F.col("rep")).select("u", "v", F.col("set").alias("set_u"))
    both = left.join(sets.hint("merge"), F.col("v") == F.col("rep"))
    counted = both.select("u", "v", (F.size("set_u") + F.size("set")).alias("sizes"), F.size(F.array_intersect("set_u", "set")).alias("common"))
    return counted.where(F.col("common") / (F.col("sizes") - F.col("common")) >= similarity - 1e-12).select("u", "v")


def crowded_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): of (rep, comp, set), a superset of the pairs at ``similarity`` or more whose components differ.

    Prefix filtering: shingles have one order, the rarest first.  Two sets that
    have k shingles in common share one among the first size - k + 1 of each,
    and k is at least similarity / (1 + similarity) times the sum of the sizes.
    So that the sum is known, sets meet by classes of their size.  In a bucket
    (a shingle and two classes) only pairs with a member outside its largest
    component are made, and only those that can still reach k if this shingle
    is the first in common; each pair passes at its first one.
    """
    tokens = sets.select("rep", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
    ordered = Stored(ordered.join(sets.select("rep", "comp"), "rep").select("rep", "comp", "n", "known"))
    share = similarity / (1 + similarity)

    def size_class(n):
        return F.floor(F.log(n) / F.lit(math.log(STEP))).cast("int")

    n = F.col("n").cast("double")
    classes = F.sequence(size_class(F.greatest(F.lit(1.0), n * (similarity - 1e-9))), size_class(n / similarity * (1 + 1e-9)))
    own = ordered.df.withColumn("own", size_class(n)).withColumn("other", F.explode(classes))
    other = F.greatest(F.pow(F.lit(STEP), "other") * (1 - 1e-9), n * similarity)
    needed = F.least(F.ceil((n + other) * share - 1e-6).cast("int"), F.col("n"))
    rare = F.col("n") - F.size("known")  # found in this set only: first of all
    first = F.slice("known", 1, F.greatest(F.lit(0), F.col("n") - needed + 1 - rare))
    entries = own.select("rep", "comp", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), rare.alias("rare"), F.posexplode(first).alias("at", "t"))
    entries = entries.select("rep", "comp", "n", "own", "low", "high", (F.col("rare") + F.col("at")).alias("at"), F.col("t.token").alias("token"))
    key = ["token", "low", "high"]
    mixed = entries.groupBy(*key, "comp").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    met = Stored(entries.join(mixed, key).select(*key, "rep", "comp", "n", "own", "at", (F.col("comp") == F.col("main")).alias("is_main")))
    x, y = met.df.where(~F.col("is_main")).alias("x"), met.df.alias("y")
    once = F.expr("x.comp <> y.comp AND (y.is_main OR x.rep < y.rep) AND (x.low = x.high OR x.own <> y.own)")
    reached = F.expr("least(x.n - x.at, y.n - y.at)") >= F.expr("x.n + y.n") * F.lit(share) - 1e-6
    fits = F.expr("least(x.n, y.n)") >= F.expr("greatest(x.n, y.n)") * (similarity - 1e-9)
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    pairs = Stored(x.hint("merge").join(y, [*same, once, reached, fits]).select(F.expr("greatest(x.rep, y.rep)").alias("u"), F.expr("least(x.rep, y.rep)").alias("v")).distinct())
    ordered.drop()
    met.drop()
    return pairs.df


def apart(crowd: DataFrame, linked: DataFrame) -> DataFrame:
    """(band, key, rep, comp, main): members of crowded buckets (band, key, rep, members) that have several components, and the one with most members."""
    placed = crowd.join(linked, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", "members", F.coalesce("component", "rep").alias("comp"))
    counts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c"), F.first("members").alias("members"))
    several = counts.groupBy("band", "key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.first("members").alias("rows")).where("comps > 1")
    return join_spread(placed, stored(several), ["band", "key"], "rows", "rep", "inner").select("band", "key", "rep", "comp", "main")


def further_stars(crowd: DataFrame, linked: DataFrame) -> DataFrame:
    """(u, v): the members of crowded buckets outside their bucket's largest component, each with STARS members of that, others in every band.

    In a group whose copies are close to some of it only, this leaves few for
    prefix filtering, which compares what is left over with the whole group.
    """
    open_ = stored(apart(crowd, linked))
    order = [F.min(F.struct(F.xxhash64("rep", "band", F.lit(k)), "rep"))["rep"].alias(f"s{k}") for k in range(STARS)]
    centres = open_.where("comp = main").groupBy("band", "key").agg(*order, F.count("*").alias("rows"))
    centres = stored(centres.select("band", "key", F.array_distinct(F.array(*[F.col(f"s{k}") for k in range(STARS)])).alias("centres"), "rows"))
    met = join_spread(open_.where("comp <> main").select("band", "key", "rep"), centres, ["band", "key"], "rows", "rep", "inner")
    each = met.select("rep", F.explode("centres").alias("centre"))
    return each.select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v")).distinct()


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one document (the least id) of each group linked at a Jaccard similarity of ``similarity`` or more.

    Pairs at 0.8 differ in some 10 of a SimHash's 64 bits, and a covering of
    radius 10 has 2047 tables.  So the covering tables (of ``radius`` bits)
    give candidates together with bands of two minima of the shingle hashes
    (16 bands: a pair at 0.8 shares one but for one in ten million).  Buckets
    of up to PAIR_UP documents are paired up; larger ones link to the member of
    least hash, another in every band.  That joins groups of close copies.  In
    buckets that still have several components, members outside the largest one
    are compared with STARS of its members; what then is left apart meets by
    prefix filtering, which misses no pair.  All candidates are verified on their
    whole shingle sets: at once up to LOWEST distinct shingles; of larger sets
    the LOWEST least hashes of the union rule pairs out that are MARGIN below,
    and the others are compared in full.  Equal sets are merged first.

    Defined results: null and empty texts, and all without words, are copies of
    each other; texts of any length are compared whole; of rows with equal ids
    and texts all stay or go, other texts under one id are judged apart; null
    ids are the least; an empty table gives no rows; other columns are carried
    along, whatever their names.
    """
    made = Stored(sketches(docs, shingle, id_col, text_col))
    sk = made.df
    class_of = Stored(sk.groupBy("same", "n").agg(F.min(F.struct("id", "hash")).alias("x"), F.count("*").alias("copies")).select("same", "n", "x.*", "copies", F.xxhash64("same", "n").alias("rep")))
    c = class_of.df.select(*[F.col(k).alias(f"c_{k}") for k in ("same", "n", "id", "hash", "rep")])
    is_first = (F.col("hash") == F.col("c_hash")) & F.col("id").eqNullSafe(F.col("c_id")) & (F.col("same") == F.col("c_same")) & (F.col("n") == F.col("c_n"))
    reps = Stored(sk.join(c.hint("merge"), is_first).select(F.col("c_rep").alias("rep"), "id", "hash", "fp", "n", "bands", "low").dropDuplicates(["rep"]))
    masks = [F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in covering_masks(radius)]
    keys = F.concat(F.col("bands"), F.array(*[F.xxhash64(F.lit(k), m) for k, m in enumerate(masks)]))
    dealt = reps.df.where("n > 0").select("rep", F.posexplode(keys).alias("band", "key")).withColumn("order", F.xxhash64("rep", "band"))
    buckets = dealt.groupBy("band", "key").agg(F.count("*").alias("members"), F.min(F.struct("order", "rep"))["rep"].alias("centre")).where("members > 1")
    buckets = Stored(buckets)
    met = Stored(join_spread(dealt.select("rep", "band", "key"), buckets.df, ["band", "key"], "members", "rep", "inner"))
    stars = met.df.where("rep <> centre").select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v"))
    few = met.df.where(F.col("members").between(3, PAIR_UP)).groupBy("band", "key").agg(F.sort_array(F.collect_list("rep")).alias("all"))
    two = few.select("all", F.explode("all").alias("v")).select("v", F.explode(F.filter("all", lambda x: x > F.col("v"))).alias("u"))
    pairs = stars.union(two.select("u", "v")).distinct()
    sets = reps.df.select("rep", "n", "low")
    left = pairs.join(sets.hint("merge"), F.col("u") == F.col("rep")).select("v", "u", F.col("n").alias("n_u"), F.col("low").alias("low_u"))
    both = left.join(sets.hint("merge"), F.col("v") == F.col("rep"))
    common = F.array_intersect("low_u", "low")
    union = F.slice(F.array_sort(F.transform(F.array_union("low_u", "low"), lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))), 1, LOWEST)
    shared = F.size(F.array_intersect(union, F.transform(common, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))))
    exact = F.size(common) / (F.col("n_u") + F.col("n") - F.size(common))
    whole = F.greatest("n_u", "n") <= LOWEST
    close = F.when(whole, exact >= similarity - 1e-12).otherwise(shared / F.size(union) >= similarity - MARGIN)
    possible = F.least("n_u", "n") >= F.greatest("n_u", "n") * (similarity - 1e-9)
    judged = Stored(both.where(possible & close).select("u", "v", whole.alias("whole")))
    unsure = judged.df.where(~F.col("whole")).select("u", "v")
    crowd = Stored(met.df.where(F.col("members") > PAIR_UP).select("band", "key", "rep", "members"))
    wanted = unsure.select(F.col("u").alias("rep")).union(unsure.select("v")).union(crowd.df.select("rep")).distinct()
    full = Stored(shingle_sets(docs, stored(reps.df.select("rep", "id", "hash").join(wanted, "rep")), shingle, id_col, text_col))
    edges = judged.df.where("whole").select("u", "v").union(similar(unsure, full.df, similarity))
    linked = Stored(connected_components(edges))
    more = similar(further_stars(crowd.df, linked.df), full.df, similarity)
    again = Stored(connected_components(linked.df.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)))
    left_over = Stored(apart(crowd.df, again.df).select("rep", "comp").distinct())
    more = similar(crowded_pairs(full.df.join(left_over.df, "rep"), similarity), full.df, similarity)
    comps = connected_components(again.df.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    named = stored(comps.withColumnRenamed("node", "rep").join(reps.df.select("rep", "id"), "rep"))
    winners = named.groupBy("component").agg(F.min(F.struct("id", "rep"))["rep"].alias("rep"))
    gone = named.join(winners.select("rep"), "rep", "left_anti").select("rep", F.lit(True).alias("gone"))
    verdict = stored(class_of.df.join(gone, "rep", "left").select("same", "n", F.col("id").alias("first"), "copies", F.coalesce("gone", F.lit(False)).alias("gone")))
    found = join_spread(sk.select("id", "hash", "same", "n"), verdict, ["same", "n"], "copies", "id")
    lost = stored(found.where(F.col("gone") | ~F.col("id").eqNullSafe(F.col("first"))).select("id", "hash").distinct())
    for x in (made, class_of, reps, buckets, met, judged, crowd, full, linked, again, left_over):
        x.drop()
    return docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost["id"]) & (F.xxhash64(docs[text_col]) == lost["hash"]), "left_anti")
