"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

Texts of one set of shingles are one class, whatever their number. The join runs over classes:

1. Each text's shingles are hashed where it is read; classes met before in the same task are not repeated. The postings
   (shingle, class) go to hash buckets as packed arrays, a fixed number of postings a bucket. A bucket counts each
   shingle's classes and sends on only the shingles that two classes or more share: the rest can make no pair. Shingles
   that stand in HOT of the rows or more are known before (each batch reports what is frequent in it); their postings
   are dealt by class, so that no bucket gathers them.
2. A class orders its shingles by rarity. With |r| shingles and a needed overlap of t = ceil(threshold * |r|), partners
   share l of its first |r| - t + l ones (the l-prefix) for any l. Each class takes the l of least estimated cost: the
   candidates that the prefix fetches, and those left to verify if l matches are asked for. Rarer classes keep l = 1.
   Two classes are candidates if their prefixes share the lesser l of both, and their sizes and the places of the shared
   shingles allow the threshold.
3. Links are sought for components, so a group of near copies must not become all its pairs. Star rounds pair each
   class with one other of a prefix token: as many pairs as classes. They go on while they find much.
4. Then the stars meet, not their members. 1 - similarity is a metric, so two stars can have a link between members only
   if their centres are no further apart than both members are from their centres and one link from each other. Stars
   that share too few tokens, or whose centres are too far apart, are done with one comparison; only of the others the
   members are compared with the other star's centre, and what is still possible after that, with each other. A set's
   fingerprint has the parity of its shingles in each of some cells; as many cells as differ between two sets, so many
   shingles do at least, which rules out most of these pairs where they are made. So each candidate pair is verified, or
   ruled out by a bound, or lies inside a component already.
5. A pair is verified exactly on the whole sets of both, which are read again for candidate classes only.

Every text counts with its whole length. A text with fewer words than a shingle has the whole sequence as its one; null
texts and those without words have the empty set, and are linked with nothing. Hashes have 64 bits, so sets are compared
as exactly as these tell shingles apart. Ids may repeat: each row is reported, and a repeated id stands for all its rows.
A null id is the least of a group only if all of them are null. An empty table has no groups. Other columns of the table
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import discard, input_splits, materialize
from ._words import U, distinct_runs, word_hashes

WORDS, THRESHOLD = 5, 0.75
LONGEST_MATCH = 24  # l at most
LENGTHEN = 32  # and 1 for each so many shingles: more would make places tell too little
TOKEN_BITS = 48  # of a shingle's hash in the join; similarities are taken of the whole hashes
VERIFY_COST = 50.0  # of a candidate, in postings read
MUCH = 8  # star rounds go on while one of so many pairs is a link
HOT = 1 / 64  # of all rows
FILTER_BITS = 1 << 26
MARKS = 16  # of 64 bits each, of a set's fingerprint


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    return distinct_runs(*word_hashes([(t or "").encode().lower() for t in texts]), words)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _pieces(column: pa.Array, size: int = 8 << 20):
    """Lists of consecutive texts of about `size` bytes."""
    held, total = [], 0
    for x in column:
        held.append(x.as_py())
        total += len(held[-1] or "")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def sets_of(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(_key, _n, _class, _common) of docs(_key, text): each row's number of shingles and class (null for the empty set).

    Beside them a row for each batch, with nothing but _common: the shingles of 1 in 32 of its classes or more, and how
    many of them.
    """
    key = docs.schema["_key"]
    common_type = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64())]))

    def measure(batches):
        for batch in batches:
            at = 0
            for some in _pieces(batch.column(1)):
                h, bounds = shingle_sets(some, words)
                sizes = np.diff(bounds)
                names = [class_of(h[a:b]) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                keys = batch.column(0).slice(at, len(some))
                at += len(some)
                common = []
                if len(h):
                    of = {name: k for k, name in enumerate(names) if name is not None}
                    first = np.zeros(len(some), bool)
                    first[list(of.values())] = True
                    tokens, times = np.unique(h[np.repeat(first, sizes)] >> U(64 - TOKEN_BITS), return_counts=True)
                    often = times >= max(2, len(of) / 32)
                    common = [{"token": t, "times": k} for t, k in zip(tokens[often].view(np.int64).tolist(), times[often].tolist(), strict=True)] if len(of) >= 64 else []
                columns = [keys, pa.array(sizes), pa.array(names, pa.int64()), pa.nulls(len(some), common_type)]
                last = [pa.nulls(1, keys.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([common], common_type)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(columns, last, strict=True)], names=["_key", "_n", "_class", "_common"])

    kind = key.dataType.simpleString()
    return docs.select("_key", docs[text]).mapInArrow(measure, f"_key {kind}, _n long, _class long, _common array<struct<token: long, times: long>>")


def hot_tokens(measured: DataFrame) -> dict[int, int]:
    """Shingles in HOT of the rows or more, with their number of classes as reported: 1 / HOT times a text's mean number of shingles at most."""
    rows = measured.where("_n > 0").count()
    counts = measured.where("_common is not null").select(F.inline("_common")).groupBy("token").agg(F.sum("times").alias("times"))
    return {r["token"]: r["times"] for r in counts.where(F.col("times") >= max(64.0, HOT * rows)).collect()}


def _narrow(tokens: np.ndarray) -> bytes:
    """The lower 48 bits of each."""
    return tokens.view(np.uint16).reshape(-1, 4)[:, :3].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((memoryview(raw).nbytes // 6, 4), np.uint16)
    out[:, :3] = np.frombuffer(raw, np.uint16).reshape(-1, 3)
    return out.view(U)[:, 0]


def shared_shingles(docs: DataFrame, text: str, words: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """(part, names, sizes, held, tokens, dfs): the shingles that two classes or more share, packed by class.

    Each row has some classes of one of `buckets` parts, with how many tokens of each follow; dfs are the tokens' classes.
    """
    shift = U(TOKEN_BITS - buckets.bit_length() + 1)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(list(hot), np.int64)).view(U)), docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches):
        seen: set[int] = set()
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                if packed_texts := pack_texts(texts, seen):
                    yield packed_texts

    def pack_texts(texts, seen):
        h, bounds = shingle_sets(texts, words)
        names, sizes, keep = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b > a and (name := class_of(h[a:b])) not in seen:
                if len(seen) < 4_000_000:
                    seen.add(name)
                names.append(name)
                sizes.append(b - a)
                keep.append((a, b))
        if not names:
            return None
        tokens = np.concatenate([h[a:b] for a, b in keep]) >> U(64 - TOKEN_BITS)
        owner = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
        del h
        # shingles of one text that agree in these bits stay two tokens: an overlap never shrinks
        tokens[1:] += ((tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])).astype(U)
        bucket = (tokens >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        names, sizes = np.array(names, np.int64), np.array(sizes, np.int32)
        if len(sent[0].value):
            often = _among(tokens, sent[0].value)
            bucket[often] = names[owner[often]] & (buckets - 1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            part = order[cuts[k] : cuts[k + 1]]
            if len(part):
                held = np.bincount(owner[part], minlength=len(names))
                local = np.flatnonzero(held)
                rows.append((k, _narrow(tokens[part]), held[local].astype(np.int32).tobytes(), names[local].tobytes(), sizes[local].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 5))], names=["bucket", "tokens", "held", "names", "sizes"])

    packed = docs.select(docs[text]).mapInArrow(pack, "bucket int, tokens binary, held binary, names binary, sizes binary")

    def count(group: pa.Table) -> pa.Table:
        return count_bucket(group, buckets, sent[0].value, sent[1].value)

    return packed.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(count, "part int, names binary, sizes binary, held binary, tokens binary, dfs binary")


def count_bucket(group: pa.Table, buckets: int, known: np.ndarray, hot: dict[int, int]) -> pa.Table:
    """A bucket's shingles that two classes or more share, or that are known, packed by class. known: the hot ones, sorted.

    Most postings are of shingles that are alone, so tokens are counted first, and classes are told of the others only.
    """
    raw = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
    names, sizes, held = raw("names", np.int64), raw("sizes", np.int32), raw("held", np.int32)
    t = np.empty(int(held.sum()), U)
    at = 0
    for x in group.column("tokens"):
        some = _wide(x.as_buffer())
        t[at : at + len(some)] = some
        at += len(some)
    order = np.argsort(t, kind="stable")
    t = t[order]
    runs = _runs(t)
    kept = np.repeat(runs > 1, runs) | _among(t, known)
    order, t = order[kept], t[kept]
    own = np.repeat(np.arange(len(held), dtype=np.int32), held)[order]
    c, s = names[own], sizes[own]
    order = np.lexsort((c, t))
    t, c, s = t[order], c[order], s[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c, s = t[fresh], c[fresh], s[fresh]
    runs = _runs(t)
    df = np.repeat(runs, runs)
    for k in np.flatnonzero(_among(t, known)).tolist():
        df[k] = hot[int(t[k])]
    good = df > 1
    t, c, s, df = t[good], c[good], s[good], df[good]
    order = np.lexsort((c, c & (buckets - 1)))
    t, c, s, df = t[order], c[order], s[order], df[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(c))).astype(np.int32)
    part = c[starts] & (buckets - 1)
    rows = []
    for k in np.unique(part).tolist():
        x = np.flatnonzero(part == k)
        a, b = starts[x[0]], starts[x[-1]] + held[x[-1]]
        rows.append((k, c[starts[x]].tobytes(), s[starts[x]].tobytes(), held[x].tobytes(), _narrow(t[a:b].copy()), df[a:b].astype(np.int32).tobytes()))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), **{name: pa.array([r[j] for r in rows], pa.binary()) for j, name in enumerate(("names", "sizes", "held", "tokens", "dfs"), 1)}})


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the tokens are known; known is sorted."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.diff(np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]]))


def adaptive_prefixes(shared: DataFrame, buckets: int, threshold: float, longest: int = LONGEST_MATCH) -> DataFrame:
    """(token, class, n, place, l, central): each class's prefix tokens that other classes have too, the matches that it asks for,
    each token's place in the class's order, and how many others have one of its shingles, on average."""

    def choose(group: pa.Table) -> pa.Table:
        t, c, n, df = [], [], [], []
        for names, sizes, held, tokens, dfs in zip(*(group.column(x).to_pylist() for x in ("names", "sizes", "held", "tokens", "dfs")), strict=True):
            held = np.frombuffer(held, np.int32)
            t.append(_wide(tokens))
            c.append(np.repeat(np.frombuffer(names, np.int64), held))
            n.append(np.repeat(np.frombuffer(sizes, np.int32), held))
            df.append(np.frombuffer(dfs, np.int32))
        t, c, n, df = np.concatenate(t), np.concatenate(c), np.concatenate(n).astype(np.int64), np.concatenate(df).astype(np.int64)
        order = np.lexsort((t, df, c))
        t, c, n, df = t[order], c[order], n[order], df[order]
        shared_of = _runs(c)
        starts = np.concatenate([[0], np.cumsum(shared_of)[:-1]]).astype(np.int64)
        each = np.repeat(np.arange(len(starts)), shared_of)
        rank = np.arange(len(c)) - starts[each] + 1
        spare = n - np.ceil(n * threshold - 1e-9).astype(np.int64)
        alone = n - shared_of[each]
        running = np.cumsum(df - 1)
        fetched = running - (running[starts] - (df[starts] - 1))[each]
        central = (np.add.reduceat(df - 1, starts) / n[starts])[each] if len(c) else np.zeros(0)
        place = alone + rank
        matches = place - spare  # the l whose prefix ends here
        allowed = (matches >= 1) & (matches <= np.minimum(longest, 1 + n // LENGTHEN)) & (alone <= spare)  # else the 1-prefix has no shared token, so the class has no partner
        cost = np.where(allowed, fetched * (1.0 + VERIFY_COST / np.maximum(1, matches)), np.inf)
        least = np.minimum.reduceat(cost, starts) if len(c) else cost
        best = np.where(allowed & (cost == least[each]), matches, longest + 1)
        l = (np.minimum.reduceat(best, starts) if len(c) else best)[each]
        kept = (alone <= spare) & (matches <= l)
        return pa.table({"token": t[kept].view(np.int64), "class": c[kept], "n": n[kept].astype(np.int32), "place": place[kept].astype(np.int32), "l": l[kept].astype(np.int32), "central": central[kept]})

    return shared.repartition(2 * buckets, "part").groupBy("part").applyInArrow(choose, "token long, class long, n int, place int, l int, central double")


def _bodies(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(class, body, n, marks): the sets of the wanted classes, their sizes and fingerprints. A bit filter of fixed size spares most other texts the way."""
    slot = F.pmod(F.col("class"), F.lit(FILTER_BITS)) + 1
    maps = wanted.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def fetch(batches):
        filled, seen = sent.value, set()
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                h, bounds = shingle_sets(texts, words)
                names, bodies, sizes, marks = [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if b > a:
                        name = class_of(h[a:b])
                        at = name % FILTER_BITS
                        if filled[at >> 3] >> (at & 7) & 1 and name not in seen:
                            if len(seen) < 4_000_000:
                                seen.add(name)
                            names.append(name)
                            bodies.append(h[a:b].tobytes())
                            sizes.append(b - a)
                            marks.append(fingerprint(h[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["class", "body", "n", "marks"])

    found = docs.select(docs[text]).mapInArrow(fetch, "class long, body binary, n long, marks array<long>")
    return found.join(wanted, "class", "left_semi").groupBy("class").agg(*(F.first(c).alias(c) for c in ("body", "n", "marks")))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 64 * MARKS cells, as MARKS integers."""
    cells = 64 * MARKS
    return np.packbits(np.bincount((shingles & U(cells - 1)).astype(np.int64), minlength=cells) & 1).view(np.int64)


def _most_similar(n_a, marks_a, n_b, marks_b):
    """A bound of the similarity of two sets, of their sizes and fingerprints."""
    differ = sum((F.bit_count(marks_a[k].bitwiseXOR(marks_b[k])) for k in range(MARKS)), F.lit(0))
    both = n_a + n_b
    return (both - differ) / (both + differ)


def similarities(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """pairs(a, b, floor)'s rows whose sets' similarity is floor or more, with it in column sim."""

    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.empty(len(x))
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            r, s = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
            both = np.concatenate([r, s])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[k] = shared / (len(both) - shared)
        return pa.array(out)

    first = pairs.join(bodies.select(F.col("class").alias("a"), F.col("body").alias("body_a")), "a")
    both = first.join(bodies.select(F.col("class").alias("b"), F.col("body").alias("body_b")), "b")
    measured = both.withColumn("sim", F.arrow_udf(similar, "double").asNondeterministic()("body_a", "body_b"))
    return measured.drop("body_a", "body_b").where(F.col("sim") >= F.col("floor") - 1e-9)


def _may_reach(rest_a, rest_b, n_a, n_b, l, threshold: float):
    """Can two sets have the needed overlap if this is one of their first l common tokens?

    rest: how many shingles follow the token in a set's order. The j-th common token leaves at most j + the lesser rest.
    """
    return F.least(rest_a, rest_b) + l >= (n_a + n_b) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6)


def _sizes_allow(x, y, threshold: float):
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold) - F.lit(1e-9)


def _star_pairs(postings: DataFrame, threshold: float, turn: int) -> DataFrame:
    """(a, b): each class and the one class, least in this turn's order among a token's, that most of its tokens offer.

    The first turn's order is by how much a class shares with all others: the text that near copies were made from, of
    which each copy lacks something, comes before its copies. Later turns' orders are by hash.
    """
    order = F.xxhash64("class", F.lit(turn)) if turn else -F.col("central")
    pivot = F.struct(order.alias("o"), F.col("class").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"), (F.col("n") - F.col("place")).alias("rest"), F.col("l").alias("l"))
    least = materialize(postings.groupBy("token").agg(F.min(pivot).alias("least")), "pivots")  # written, so that Spark may split a frequent token
    offers = postings.join(least, "token").where("label <> least.pl").where(_sizes_allow("n", "least.pn", threshold))
    offers = offers.where(_may_reach(F.col("n") - F.col("place"), F.col("least.rest"), F.col("n"), F.col("least.pn"), F.least("l", "least.l"), threshold))
    counted = offers.groupBy("class", F.col("least.p").alias("p")).agg(F.count("*").alias("k"))
    pairs = materialize(counted.groupBy("class").agg(F.max(F.struct("k", "p")).alias("m")).select(F.col("class").alias("a"), F.col("m.p").alias("b")), "pairs")
    discard(least)
    return pairs


def _star_units(stars: DataFrame) -> DataFrame:
    """(class, unit, far): each class that a star round linked with a centre, and its distance; centres are their own units."""
    centres = stars.select(F.col("b").alias("class")).distinct()
    nearest = stars.groupBy(F.col("a").alias("class")).agg(F.max(F.struct("sim", "b")).alias("m"))
    return nearest.join(centres, "class", "left_anti").select("class", F.col("m.b").alias("unit"), (1 - F.col("m.sim")).alias("far"))


def _unit_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """(x, y, x_far, y_far): stars of different components whose members may share as many tokens as a candidate pair must."""
    rest = F.col("n") - F.col("place")
    sides = postings.groupBy("token", "unit", "label").agg(F.max(rest).alias("rest"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("l").alias("l"), F.min("l").alias("need"), F.max("far").alias("far"))
    sides = materialize(sides, "sides")
    name = lambda side: sides.toDF("token", *(f"{side}_{c}" for c in sides.columns[1:]))
    met = name("x").join(name("y"), "token").where("x_unit < y_unit and x_label <> y_label")
    met = met.where((F.col("x_high") >= F.col("y_low") * threshold - 1e-9) & (F.col("y_high") >= F.col("x_low") * threshold - 1e-9))
    met = met.where(_may_reach(F.col("x_rest"), F.col("y_rest"), F.col("x_low"), F.col("y_low"), F.least("x_l", "y_l"), threshold))
    counted = met.groupBy(F.col("x_unit").alias("x"), F.col("y_unit").alias("y")).agg(F.count("*").alias("k"), F.min(F.least("x_need", "y_need")).alias("need"), F.max("x_far").alias("x_far"), F.max("y_far").alias("y_far"))
    out = materialize(counted.where("k >= need").select("x", "y", "x_far", "y_far"), "units")
    discard(sides)
    return out


def _member_pairs(postings: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs(a, b, …) that share as many prefix tokens as the lesser l of both."""
    side = lambda s: postings.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("class", "n", "place", "l"))).withColumnRenamed(f"{s}_class", s)
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "token"])
    rows = rows.where(_sizes_allow("a_n", "b_n", threshold))
    rows = rows.where(_may_reach(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"), F.col("a_n"), F.col("b_n"), F.least("a_l", "b_l"), threshold))
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.first(F.least("a_l", "b_l")).alias("l"))
    return counted.where("k >= l").select("a", "b")


class _Links:
    """The links found so far, as written tables, and the components that they form."""

    def __init__(self, spark) -> None:
        self.spark, self.tables, self.reached = spark, [], None

    def add(self, fresh: DataFrame) -> None:
        """fresh(a, b): written."""
        self.tables.append(fresh)
        every = self.tables[0].select("a", "b")
        for t in self.tables[1:]:
            every = every.union(t.select("a", "b"))
        discard(self.reached)
        self.reached = components(every)

    def label(self, df: DataFrame, column: str, into: str) -> DataFrame:
        named = self.reached.toDF(column, "_l")
        return df.drop(into).join(named, column, "left").withColumn(into, F.coalesce("_l", column)).drop("_l")


def _open(labelled: DataFrame) -> DataFrame:
    """The postings of tokens that more than one component has."""
    several = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    return materialize(labelled.join(several.select("token"), "token", "left_semi"), "open")


def links(docs: DataFrame, text: str, words: int, threshold: float, hot: dict[int, int]) -> DataFrame | None:
    """(node, label): the classes that have links, with the least class that they reach. None if there is no candidate."""
    spark = docs.sparkSession
    splits = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    parts = input_splits(docs) * max(1, splits // (16 << 20))
    buckets = 1 << max(0, (parts - 1).bit_length())
    prefixes = materialize(adaptive_prefixes(shared_shingles(docs, text, words, buckets, hot), buckets, threshold), "prefixes")
    several = prefixes.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("token")
    postings = materialize(prefixes.join(several, "token", "left_semi"), "postings")
    discard(prefixes)
    if postings.isEmpty():
        return None
    bodies = materialize(_bodies(docs, text, words, postings.select("class").distinct()), "sets", "none")
    found, stars, turn = _Links(spark), [], 0
    opened = _open(postings.withColumn("label", F.col("class")))
    while True:
        pairs = _star_pairs(opened, threshold, turn)
        fresh = materialize(similarities(pairs.withColumn("floor", F.lit(threshold)), bodies), "stars")
        tried, good = pairs.count(), fresh.count()
        discard(pairs)
        stars.append(fresh)
        found.add(fresh)
        past, opened = opened, _open(found.label(postings, "class", "label"))
        discard(past)
        turn += 1
        if good * MUCH < tried or not tried or opened.isEmpty():
            break
    _join_stars(opened, stars, bodies, found, threshold)
    discard(opened, bodies, postings)
    return found.reached


def _join_stars(opened: DataFrame, stars: list[DataFrame], bodies: DataFrame, found: _Links, threshold: float) -> None:
    """Add to found what links different components: see step 4 above."""
    link = 1 - threshold
    every = stars[0]
    for s in stars[1:]:
        every = every.union(s)
    marked = bodies.select("class", F.col("n").alias("size"), "marks")
    members = materialize(_star_units(every).join(marked, "class"), "members")
    own = opened.join(members.select("class", "unit", "far"), "class", "left").withColumn("unit", F.coalesce("unit", "class")).withColumn("far", F.coalesce("far", F.lit(0.0)))
    own = materialize(own, "own")
    # centres
    units = _unit_pairs(own, threshold)
    near = similarities(units.select(F.col("x").alias("a"), F.col("y").alias("b"), "x_far", "y_far", (1 - F.col("x_far") - F.col("y_far") - link).alias("floor")), bodies)
    near = materialize(near, "centres")
    discard(units)
    found.add(materialize(near.where(F.col("sim") >= threshold - 1e-9), "links"))
    apart = lambda df, x="a", y="b": found.label(found.label(df, x, "_x"), y, "_y").where("_x <> _y").drop("_x", "_y")
    rest = materialize(apart(near.where("x_far > 0 or y_far > 0")).select(F.col("a").alias("x"), F.col("b").alias("y"), "x_far", "y_far", "sim"), "rest")
    discard(near)
    if not rest.isEmpty():
        # members with the other star's centre: each within reach of one link to a member of the other
        crossed = rest.union(rest.select("y", "x", "y_far", "x_far", "sim")).withColumn("floor", 1 - F.col("y_far") - link)
        crossed = materialize(crossed.join(marked.toDF("y", "y_size", "y_marks"), "y"), "crossed")
        reach = members.withColumnRenamed("unit", "x").join(crossed, "x").where(F.col("far") + link + F.col("y_far") >= 1 - F.col("sim") - 1e-9)
        reach = reach.where(_most_similar(F.col("size"), F.col("marks"), F.col("y_size"), F.col("y_marks")) >= F.col("floor") - 1e-9)
        spokes = materialize(reach.select(F.col("class").alias("a"), F.col("y").alias("b"), F.col("x").alias("home"), "far", "floor"), "spokes")
        sims = materialize(similarities(spokes, bodies).select("a", "b", "home", "far", "sim"), "reach")
        discard(spokes, crossed)
        found.add(materialize(sims.where(F.col("sim") >= threshold - 1e-9), "links"))
        # members with members, of the stars that are still apart
        kept = materialize(apart(sims), "still")
        still = kept
        still = still.join(marked.withColumnRenamed("class", "a"), "a")
        side = lambda s, home, other: still.select(F.col("a").alias(s), F.col("home").alias(home), F.col("b").alias(other), F.col("far").alias(f"{s}_own"), (1 - F.col("sim")).alias(f"{s}_other"), F.col("size").alias(f"{s}_size"), F.col("marks").alias(f"{s}_marks"))
        both = side("p", "x", "y").join(side("q", "y", "x"), ["x", "y"]).where("x < y")
        both = both.where((F.abs(F.col("p_own") - F.col("q_other")) <= link + 1e-9) & (F.abs(F.col("q_own") - F.col("p_other")) <= link + 1e-9))
        both = both.where(_most_similar(F.col("p_size"), F.col("p_marks"), F.col("q_size"), F.col("q_marks")) >= threshold - 1e-9)
        pairs = _member_pairs(own, both.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), threshold)
        found.add(materialize(similarities(pairs.withColumn("floor", F.lit(threshold)), bodies), "links"))
        discard(sims, kept)
    discard(members, own, rest)


def group_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: the key, n_shingles, component_id (the least key that links reach, its own included)."""
    own = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    measured = materialize(sets_of(own, "_text", words), "classes")
    rows = measured.where("_common is null").select("_key", "_n", "_class")
    named = links(own, "_text", words, threshold, hot_tokens(measured))
    classes = rows.where("_class is not null").groupBy("_class").agg(F.min("_key").alias("_id"))
    if named is not None:
        linked = materialize(named.toDF("_class", "_label").join(classes, "_class"), "linked")
        least = materialize(linked.groupBy("_label").agg(F.min("_id").alias("_least")), "least")  # written, so that Spark may split a large group
        classes = classes.join(linked.join(least, "_label").select("_class", "_least"), "_class", "left").select("_class", F.coalesce("_least", "_id").alias("_id"))
    joined = rows.join(materialize(classes, "ids"), "_class", "left")
    return joined.select(F.col("_key").alias(key), F.col("_n").alias("n_shingles"), F.when(F.col("_class").isNull(), F.col("_key")).otherwise(F.col("_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from ._shared import table

    return group_near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: md5(array_to_string(w[i : i + {WORDS} - 1], ' ')))) AS s FROM docs WHERE len(w) >= {WORDS}
    UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM docs WHERE len(w) BETWEEN 1 AND {WORDS} - 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= {round(100 * THRESHOLD)} * (p.n + q.n - k)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT a, y FROM reach JOIN sides ON b = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
