"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the groups that such links form.

Sets are compared inside tiles of a shared n-gram and neighbouring size bands. Three bounds come before the exact
intersection of sorted arrays: a set of which too few n-grams occur in any other set links with nothing; two linked sets
share an n-gram among their first n/4 + 1 in order of frequency, with enough n-grams left behind it in either set, so only
such n-grams make tiles; and the bits in which two hashed bitmap signatures differ bound the overlap from above. Equal sets are one class throughout.

Groups are found in two rounds: a star round compares every set with the most central one of its tiles; the second compares
all pairs that share a tile and are not in one group yet. So a group of thousands of near copies costs a star and not all its
pairs, and no link between different groups is missed. Sets and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm import exchange
from stackloom.llm.components import components
from stackloom.llm.words import Words, mix, rolling, runs_within, words_of
from stackloom.session import stored

BITMAP_WORDS = 8
STAR_TOKENS = 8
ROWS_AT_ONCE = 1_000
SIGN = np.uint64(0x5851F42D4C957F2D)
SURVIVOR = "id long, n long, own long, bits array<long>, prefix array<long>, star array<long>, tokens binary"


def shingle_sets(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: where its sorted distinct n-gram hashes begin (and end), all of these, and the hash of the set."""
    words = words_of(texts, lower=True)
    inside = np.flatnonzero(runs_within(words, size))
    tokens, text = rolling(words.hash, size)[inside], words.text_of_word()[inside]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        tokens = np.r_[tokens, np.array([_whole(words, d) for d in few], dtype=np.uint64)]
        order = np.argsort(np.r_[text, few], kind="stable")
        tokens, text = tokens[order], np.r_[text, few][order]
    n = len(words.first) - 1
    bounds = np.searchsorted(text, np.arange(n + 1))
    for a, b in zip(bounds, bounds[1:]):
        tokens[a:b].sort()
    if len(tokens):
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])]
        tokens, text = tokens[new], text[new]
    bounds = np.searchsorted(text, np.arange(n + 1))
    total = np.r_[np.uint64(0), np.cumsum(mix(tokens ^ SIGN), dtype=np.uint64)]
    return bounds, tokens, mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _whole(words: Words, d: int) -> int:
    run = words.hash[words.first[d]:words.first[d + 1]]
    return int(mix(rolling(run, len(run)) + np.uint64(len(run)))[0])


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity signature: the bit of a hash is set if an odd number of its tokens are in the set."""
    bits = np.bitwise_and(mix(tokens), np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * BITMAP_WORDS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _batched(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n).cast("long")))


def set_members(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, batch, n, id) per row: the size of its set and the class of equal sets."""
    def measure(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(start, ROWS_AT_ONCE)
                bounds, _, ids = shingle_sets(b.column("text"), size)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("batch"), pa.array(np.diff(bounds), pa.int64()),
                                                  pa.array(ids.view(np.int64))], ["doc_id", "batch", "n", "id"])
            pa.default_memory_pool().release_unused()

    return rows.select("doc_id", "batch", "text").mapInArrow(measure, "doc_id long, batch long, n long, id long")


def survivors(rows: DataFrame, members: DataFrame, n_batches: int, bits: int, size: int, percent: int) -> DataFrame:
    """One row per class that may link with another: its shared n-grams, prefix, bitmap, and how many n-grams only it has."""
    dealt = rows.select("doc_id", "text", "batch").repartition(n_batches, "batch")

    def pack(key, table):
        ids = np.sort(table["id"].to_numpy())
        return pa.table({"batch": [key[0].as_py()], "bucket": pa.array([-1], pa.int64()), "kind": pa.array([1], pa.int32()),
                         "payload": pa.array([ids.astype("<i8").tobytes()], pa.binary())})

    owners = members.where("n > 0").groupBy("id").agg(F.min("batch").alias("batch"))
    owned = owners.groupBy("batch").applyInArrow(pack, exchange.ANSWER)

    def own_sets(table, payload):
        """The sets this batch stands for: bounds, tokens, class ids."""
        bounds, tokens, ids = shingle_sets(table["text"], size)
        ids = ids.view(np.int64)
        mine = np.frombuffer(payload, "<i8")
        distinct, first = np.unique(ids, return_index=True)
        rows_ = first[np.isin(distinct, mine) & (np.diff(bounds)[first] > 0)]
        return bounds, tokens, ids, rows_

    def keys_of(bounds, tokens, rows_):
        parts = [tokens[bounds[r]:bounds[r + 1]] for r in rows_]
        return np.unique(np.concatenate(parts), return_inverse=True, return_counts=True) if parts else (np.zeros(0, np.uint64),) * 3

    def send(key, left, right):
        sent = []
        if len(right) and len(left):
            bounds, tokens, _, rows_ = own_sets(left, right["payload"][0].as_py())
            keys, _, counts = keys_of(bounds, tokens, rows_)
            sent = [(b, key[0].as_py(), exchange.encode(keys[x:y]), _planes(counts[x:y])) for b, x, y in exchange.slices(keys, bits)]
        return exchange.released(pa.table({"bucket": pa.array([s[0] for s in sent], pa.int64()), "batch": pa.array([s[1] for s in sent], pa.int64()),
                         "keys": pa.array([s[2] for s in sent], pa.binary()), "extra": pa.array([s[3] for s in sent], pa.binary())}))

    def answer(key, table):
        batches, blobs, extra = (table[c].to_pylist() for c in ("batch", "keys", "extra"))
        keys, at, order = exchange.gather(blobs)
        counts = np.concatenate([_unplane(e) for e in extra]).astype(np.int64)
        number, begins = exchange.group_of(keys[order])
        found = np.empty(len(keys), dtype=np.int64)
        found[order] = np.add.reduceat(counts[order], begins)[number]
        back = [(b, _planes(np.minimum(found[x:y], 2**32 - 1))) for b, x, y in zip(batches, at, at[1:]) if (found[x:y] > 1).any()]
        return exchange.released(pa.table({"batch": pa.array([b for b, _ in back], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(back), pa.int64()),
                         "kind": pa.array([0] * len(back), pa.int32()), "payload": pa.array([p for _, p in back], pa.binary())}))

    def choose(key, left, right):
        out = []
        payloads = {b: p for b, p in zip(right["bucket"].to_pylist(), right["payload"].to_pylist())}
        if len(left) and -1 in payloads:
            bounds, tokens, ids, rows_ = own_sets(left, payloads[-1])
            keys, inverse, _ = keys_of(bounds, tokens, rows_)
            df = np.ones(len(keys), dtype=np.int64)
            for b, x, y in exchange.slices(keys, bits):
                if b in payloads:
                    df[x:y] = _unplane(payloads[b])
            at = 0
            for r in rows_:
                n = int(bounds[r + 1] - bounds[r])
                own = tokens[bounds[r]:bounds[r + 1]]
                freq = df[inverse[at:at + n]]
                at += n
                shared = own[freq > 1]
                alone, room = n - len(shared), n - -(-percent * n // 100) + 1
                if alone >= room:
                    continue  # too few shared n-grams for any link
                prefix = shared[np.lexsort((shared, freq[freq > 1]))][:room - alone]
                out.append((int(ids[r]), n, alone, _bitmap(shared).tolist(), prefix.view(np.int64).tolist(),
                            shared[:STAR_TOKENS].view(np.int64).tolist(), shared.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        names = ("id", "n", "own", "bits", "prefix", "star", "tokens")
        return exchange.released(pa.table({c: pa.array([o[i] for o in out], k) for i, (c, k) in enumerate(zip(names, kinds))}))

    sent = dealt.groupBy("batch").cogroup(owned.groupBy("batch")).applyInArrow(send, exchange.SENT)
    answers = sent.groupBy("bucket").applyInArrow(answer, exchange.ANSWER)
    return dealt.groupBy("batch").cogroup(answers.unionByName(owned).groupBy("batch")).applyInArrow(choose, SURVIVOR)


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplane(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _enough(n, rest, m, other_rest, percent: int):
    """Whether sets of n and m n-grams can link if at most ``rest`` of the one and ``other_rest`` of the other are common."""
    return (100 + percent) * F.least(rest, other_rest) >= percent * (F.col(n) + F.col(m))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by the bound of the bitmaps, then by intersecting the sorted arrays."""
    def side(name, *columns):
        return sets.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    most = F.floor((F.col("n_a") - F.col("own_a") + F.col("n_b") - F.col("own_b") - differ) / 2)
    hopeful = (pairs.join(side("a", "n", "own", "bits"), "a").join(side("b", "n", "own", "bits"), "b")
               .where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b", "n_a", "n_b"))
    both = hopeful.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")

    def intersect(batches):
        for batch in batches:
            rows = batch.to_pydict()
            linked = []
            for x, y, n, m in zip(rows["tokens_a"], rows["tokens_b"], rows["n_a"], rows["n_b"]):
                common = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                linked.append(100 * common >= percent * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(intersect, "a long, b long")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 75, batch_chars: int = 4_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    A set holds the distinct runs of ``size`` words (A-Z lower-cased); a text with fewer words has its whole sequence as its
    only element. Two documents link if 100 * intersection >= ``percent`` * union. Null or wordless texts have an empty set,
    link with nothing and are their own component. Rows that repeat a doc_id are answered one by one; a null doc_id is never
    the smallest unless a group has no other. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = exchange.total_chars(rows)
    n_batches = exchange.batches_for(chars, batch_chars)
    bits = exchange.bucket_bits(chars // 5, n_batches)
    rows = _batched(rows, n_batches)
    members = stored(set_members(rows, size), "members")
    sets = stored(survivors(rows, members, n_batches, bits, size, percent), "sets")

    band = F.floor(F.log("n") / math.log(100 / percent))
    star = sets.select("id", "n", "own", band.alias("band"), F.explode("star").alias("token"))
    centre = star.groupBy("token", "band").agg(F.min(F.struct(F.col("own") / F.col("n"), "id", "n", "own")).alias("c"),
                                               F.count("*").alias("members")).where("members > 1")
    # a table of its own: so Spark can split a hot tile in the join, which it cannot while the sums of the tiles hang on it
    centre = stored(centre.select("token", "band", F.col("c.id").alias("b"), F.col("c.n").alias("m"), F.col("c.own").alias("c_own")), "centres")
    pairs = (star.join(centre, ["token", "band"])
             .where((F.col("id") != F.col("b")) & _enough("n", F.col("n") - F.col("own"), "m", F.col("m") - F.col("c_own"), percent))
             .select(F.col("id").alias("a"), "b").distinct())
    links = stored(verified(pairs, sets, percent), "links")
    first = components(links)

    # at the first n-gram that two sets share, at most what follows it in either order is common: ``rest``
    tiles = (sets.select("id", "n", "own", F.posexplode("prefix").alias("place", "token")).join(first, "id", "left")
             .select("id", "n", (F.col("n") - F.col("own") - F.col("place")).alias("rest"), "token", F.coalesce("root", "id").alias("root")))
    tiles = stored(tiles, "tiles")
    mixed = tiles.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    counts = tiles.join(mixed.select("token"), "token").groupBy("token", "root").agg(F.count("*").alias("members"))
    main = counts.groupBy("token").agg(F.max_by("root", F.struct("members", "root")).alias("main"))
    inside = tiles.join(main, "token")
    rare = inside.where("root <> main").select("token", F.col("id").alias("other"), F.col("n").alias("m"), F.col("rest").alias("other_rest"),
                                              F.col("root").alias("other_root"))
    # two members of different groups: one at least is outside the tile's main group; if both are, the pair is taken once
    pairs = (inside.join(rare, "token").where((F.col("root") != F.col("other_root")) & _enough("n", F.col("rest"), "m", F.col("other_rest"), percent)
                                              & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("other"))))
             .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    more = stored(verified(pairs, sets, percent), "links")
    groups = components(links.unionByName(more))

    lowest = members.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("low"))
    named = lowest.join(groups, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    named = stored(named, "named")
    # a table of its own, like the centres: a giant group is split in the join
    leader = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "leader")
    of_class = named.join(leader, "root").select("id", "component_id")
    return (members.join(of_class.withColumnRenamed("id", "class"), (F.col("id") == F.col("class")) & (F.col("n") > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
