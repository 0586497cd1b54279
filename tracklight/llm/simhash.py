"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm.common import materialise, prepare, table, texts, word_list
from tracklight.llm.components import components
from tracklight.sources.store import batched

_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FANOUT = 8
#: Frontier entries compared at once.
STEP = 2_000_000
#: Bits of a shingle's hash that stand for it in sets, and the lowest of them that a posting keeps: the others name its slot.
TOKEN_BITS, LOW_BITS = 40, 32
#: Shingles and texts of a block of postings at most, and shingles that a slot is meant to hold.
BLOCK, BLOCK_TEXTS, SLOT = 2_000_000, 50_000, 4_000_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of all word shingles; none without words."""
    from xxhash import xxh64_intdigest

    words = [w.encode() for w in word_list((text or "").translate(_lower))]
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last[min(width, len(words)) - 1 :], strict=False)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    n, ones = len(h), np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        ones += np.unpackbits(h[lo : lo + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits of the hashes of all word shingles, as an unsigned number; 0 without words."""
    return majority(shingle_hashes(text, width))


def tokens(h: np.ndarray) -> np.ndarray:
    """The set of shingles as sorted numbers of TOKEN_BITS bits."""
    return np.unique(h >> np.uint64(64 - TOKEN_BITS)).view(np.int64)


def _tagged(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("tag", F.xxhash64("text"))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, tag (a hash of the text), fp (the fingerprint's 64 bits as a long) and n (shingles, repeats included)."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            hashes = [shingle_hashes(t, width) for t in b.column("text").to_pylist()]
            fp, n = np.array([majority(h) for h in hashes], np.uint64).view(np.int64), np.array([len(h) for h in hashes], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array(fp), pa.array(n)], names=["doc_id", "tag", "fp", "n"])

    return _tagged(docs).mapInArrow(run, "doc_id long, tag long, fp long, n long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints of many groups, each sorted by Gray rank, under a tree of nodes of FANOUT children.

    A node holds the bits that all fingerprints below it share; its stored pattern has only those that its parent doesn't
    share already, so a search adds up differences on the way down and leaves a node whose sum exceeds the bound.  Where even
    the bits that a node leaves open can't exceed the bound, all below it is linked at once.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fp), group))
        self.order, self.group, self.fp = order, group[order], fp[order]
        g = self.group
        ands, ors, owner = self.fp, self.fp, g
        start = np.arange(len(g))
        self.levels = [(start, np.full(len(g), ~np.uint64(0)), self.fp, start + 1)]  # first leaf, shared mask, pattern, end
        self.child: list[tuple[np.ndarray, np.ndarray]] = [(start, start)]
        ends = start + 1
        while len(owner) and (owner[1:] == owner[:-1]).any():
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            at = np.arange(len(owner))
            inside = at - np.maximum.accumulate(np.where(new, at, 0))
            head = np.flatnonzero(inside % FANOUT == 0)
            tail = np.append(head[1:], len(owner))
            ands, ors = np.bitwise_and.reduceat(ands, head), np.bitwise_or.reduceat(ors, head)
            mask = ~(ands ^ ors)
            self.levels.append((start[head], mask, ands & mask, ends[tail - 1]))
            self.child.append((head, tail))
            start, ends, owner = start[head], ends[tail - 1], owner[head]
        self.root_of = np.searchsorted(owner, g) if len(owner) else g
        for k in range(len(self.levels) - 1):  # a child keeps what its parent doesn't share
            head, tail = self.child[k + 1]
            parent = np.repeat(np.arange(len(head)), tail - head)
            first, mask, pattern, end = self.levels[k]
            own = mask & ~self.levels[k + 1][1][parent]
            self.levels[k] = (first, own, pattern & own, end)
        self.open_bits = []
        shared = None
        for k in range(len(self.levels) - 1, -1, -1):
            own = self.levels[k][1]
            if shared is not None:
                head, tail = self.child[k + 1]
                own = own | shared[np.repeat(np.arange(len(head)), tail - head)]
            shared = own
            self.open_bits.insert(0, 64 - np.bitwise_count(shared).astype(np.int16))

    def links(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of original positions whose links connect all fingerprints of a group within the bound of each other."""
        found_a, found_b = [], []
        top = len(self.levels) - 1
        for k in range(1, top + 1):  # so alike that all below one node are linked
            first, _, _, end = self.levels[k]
            dense = np.flatnonzero(self.open_bits[k] <= bound)
            if k < top:
                head, tail = self.child[k + 1]
                parent = np.repeat(np.arange(len(head)), tail - head)
                dense = dense[self.open_bits[k + 1][parent[dense]] > bound]
            n = end[dense] - first[dense]
            a = np.repeat(first[dense], n)
            found_a.append(a)
            found_b.append(a + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n))
        for lo in range(0, len(self.fp), 20_000):
            q = np.arange(lo, min(len(self.fp), lo + 20_000))
            self._search(q, self.root_of[q], np.zeros(len(q), np.int16), top, bound, found_a, found_b)
        a, b = np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])
        keep = a != b
        return self.order[a[keep]], self.order[b[keep]]

    def _search(self, q, node, diff, k, bound, found_a, found_b) -> None:
        first, own, pattern, end = self.levels[k]
        diff = diff + np.bitwise_count((self.fp[q] ^ pattern[node]) & own[node])
        keep = (diff <= bound) & (end[node] > q + 1)  # each pair from its earlier side
        q, node, diff = q[keep], node[keep], diff[keep]
        whole = (diff + self.open_bits[k][node] <= bound) & (first[node] > q)
        found_a.append(q[whole])
        found_b.append(first[node[whole]])
        if k == 0:
            return
        q, node, diff = q[~whole], node[~whole], diff[~whole]
        head, tail = self.child[k]
        for lo in range(0, len(q), STEP // FANOUT):
            part = slice(lo, lo + STEP // FANOUT)
            n = (tail - head)[node[part]]
            at = np.repeat(head[node[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self._search(np.repeat(q[part], n), at, np.repeat(diff[part], n), k - 1, bound, found_a, found_b)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position connected to each of n positions by the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def _parts(bits: range, n: int) -> list[list[int]]:
    """bits in n runs of about equal length."""
    return [list(bits)[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def block_keys(bound: int) -> list[int]:
    """Masks of two blocks such that two patterns within the bound agree on all bits of one mask at least: of bound + 1
    blocks one agrees, and of the rest, cut again into bound + 1 blocks, one agrees too."""
    masks = []
    for block in _parts(range(64), bound + 1):
        rest = [i for i in range(64) if i not in block]
        masks += [sum(1 << i for i in (*block, *(rest[j] for j in sub))) for sub in _parts(range(len(rest)), bound + 1)]
    return masks


def rest_keys(mask: int, bound: int) -> list[int]:
    """Masks of the bits outside `mask` in bound + 1 blocks."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << rest[j] for j in part) for part in _parts(range(len(rest)), bound + 1)]


def hamming_links(points: DataFrame, bound: int = 4, most: int = 500_000) -> DataFrame:
    """u, v: links that connect all points(fp long, distinct) whose patterns differ in at most `bound` bits.

    Each point goes once to each group of patterns that agree on a block pair, which leaves any group but one of truly
    similar patterns small; groups of one are gone before anything is compared.  A group that is larger than `most` all the same
    is dealt out once more by the blocks of its other bits, in which two of its patterns agree on one block again.  A group is
    searched in a Gray-order index, and only a spanning forest of its links leaves the worker.
    """
    spark = points.sparkSession
    prepare(spark)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = block_keys(bound)
    key = lambda i, m, *more: F.xxhash64(*more, F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m))))
    keyed = points.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), key(i, m).alias("key")) for i, m in enumerate(masks)))).alias("x")).select("fp", "x.mask", "x.key")
    if points.count() > most:  # else no group can be larger
        large = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("large")), "large")
        marked = keyed.join(large, "key", "left")
        inner = F.array(*(F.when(F.col("mask") == i, F.array(*(key(j, m, F.col("key")) for j, m in enumerate(rest_keys(m0, bound))))) for i, m0 in enumerate(masks)))
        own = F.when(F.col("large"), F.flatten(F.filter(inner, lambda x: x.isNotNull()))).otherwise(F.array("key"))
        keyed = marked.select("fp", F.explode(own).alias("key"))

    def tree(group: np.ndarray, fp: np.ndarray):
        for lo, hi in _blocks(group, 400_000):
            a, b = GrayIndex(group[lo:hi], fp[lo:hi].view(np.uint64)).links(bound)
            root = forest(a, b, hi - lo)
            at = np.flatnonzero(root != np.arange(hi - lo))
            yield fp[lo:hi][at], fp[lo:hi][root[at]]

    return _group_links(keyed, tree)


def _group_links(keyed: DataFrame, find) -> DataFrame:
    """u, v: what find(group, fp) yields for the groups of keyed(key, fp) of more than one row; whole groups are given."""
    keyed = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")

    def run(batches):
        held: list[np.ndarray] = []

        def search(rows: np.ndarray):
            key, fp = rows
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            for u, v in find(group[many], fp[many]):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            rows = np.stack([np.asarray(b.column(c)) for c in ("key", "fp")])
            if not rows.shape[1]:
                continue
            held.append(rows)
            if sum(x.shape[1] for x in held) < 500_000:
                continue
            rows = np.concatenate(held, 1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last group may go on
            if cut:
                yield from search(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield from search(np.concatenate(held, 1))

    return keyed.mapInArrow(run, "u long, v long").distinct()


def _blocks(group: np.ndarray, most: int):
    """Runs of whole groups of about `most` rows."""
    lo = 0
    while lo < len(group):
        hi = lo + most
        hi = len(group) if hi >= len(group) else max(int(np.searchsorted(group, group[hi])), int(np.searchsorted(group, group[lo], side="right")))
        yield lo, hi
        lo = hi


def postings(docs: DataFrame, width: int, slot_bits: int) -> DataFrame:
    """slot (the first bits of a shingle), block (a hash of its texts' tags), low (the last LOW_BITS bits, as bytes) and at (the place of its text
    in the block, as bytes): the shingles of a block of texts in a slot, equal texts of a block once.  One row more for each block
    has tags and sizes (shingles) of its texts."""
    fields = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("at", pa.binary()), ("tags", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
    shift = np.int64(TOKEN_BITS - slot_bits)

    def block(tags: dict[int, None], sets: list[np.ndarray]):
        from xxhash import xxh64_intdigest

        own, size = np.fromiter(tags, np.int64, len(tags)), np.array([len(x) for x in sets], np.int64)
        name = int(np.uint64(xxh64_intdigest(own.tobytes())).view(np.int64))
        token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        cuts = (np.flatnonzero(np.diff(token >> shift)) + 1).tolist()
        yield {"slot": name & ((1 << slot_bits) - 1), "block": name, "low": None, "at": None, "tags": own, "sizes": size}
        for lo, hi in zip([0, *cuts], [*cuts, len(token)], strict=True):
            yield {"slot": int(token[lo] >> shift), "block": name, "low": token[lo:hi].astype("<u4").tobytes(), "at": doc[lo:hi].astype("<u2").tobytes(), "tags": None, "sizes": None}

    def rows(batches):
        tags, sets, held = {}, [], 0
        for b in batches:
            for tag, text in zip(b.column("tag").to_pylist(), b.column("text").to_pylist(), strict=True):
                if tag in tags or not len(x := tokens(shingle_hashes(text, width))):
                    continue
                tags[tag] = None
                sets.append(x)
                held += len(x)
                if held >= BLOCK or len(sets) >= BLOCK_TEXTS:
                    yield from block(tags, sets)
                    tags, sets, held = {}, [], 0
        if sets:
            yield from block(tags, sets)

    def run(batches):
        return batched(rows(batches), fields, 64)

    return _tagged(docs).select("tag", "text").mapInArrow(run, "slot int, block long, low binary, at binary, tags array<long>, sizes array<long>")


def shared_shingles(posted: DataFrame, n_tasks: int) -> DataFrame:
    """block, at, tag and size of every text, and block, at, token and df of its shingles that df > 1 texts have."""
    names = ("block", "at", "tag", "size", "token", "df")

    def out(block, at, **columns):
        n = len(at)
        yield from (pa.RecordBatch.from_arrays([pa.array(np.full(n, block) if np.ndim(block) == 0 else block), pa.array(at.astype(np.int64)), *(pa.array(columns[c]) if c in columns else pa.nulls(n, pa.int64()) for c in names[2:])], names=list(names)).slice(lo, 100_000) for lo in range(0, n, 100_000))

    def found(slot: int, held: list):
        low = np.concatenate([np.frombuffer(x, "<u4") for _, x, _ in held])
        at = np.concatenate([np.frombuffer(x, "<u2") for _, _, x in held])
        block = np.repeat(np.array([x for x, _, _ in held], np.int64), [len(x) // 4 for _, x, _ in held])
        order = np.argsort(low, kind="stable")
        low, at, block = low[order], at[order], block[order]
        head = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        df = np.diff(np.append(head, len(low)))
        df = np.repeat(df, df)
        many = np.flatnonzero(df > 1)
        if len(many):
            yield from out(block[many], at[many], token=np.int64(slot) << np.int64(LOW_BITS) | low[many].astype(np.int64), df=df[many])

    def run(batches):
        slot, held = None, []
        for b in batches:
            for s, name, low, at, tags, sizes in zip(*(b.column(c) for c in ("slot", "block", "low", "at", "tags", "sizes")), strict=True):
                if tags.is_valid:
                    yield from out(np.int64(name.as_py()), np.arange(len(tags.values)), tag=tags.values.to_numpy(), size=sizes.values.to_numpy())
                    continue
                if s.as_py() != slot and held:
                    yield from found(slot, held)
                    held = []
                slot = s.as_py()
                held.append((name.as_py(), low.as_py(), at.as_py()))
        if held:
            yield from found(slot, held)

    return posted.repartition(n_tasks, "slot").sortWithinPartitions("slot").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def prefixes(docs: DataFrame, n_shingles: int, width: int, similarity: float) -> DataFrame:
    """token, tag, size: of each text the shingles that others have among its prefix_size first ones, rarest first.

    Texts of that similarity share one of these: prefixes of sets in one order do, and a shingle that one text alone has is in no
    other's prefix.  The order is by df, then by the number; the shingles of df 1 come first and are counted only.
    """
    spark = docs.sparkSession
    slot_bits = max(TOKEN_BITS - LOW_BITS, (n_shingles // SLOT).bit_length())
    n_tasks = min(1 << slot_bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shingles // SLOT))
    found = shared_shingles(postings(docs, width, slot_bits), n_tasks)
    shared = F.when(F.col("token").isNotNull(), F.struct("df", "token"))
    texts_ = found.groupBy("block", "at").agg(F.max("tag").alias("tag"), F.max("size").alias("size"), F.array_sort(F.collect_set(shared)).alias("shared"))
    prefix = (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-9)) + 1).cast("int")
    left = F.greatest(prefix - (F.col("size") - F.size("shared")).cast("int"), F.lit(0))
    return texts_.where(left > 0).select("tag", "size", F.explode(F.slice("shared", F.lit(1), left)).alias("x")).select("x.token", "tag", "size").distinct()


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(u, v) of tags with their likeness, by the whole sets(tag, set)."""
    one, other = (sets.select(F.col("tag").alias(c), F.col("set").alias(f"{c}_set")) for c in "uv")
    both = pairs.join(one, "u").join(other, "v").withColumn("shared", F.size(F.array_intersect("u_set", "v_set")))
    return both.select("u", "v", (F.col("shared") / (F.size("u_set") + F.size("v_set") - F.col("shared"))).alias("likeness"))


def similar_links(docs: DataFrame, marked: DataFrame, links: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v: fingerprints whose links, with the given ones, connect all texts of at least that Jaccard similarity of their sets of shingles.

    A group is the texts that have one shingle in their prefixes.  First all look to the least of their group.  Where a group is
    not one component by then, every pair of two components is compared, but those that the distances to the least exclude
    (1 - similarity is a metric).  So a group of copies costs a row for each, any other one for each pair of its components.
    """
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    sized = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)
    n_shingles = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = materialise(prefixes(docs, n_shingles, width, similarity), "prefixes")
    groups = found.groupBy("token").agg(F.min("tag").alias("least"), F.max("tag").alias("last")).where("least <> last").select("token", "least")
    members = materialise(found.join(groups, "token"), "members")
    first = materialise(marked.join(members.select("tag").distinct(), "tag", "left_semi").groupBy("tag").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"), F.min("fp").alias("fp")).select("tag", "first.doc_id", "fp"), "first")

    def run(batches):
        for b in batches:
            sets = [tokens(shingle_hashes(t, width)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("tag"), pa.array(sets, pa.list_(pa.int64()))], names=["tag", "set"])

    rows, own = _tagged(docs), first.select(F.col("tag").alias("first_tag"), F.col("doc_id").alias("first_id"))
    rows = rows.join(own, (rows["tag"] == own["first_tag"]) & rows["doc_id"].eqNullSafe(own["first_id"]), "left_semi").select("tag", "text")
    sets = materialise(rows.mapInArrow(run, "tag long, set array<long>").dropDuplicates(["tag"]), "sets")
    named = lambda pairs: pairs.join(first.select(F.col("tag").alias("u"), F.col("fp").alias("a")), "u").join(first.select(F.col("tag").alias("v"), F.col("fp").alias("b")), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    alike = lambda pairs: pairs.where(F.col("likeness") >= similarity - 1e-9)

    lowest = members.where("tag = least").select("token", F.col("size").alias("least_size"))
    starred = members.join(lowest, "token").where("tag <> least").where(sized(F.col("size"), F.col("least_size"))).select(*ordered("least", "tag")).distinct()
    stars = materialise(jaccard(starred, sets), "stars-alike")
    near = materialise(named(alike(stars)), "near")
    roots = materialise(components(links.unionByName(near)), "roots")

    rooted = members.join(first.select("tag", "fp"), "tag").join(roots, F.col("fp") == F.col("node"), "left").select("token", "tag", "size", "least", F.coalesce("component", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    split = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", "major")
    seen = stars.select("u", "v", (1 - F.col("likeness")).alias("far"))
    open_ = rooted.join(split, "token").where("tag <> least").select("*", *ordered("least", "tag")).join(seen, ["u", "v"], "left").select("token", "tag", "size", "root", "far", "major")
    open_ = materialise(open_, "open")
    minor = open_.where("root <> major").select("token", *(F.col(c).alias(f"_{c}") for c in ("tag", "size", "root", "far")))
    apart = F.coalesce(F.abs(F.col("far") - F.col("_far")) > 1 - similarity + 1e-9, F.lit(False))
    crossed = minor.join(open_, "token").where((F.col("root") != F.col("_root")) & ~apart).where(sized(F.col("size"), F.col("_size"))).select(*ordered("tag", "_tag")).distinct()
    crossed = crossed.join(stars, ["u", "v"], "left_anti")
    return near.unionByName(named(alike(jaccard(crossed, sets)))).distinct()


def near_duplicates(docs: DataFrame, bound: int = 4, width: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest reachable doc_id), tag (a hash of the text, as empty if
    null) and stays (whether the row's doc_id and tag are the first of its component) of every document.

    Fingerprints within the bound are linked and, with a similarity, also those of any two texts whose sets of shingles have at least
    that Jaccard similarity.  Equal fingerprints are one point, so copies cost nothing beyond the first.  A null, empty or wordless
    text has the fingerprint zero, linked like any other; repeated rows come back as often as they are given; a null doc_id is no
    component_id unless the component has no other; other columns are ignored; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, width), "fingerprints")
    points = materialise(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")), "points")
    links = hamming_links(points.select("fp"), bound)
    if similarity is not None:
        links = materialise(links, "links")
        links = links.unionByName(similar_links(docs, marked, links, width, similarity))
    roots = materialise(components(links), "roots")
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    ids = rooted.join(least, "root").select("fp", "least")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tag") == F.col("least.tag"))
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "tag", stays.alias("stays"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
