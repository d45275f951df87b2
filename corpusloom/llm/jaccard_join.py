"""Jaccard self-join on word shingles: prefixes under several global orders, intersected before verification.

Sets that overlap enough share a token among the first few of each, whatever global order of the tokens
the "first" refer to. Rare tokens first make short lists, so every order here goes by how often a token
occurs, from exact to coarse, with another hash among equals. Classes of equal sets meet in buckets of
the first order's prefix tokens; two of them stay candidates only if they share a prefix token under
every other order, and if their sizes and the parity of their tokens allow the overlap. What is left is
spanned by a forest of nearest pairs, and each of its edges is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import GOLDEN, checkpointed, mix, text_of, tidy
from corpusloom.llm.components import components
from corpusloom.llm.passages import bucket, groups, packed, short, slices, table_of, unpacked
from corpusloom.llm.simhash import LOWER
from corpusloom.operators.lookup import lookup

#: Bytes of text in a chunk and in a partition, on average.
CHUNK, PARTITION = 6 << 20, 64 << 20
#: Orders of the tokens: by how many bits of the frequency's code are left out. Eight codes double it.
ORDERS = (0, 3, 4)
#: Classes compared in one task at once, and those that also go to every block of a larger bucket.
BLOCK, GUESTS = 1024, 16
#: Edges that a task takes while components are found.
EDGES = 1 << 18
#: Least bits of a parity sketch per token.
BITS = 4


def token_set(body: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles (fewer words: all as one); A-Z lowered."""
    words = body.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(h) - width + 1
    out = h[:n]
    for j in range(1, width):
        out = mix(out * GOLDEN + h[j : j + n])
    out = np.sort(out)
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def frequency_code(count: np.ndarray) -> np.ndarray:
    """0 for a single occurrence, then eight steps for each doubling."""
    return np.clip(np.rint(8 * np.log2(count)) - 7, 0, 255).astype(np.uint8)


def prefixes(tokens: np.ndarray, codes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The prefix of a set under each order, without the tokens that occur in it alone."""
    length = len(tokens) - -(-percent * len(tokens) // 100) + 1
    single = codes == 0
    length -= int(single.sum())
    if length <= 0:
        return [tokens[:0]] * len(ORDERS)
    tokens, codes = tokens[~single], codes[~single]
    out = []
    for k, coarse in enumerate(ORDERS):
        rank = ((codes >> coarse).astype(np.uint64) << np.uint64(56)) | (mix(tokens ^ np.uint64(k + 1)) >> np.uint64(8))
        out.append(tokens[np.argsort(rank, kind="stable")[:length]])
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of 2 ** k places, BITS a token at least, packed in 64-bit words.

    Two sketches differ in no more places than the sets have tokens that only one has. Folding a
    sketch in halves gives the sketch with half the places.
    """
    places = max(64, 1 << (BITS * len(tokens) - 1).bit_length())
    at = (mix(tokens ^ GOLDEN) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


class Sketches:
    """Parity sketches of the members of a bucket, by width."""

    def __init__(self, sketches: list[np.ndarray]):
        self.words = np.array([len(s) for s in sketches])
        self.rows = {w: np.flatnonzero(self.words == w) for w in np.unique(self.words).tolist()}
        self.full = {w: np.stack([sketches[i] for i in rows]) for w, rows in self.rows.items()}
        self.nth = np.zeros(len(sketches), np.int64)
        for rows in self.rows.values():
            self.nth[rows] = np.arange(len(rows))

    def least_difference(self, i: int, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences; 0 for members of a size out of reach."""
        own, out = int(self.words[i]), np.zeros(len(others), np.int64)
        mine = self.full[own][self.nth[i]]
        for w, x in ((own, mine), (own // 2, folded(mine) if own > 1 else mine[:0]), (2 * own, mine)):
            if w not in self.rows or not w:
                continue
            here = self.words[others] == w
            if here.any():
                theirs = self.full[w][self.nth[others[here]]]
                theirs = folded(theirs) if w > own else theirs
                out[here] = np.bitwise_count(theirs ^ x).sum(axis=1)
        return out


def sharing(tokens: list[np.ndarray]) -> np.ndarray:
    """Which members have a token in common."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, column = np.unique(np.concatenate(tokens), return_inverse=True)
    out = np.zeros((len(tokens), len(tokens)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        here = (column >= at) & (column < at + 4096)
        has = np.zeros((len(tokens), 4096), np.float32)
        has[owner[here], column[here] - at] = 1
        out += has @ has.T
    return out > 0


def survivors(size: np.ndarray, group: np.ndarray, orders: list[list[np.ndarray]], sketches: list[np.ndarray], percent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, difference)`` of members of different groups that no filter tells apart, nearest first."""
    may = np.triu(100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size), 1)
    may &= group[:, None] != group[None, :]
    for tokens in orders:
        if may.any():
            may &= sharing(tokens)
    found = []
    if may.any():
        held = Sketches(sketches)
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            others = np.flatnonzero(may[i])
            apart = held.least_difference(i, others)
            near = apart * (100 + percent) <= (100 - percent) * (size[i] + size[others])
            found.append((np.full(int(near.sum()), i), others[near], apart[near]))
    i, j, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    order = np.argsort(apart, kind="stable")
    return i[order], j[order], apart[order]


def forest(i: np.ndarray, j: np.ndarray, group: np.ndarray) -> list[int]:
    """The pairs, taken in order, that join two groups not joined before."""
    root = list(range(int(group.max(initial=-1)) + 1))
    left, out = len(set(group.tolist())), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at, (a, b) in enumerate(zip(group[i].tolist(), group[j].tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[a] = b
            out.append(at)
            left -= 1
            if left == 1:
                break
    return out


def dealt(texts: DataFrame, parts: int, total: int) -> DataFrame:
    """Texts in chunks of bounded size by a hash, shuffled once."""
    chunks = max(2 * parts, -(-total // CHUNK))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return texts.select(chunk.alias("chunk"), "doc_id", F.col("text").cast("binary").alias("body")).repartition(parts, "chunk")


class ChunkSets:
    """The sets of a chunk's documents; equal ones are kept once."""

    def __init__(self, table: pa.Table, shingle: int):
        self.owner: list[bytes | None] = []
        self.size: list[int] = []
        self.sets: dict[bytes, np.ndarray] = {}
        for body in table["body"]:
            tokens = token_set(body.as_py(), shingle)
            name = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
            self.owner.append(name)
            self.size.append(len(tokens))
            if name is not None:
                self.sets.setdefault(name, tokens)

    def counted(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens by their part, the parts, and in how many of the sets each is."""
        if not self.sets:
            return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64)
        key, count = np.unique(np.concatenate(list(self.sets.values())), return_counts=True)
        part = bucket(key, parts)
        order = np.argsort(part, kind="stable")
        return key[order], part[order], count[order]


CLASSES = "doc_id long, n long, cls binary, first array<long>, others array<binary>, sketch binary, tokens array<long>"


def measured(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """CLASSES: the size of every document's set and the set's name. The first document with an id of a set
    in a chunk also has its prefixes, sketch and tokens, if every order has a prefix token that occurs again.

    Chunks send their tokens (32 bits besides the part) with counts; codes of the frequencies come back.
    """
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    docs = dealt(texts, parts, total)

    def send(table: pa.Table) -> pa.Table:
        rows = []
        key, part, count = ChunkSets(table, shingle).counted(parts)
        for p, a, b in slices(part):
            asked, place = np.unique(short(key[a:b]), return_inverse=True)
            rows.append((table["chunk"][0].as_py(), p, asked.tobytes(), packed(np.bincount(place, count[a:b]).astype(np.uint32))))
        return table_of(rows, "chunk int, part int, keys binary, counts binary")

    def summed(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
        key, place = np.unique(np.concatenate(sent), return_inverse=True)
        counts = np.concatenate([np.frombuffer(unpacked(x), np.uint32) for x in table["counts"].to_pylist()])
        codes = frequency_code(np.bincount(place, counts))[place]
        ends = np.cumsum([len(x) for x in sent])
        replies = [packed(codes[b - len(x) : b]) for x, b in zip(sent, ends.tolist())]
        return table_of(list(zip(table["chunk"].to_pylist(), table["part"].to_pylist(), replies)), "chunk int, part int, codes binary")

    def described(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = ChunkSets(table, shingle)
        key, part, _ = chunk.counted(parts)
        bodies = dict(zip(replies["part"].to_pylist(), replies["codes"].to_pylist()))
        codes = np.zeros(len(key), np.uint8)
        for p, a, b in slices(part):
            _, place = np.unique(short(key[a:b]), return_inverse=True)
            codes[a:b] = np.frombuffer(unpacked(bodies[p]), np.uint8)[place]
        order = np.argsort(key)
        key, codes = key[order], codes[order]
        first, others, sketches, tokens, seen = [], [], [], [], set()
        for name, known in zip(chunk.owner, table["doc_id"].is_valid().to_pylist()):
            row = None
            if known and name is not None and name not in seen:
                seen.add(name)
                own = chunk.sets[name]
                found = prefixes(own, codes[np.searchsorted(key, own)], percent)
                if all(map(len, found)):
                    row = found[0].view(np.int64), [np.sort(short(x)).tobytes() for x in found[1:]], sketch(own).tobytes(), own.view(np.int64)
            for column, x in zip((first, others, sketches, tokens), row or (None,) * 4):
                column.append(x)
        return pa.table({
            "doc_id": table["doc_id"], "n": pa.array(chunk.size, pa.int64()), "cls": pa.array(chunk.owner, pa.binary()),
            "first": pa.array(first, pa.list_(pa.int64())), "others": pa.array(others, pa.list_(pa.binary())),
            "sketch": pa.array(sketches, pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64())),
        })

    sent = groups(docs, "chunk", send, "chunk int, part int, keys binary, counts binary")
    codes = groups(sent.repartition(parts, "part"), "part", summed, "chunk int, part int, codes binary")
    return docs.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(described, CLASSES)


def compared(rows: DataFrame, percent: float, every: bool) -> DataFrame:
    """``(token, a, b)``: pairs of a bucket's block that pass all filters; the forest of the nearest, or
    ``every`` one. ``rows (token, block, cls, grp, n, others, sketch)``."""

    def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        names, token = t["cls"].to_pylist(), t["token"][0].as_py()
        _, group = np.unique(np.array(t["grp"].to_pylist(), object), return_inverse=True)
        orders = [[np.frombuffer(x, np.uint32) for x in o] for o in zip(*t["others"].to_pylist())]
        sketches = [np.frombuffer(x, np.uint64) for x in t["sketch"].to_pylist()]
        i, j, _ = survivors(t["n"].to_numpy(), group, orders, sketches, percent)
        keep = range(len(i)) if every else forest(i, j, group)
        pairs = [sorted((names[i[k]], names[j[k]])) for k in keep]
        return pa.RecordBatch.from_arrays(
            [pa.array([token] * len(pairs), pa.int64()), pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())],
            names=["token", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; a block may run over several batches."""
        at, held = None, []
        for b in batches:
            token, block = b.column("token").to_numpy(), b.column("block").to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1 if b.num_rows else []
            for x, y in zip([0, *cuts], [*cuts, b.num_rows]) if b.num_rows else []:
                key = int(token[x]), int(block[x])
                if key != at and held:
                    yield edges(held)
                    held = []
                at = key
                held.append(b.slice(x, y - x))
        if held:
            yield edges(held)
        tidy()

    dealt = rows.repartition("token", "block").sortWithinPartitions("token", "block", "cls")
    return dealt.mapInArrow(run, "token long, a binary, b binary")


def verified(edges: DataFrame, facts: DataFrame, percent: float) -> DataFrame:
    """The edges with ``linked``: whether the sets overlap as much as asked."""
    pairs = edges.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = lookup(facts.select("cls", "tokens"), ends, "cls", "inner")
    one = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("common")
    return both.select("a", "b", (F.col("common") * 100 >= union * percent).alias("linked"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: the smallest id reachable by links.

    Two documents link when ``percent`` of the union of their sets of shingles is common. Equal sets are
    one class. A bucket of up to BLOCK classes is compared at once; a larger one is dealt into blocks,
    some classes going to all of them. Where a forest's edge fails, and for larger buckets, the classes
    outside the largest component meet all blocks again, and at last every pair that passes the filters
    and is not connected yet is verified, so no link is missed whatever the sizes.

    Null and empty texts have no shingles and no links: their component is their own id. Rows without an
    id have their size, no component, and connect nothing. Repeated rows stay; rows of one id with
    different texts are classes of their own. An empty table gives an empty table.
    """
    texts = text_of(df, id_col, text_col)
    own = checkpointed(measured(texts, shingle, percent))
    classes = own.where("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    full = own.where("doc_id is not null and tokens is not null")
    postings = full.select("cls", F.explode("first").alias("token")).distinct()
    described = full.select("cls", "n", "others", "sketch", "tokens")
    edges = links_between(postings, percent, lambda needed: lookup(described, needed, "cls", "inner").dropDuplicates(["cls"]))
    return _named(own, classes, edges)


def links_between(postings: DataFrame, percent: float, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(a, b)``: verified links between classes that connect all that are linked and share a token.

    ``postings (cls, token)``, each once; ``describe`` gives ``cls, n, others, sketch, tokens`` of the
    classes that meet others in a bucket. Buckets of equal classes are compared once.
    """
    same = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    sizes = postings.groupBy("token").agg(F.count("*").alias("m"), *same).where("m > 1")
    buckets = sizes.groupBy("m", "h1", "h2").agg(F.min("token").alias("token")).select("token", "m")
    members = checkpointed(postings.join(buckets, "token").withColumn("blocks", F.ceil(F.col("m") / BLOCK)))
    facts = checkpointed(describe(members.select("cls").distinct()))
    described = facts.select("cls", "n", "others", "sketch")
    home = F.pmod(F.xxhash64("cls"), "blocks")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    guest = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(3)), "m") < GUESTS)
    rows = members.withColumn("block", F.explode(F.when(guest, everywhere).otherwise(F.array(home))))
    tried = checkpointed(compared(rows.join(described, "cls").withColumn("grp", F.col("cls")), percent, False))
    links = None
    for every in (False, True):
        result = checkpointed(verified(tried, facts, percent))
        good = result.where("linked").select("a", "b")
        links = good if links is None else links.union(good)
        again = tried.join(result.where("not linked"), ["a", "b"], "left_semi").select("token")
        if not every:
            again = again.union(members.where("blocks > 1").select("token"))
        again = again.distinct()
        if again.isEmpty():
            return links
        named = members.join(again, "token", "left_semi").join(components(links, EDGES).withColumnRenamed("node", "cls"), "cls", "left")
        named = checkpointed(named.withColumn("grp", F.coalesce("component_id", "cls")).drop("component_id"))
        count = named.groupBy("token", "grp").agg(F.count("*").alias("k"))
        main = count.groupBy("token").agg(F.max_by("grp", F.struct("k", "grp")).alias("main"), F.count("*").alias("groups"))
        apart = named.join(main.where("groups > 1"), "token")
        block = F.when(F.col("grp") == F.col("main"), F.array(home)).otherwise(everywhere)
        rows = apart.withColumn("block", F.explode(block)).drop("main", "groups")
        tried = checkpointed(compared(rows.join(described, "cls"), percent, every))
    return links.union(verified(tried, facts, percent).where("linked").select("a", "b"))


def _named(own: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every row with the smallest id of its component."""
    found = components(edges, EDGES).withColumnRenamed("node", "cls").withColumnRenamed("component_id", "root")
    joined = classes.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    named = joined.join(least, "root").select("cls", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
