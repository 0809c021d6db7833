"""SimHash near-duplicates: 64-bit fingerprints, pivot distance tables, components.

Equal fingerprints are one from the start. Pairs that can be close agree on some blocks of bits (for d differing bits
and n blocks, on n - d of them), so fingerprints are dealt out by those blocks. Within a deal, each fingerprint has
precomputed Hamming distances to many reference fingerprints; a pair whose largest difference of these coordinates
exceeds the limit can't be close, by the triangle inequality, and is discarded; the survivors are verified. A deal
over ``bucket_cap`` members isn't compared pair by pair: its members go by an exact detour instead, where two
fingerprints at most two bits apart meet at a value one bit from both, so that groups stay at 65 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, of_root
from .shared import map_arrow, partitions_for, remove, write_table
from .wordarrays import U, mix, slices, text_buffers

PIVOTS = mix(np.arange(1, 33, dtype=U) * U(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words.

    Only A-Z are lower-cased and only 0x20 and 0x09-0x0D separate words. A bit is 1 if it is set in over half of the
    shingles' XXH64 values. Fewer words than a shingle make one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[shingle_words - 1 :] - 1 if len(words) >= shingle_words else ends[-1:] - 1
    h = xxhash.xxh64_intdigest
    values = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), U, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(values[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle_words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row; null texts have no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_buffers(b.column("text"))
            raw = data.tobytes()
            found = np.fromiter((fingerprint(raw[i:j], shingle_words) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, compute, "doc_id long, fingerprint long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - max_bits`` blocks; a pair within max_bits agrees on one of them."""
    cut = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [sum(each[k] for k in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most ``max_bits`` apart: the pivot table discards, the fingerprints themselves decide."""
    table = np.bitwise_count(values[:, None] ^ PIVOTS).astype(np.int8)
    left, right = np.triu_indices(len(values), 1)
    for p in range(0, len(PIVOTS), 8):
        near = (np.abs(table[left, p : p + 8] - table[right, p : p + 8]) <= max_bits).all(axis=1)
        left, right = left[near], right[near]
    near = np.bitwise_count(values[left] ^ values[right]) <= max_bits
    return left[near], right[near]


def _compare(batches: Iterator[pa.RecordBatch], max_bits: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by deal. Yields linked pairs (a, b), and (a, null) for members of a deal over ``cap``."""
    key, held, crowded = None, [], False
    a_out: list[int] = []
    b_out: list[int | None] = []

    def close_deal():
        if len(held) > 1 and not crowded:
            values = np.array(held, np.int64)
            left, right = close_pairs(values.view(U), max_bits)
            a_out.extend(values[left].tolist())
            b_out.extend(values[right].tolist())

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        a_out.clear()
        b_out.clear()
        return out

    for batch in batches:
        keys, values = batch.column("deal").to_numpy(), batch.column("fingerprint").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
        # a run of one row with neither neighbour in another batch needs no Python work
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if keys[i] != key:
                if len(held) > 1:
                    close_deal()
                key, held, crowded = keys[i], [], False
            if crowded:
                new = values[i:j].tolist()
                a_out.extend(new)
                b_out.extend([None] * len(new))
            else:
                held.extend(values[i:j].tolist())
                if len(held) > cap:
                    a_out.extend(held)
                    b_out.extend([None] * len(held))
                    held, crowded = [], True
        if len(a_out) > 50_000:
            yield flush()
    close_deal()
    yield flush()


def links(distinct: DataFrame, *, max_bits: int = 2, blocks: int = 6, bucket_cap: int = 256) -> DataFrame:
    """Edges (a, b) that join all fingerprints connected by links of ``max_bits`` or fewer differing bits.

    Between members of a crowded deal the edges lead to a common neighbour's group instead of to each other, so the
    components are those of all links, though not every link is an edge.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("the detour for crowded deals holds for one or two bits")
    n = partitions_for(distinct, 1 << 20)  # a fingerprint goes to as many deals as there are masks
    masks = block_masks(max_bits, blocks)
    deals = F.array(*[F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])
    dealt = distinct.select("fingerprint", F.explode(deals).alias("deal")).repartition(n, "deal").sortWithinPartitions("deal", "fingerprint")
    found, _ = write_table(map_arrow(dealt, lambda b: _compare(b, max_bits, bucket_cap), "a long, b long"), "pairs")
    crowded = found.where("b is null").select(F.col("a").alias("fingerprint")).distinct()
    around = F.array(F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    met = crowded.select("fingerprint", F.explode(around).alias("at"))
    least = met.groupBy("at").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("top"), F.bool_or(F.col("fingerprint") == F.col("at")).alias("own"))
    least = least.where("b <> top" if max_bits == 2 else "b <> top and own").select("at", "b")  # one bit: only over the value itself
    stars = met.join(least, "at").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return found.where("b is not null").unionByName(stars).distinct()


def simhash_components(docs: DataFrame, *, shingle_words: int = 3, max_bits: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links, for every row.

    Rows link if their fingerprints differ in at most ``max_bits`` bits. Null and empty texts have fingerprint zero
    and link like others; null ids take part and are nobody's component id unless a whole component has none; rows
    of equal id each get a row; an empty table gives no rows; columns besides id and text are not read.
    """
    rows, _ = write_table(fingerprints(docs, shingle_words=shingle_words, id_column=id_column, text_column=text_column), "fingerprints")
    nodes, _ = write_table(rows.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    roots, _ = write_table(connected_components(links(nodes.select(F.col("node").alias("fingerprint")), max_bits=max_bits)), "roots")
    told = _component_ids(nodes, roots).withColumnRenamed("node", "fingerprint")
    out = rows.join(told, "fingerprint", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of ``nodes`` (node, least): a component's smallest id, or a node's own without links."""
    linked = nodes.join(roots, "node")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    told = of_root(linked.select("node", "root"), smallest).select("node", F.lit(True).alias("linked"), "smallest")
    return nodes.join(told, "node", "left").select("node", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))


WIDE = 8  # 64-bit parts of a wide fingerprint
_CROWD = 16  # a deal's pairs are sent on up to so many members; beyond, its members' shingles come to the deal


def shingle_values(text: bytes, shingle_words: int) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, ascending; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[shingle_words - 1 :] - 1 if len(words) >= shingle_words else ends[-1:] - 1
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), U, n))


def wide_fingerprint(values: np.ndarray) -> np.ndarray:
    """A SimHash of 512 bits over distinct shingles; the parts come from mixing each one's XXH64 again."""
    n, out = len(values), np.zeros(WIDE, U)
    for k in range(WIDE if n else 0):
        part, count = mix(values + U(k * 0x9E3779B97F4A7C15 % (1 << 64))), np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):
            count += np.unpackbits(part[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")
    return out


def _table_masks(tables: int, bits: int) -> list[list[int]]:
    """For each table, masks of the parts that select ``bits`` of all bits; the choice follows from a fixed seed."""
    rng, out = np.random.default_rng(5), []
    for _ in range(tables):
        masks = [0] * WIDE
        for b in rng.choice(64 * WIDE, bits, replace=False).tolist():
            masks[b // 64] |= 1 << (b % 64)
        out.append(masks)
    return out


def _nearest(batches: Iterator[pa.RecordBatch], limit: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, node, f0) come sorted by deal. For each member of a deal the nearest of up to ``cap`` before it, if
    the pivots and the first part let the pair pass: few pairs, which join most of what belongs together."""
    for b in batches:
        deals, nodes, bits = b.column("deal").to_numpy(), b.column("node").to_numpy(), b.column("f0").to_numpy().view(U)
        best, to = np.full(len(deals), limit + 1, np.int64), np.zeros(len(deals), np.int64)
        for lag in range(1, min(cap, len(deals))):
            right = np.flatnonzero(deals[lag:] == deals[:-lag]) + lag
            if not len(right):
                break
            far = np.bitwise_count(bits[right] ^ bits[right - lag]).astype(np.int64)
            nearer = far < best[right]
            best[right[nearer]], to[right[nearer]] = far[nearer], nodes[right[nearer] - lag]
        at = np.flatnonzero(best <= limit)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(to[at], nodes[at])), pa.array(np.maximum(to[at], nodes[at]))], ["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch], limit: int, cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, node, f0, root) come sorted by deal. Pairs (a, b, null, null) of different roots, of a deal of up to
    ``cap`` members, that the pivots and the first part let pass; (a, null, deal, root) for every member of a larger one."""
    held = [np.zeros(0, np.int64)] * 4  # the deal that the last batch ended in: all of it, or of a larger one cap + 1
    told = False  # whether the held members have been told as a crowd's

    def pairs(deals, nodes, values, roots):
        head = np.flatnonzero(np.concatenate(([True], deals[1:] != deals[:-1])))
        size = np.diff(np.append(head, len(deals)))
        run = np.repeat(np.arange(len(head)), size)
        small = size[run] <= cap
        bits = values.view(U)
        table = np.bitwise_count(bits[:, None] ^ PIVOTS).astype(np.int8)
        found = []
        for lag in range(1, cap):
            right = np.arange(lag, len(deals))
            right = right[(run[right] == run[right - lag]) & small[right]]
            if not len(right):
                break
            right = right[roots[right] != roots[right - lag]]
            right = right[np.abs(table[right] - table[right - lag]).max(axis=1, initial=0) <= limit]
            right = right[np.bitwise_count(bits[right] ^ bits[right - lag]) <= limit]
            found.append((nodes[right - lag], nodes[right]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return a, b, ~small

    def batch(a, b, member, deal, root):
        blank = lambda n: pa.nulls(n, pa.int64())
        columns = [pa.concat_arrays([pa.array(x), y]) for x, y in ((a, pa.array(member)), (b, blank(len(member))))]
        columns += [pa.concat_arrays([blank(len(a)), pa.array(x)]) for x in (deal, root)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "deal", "root"])

    none = np.zeros(0, np.int64)
    for b in batches:
        old = len(held[0]) if told else 0
        deals, nodes, values, roots = (np.concatenate((h, b.column(c).to_numpy())) for h, c in zip(held, ("deal", "node", "f0", "root"), strict=True))
        if not len(deals):
            continue
        last = int(np.append(-1, np.flatnonzero(deals != deals[-1]))[-1]) + 1
        open_crowd = len(deals) - last > cap
        end = len(deals) if open_crowd else last
        left, right, crowd = pairs(deals[:end], nodes[:end], values[:end], roots[:end]) if end else (none, none, np.zeros(0, bool))
        at = np.flatnonzero(crowd)
        at = at[at >= old]
        yield batch(left, right, nodes[at], deals[at], roots[at])
        told = open_crowd
        held = [x[last : last + cap + 1].copy() if open_crowd else x[last:].copy() for x in (deals, nodes, values, roots)]
    if len(held[0]) and not told:
        left, right, _ = pairs(*held)
        yield batch(left, right, none, none, none)


def shared_values(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two ascending arrays of distinct values share."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def crowd_links(bits: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, limit: int, similarity: float) -> list[tuple[int, int]]:
    """Index pairs of that similarity that join all members connected by such pairs within ``limit`` bits.

    Each member meets all before it, the nearest first; only pairs of one group already, to begin with of one root, are
    left out, so the groups are those of all pairs while the links are fewer than the members.
    """
    n, out = len(sets), []
    size = np.array([len(x) for x in sets])
    group = np.unique(roots, return_inverse=True)[1]
    for i in range(1, n):
        far = np.bitwise_count(bits[:i] ^ bits[i]).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero((group[:i] != group[i]) & (far <= limit) & (np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i])))
        for j in at[np.argsort(far[at], kind="stable")].tolist():
            if group[i] == group[j]:
                continue
            both = shared_values(sets[i], sets[j])
            if both / max(1, size[i] + size[j] - both) >= similarity:
                out.append((j, i))
                group[group == group[i]] = group[j]
    return out


def _crowds(batches: Iterator[pa.RecordBatch], limit: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (deal, node, root, f0 ..., shingles) come sorted by deal; links (a, b) of each deal's members."""
    key, nodes, roots, bits, sets = None, [], [], [], []

    def close():
        found = crowd_links(np.array(bits, U).reshape(-1, WIDE), sets, np.array(roots), limit, similarity)
        made = [np.array([nodes[pair[k]] for pair in found], np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])

    for b in batches:
        deals, prints = b.column("deal").to_pylist(), np.stack([b.column(f"f{k}").to_numpy() for k in range(WIDE)], axis=1).view(U)
        lists, own, groups = b.column("shingles"), b.column("node").to_pylist(), b.column("root").to_pylist()
        for k, deal in enumerate(deals):
            if deal != key:
                if nodes:
                    yield close()
                key, nodes, roots, bits, sets = deal, [], [], [], []
            nodes.append(own[k])
            roots.append(groups[k])
            bits.append(prints[k])
            sets.append(lists[k].values.to_numpy().view(U).copy())
    if nodes:
        yield close()


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest id of the row's group, see _groups()."""
    used = docs.select(*[F.col(f"`{settings.get(k, d)}`") for k, d in (("id_column", "doc_id"), ("text_column", "text"))])
    prints, nodes, roots = _groups(used, **settings)
    told = _component_ids(nodes.select("node", F.col("first.doc_id").alias("least")), roots)
    return prints.select("doc_id", "node").join(told, "node", "left").select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group of near duplicates, with all of its columns: the one of smallest id, see _groups().

    Rows count one by one, whatever their ids: of equal rows, and of rows with equal ids in one group, one stays; rows
    of equal id in different groups all stay; a row with a null id stays only in a group without ids. Texts without
    words are one group. An empty table gives no rows.
    """
    prints, nodes, roots = _groups(docs, **settings)
    placed = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stays = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    text, kinds = settings.get("text_column", "text"), dict(docs.dtypes)
    own = lambda c: F.col("text").cast(kinds[c]) if c == text else F.col(f"rest.`{c}`")
    return prints.join(stays, "row", "left_semi").select(*[own(c).alias(c) for c in docs.columns])


def _groups(docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8, tables: int = 96, first_tables: int = 8, table_bits: int = 20, crowd: int = _CROWD, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, nodes and (node, root) of texts grouped by a similarity of ``similarity`` of their word shingles.

    Two rows link if the Jaccard similarity of their sets of distinct shingles is ``similarity`` or more, and groups
    are what links connect. Candidates come from fingerprints: sets of similarity s differ in a share
    acos(2s / (1 + s)) / pi of 512 bits at most, and fingerprints that agree on all bits of one of the tables' samples
    meet; a pair beyond the expected share by four standard deviations is left out, every other one is decided by the
    sets themselves. First each text meets the nearest of its deal in ``first_tables`` tables; what these links join is
    one group from then on, and only pairs of different groups are looked at further, so a large group of copies costs
    a few pairs for each member. A pair meets with probability 1 - (1 - (1 - share) ** table_bits) ** tables: 0.97 at a
    similarity of 0.8, 0.998 at 0.85. The members of a deal of over ``crowd`` all meet as well, in one task that their
    sets come to and that sends on only the links which join them. Nulls, ties and empty tables are treated as by
    simhash_components().
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    spread = np.sqrt(share * (1 - share))
    limit = int(64 * WIDE * share + 4 * 8 * np.sqrt(WIDE) * spread)
    first_limit = int(64 * share + 4 * 8 * spread)
    parts = [f"f{k}" for k in range(WIDE)]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_buffers(b.column("text"))
            raw = data.tobytes()
            node, size, found = np.zeros(b.num_rows, U), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, WIDE), U)
            for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                values = shingle_values(raw[i:j], shingle_words)
                node[r], size[r], found[r] = xxhash.xxh64_intdigest(values.tobytes()), len(values), wide_fingerprint(values)
            columns = [pa.array(node.view(np.int64)), pa.array(size), *[pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(WIDE)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["doc_id", "text", "rest", "node", "size", *parts])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_buffers(b.column("text"))
            for i, j in slices(at):
                sets = [shingle_values(data[at[r] : at[r + 1]].tobytes(), shingle_words).view(np.int64) for r in range(i, j)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column])
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"), rest.alias("rest"))
    kinds = f"doc_id long, text string, rest {docs.select(rest.alias('r')).schema['r'].dataType.simpleString()}, node long, size long, "
    made = map_arrow(rows, compute, kinds + ", ".join(f"{p} long" for p in parts))
    prints, _ = write_table(made.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # a node is a set of shingles; one row's text stands for it, the one of smallest id, a null id being the largest
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes, _ = write_table(prints.groupBy("node", "size", *parts).agg(F.min(order).alias("first")), "nodes")
    n = partitions_for(nodes, 1 << 20)  # a node goes to as many deals as there are tables
    masks = _table_masks(tables, table_bits)
    deal = lambda t: F.xxhash64(F.lit(t), *[F.col(p).bitwiseAND(F.lit(_signed(m))) for p, m in zip(parts, masks[t], strict=True) if m])

    used: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the groups are there."""
        out, path = write_table(df, name)
        used.append(path)
        return out

    def dealt(of: DataFrame, numbers: range, *columns: str) -> DataFrame:
        each = of.where("size > 0").select("node", "f0", *columns, F.explode(F.array(*[deal(t) for t in numbers])).alias("deal"))
        return each.repartition(n, "deal").sortWithinPartitions("deal", "node")

    def alike(pairs: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs (a, b) of that similarity; and (node, shingles) of all nodes in pairs or in ``more`` (node)."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), *[F.col(p).alias(f"{x}_{p}") for p in parts])
        far = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in parts[1:]), F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))))
        near = (far <= limit) & (F.least("a_size", "b_size") >= F.lit(similarity) * F.greatest("a_size", "b_size"))
        close = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "a_size", "b_size")
        close = kept(close, "pairs")
        need = close.select(F.col("a").alias("node")).union(close.select("b")).union(more).distinct()
        chosen = nodes.join(need, "node", "left_semi").select(F.col("first.row").alias("row"))
        texts = prints.select("row", "node", "text").join(chosen, "row", "left_semi")
        sets = kept(map_arrow(texts.select("node", "text"), spell, "node long, shingles array<long>"), "shingles")
        own = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_shingles"))
        checked = close.join(own("a"), "a").join(own("b"), "b").withColumn("both", F.size(F.array_intersect("a_shingles", "b_shingles")))
        return checked.where(F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both")) >= F.lit(similarity)).select("a", "b"), sets

    none = nodes.select("node").where("false")
    first = map_arrow(dealt(nodes, range(min(first_tables, tables))), lambda b: _nearest(b, first_limit, crowd), "a long, b long")
    begun = kept(connected_components(alike(first, none)[0]), "roots")
    rooted = kept(nodes.join(begun, "node", "left").select("node", "size", *parts, F.coalesce("root", "node").alias("root")), "nodes")
    found = kept(map_arrow(dealt(rooted, range(tables), "root"), lambda b: _candidates(b, first_limit, crowd), "a long, b long, deal long, root long"), "candidates")
    crowded = found.where("b is null").select(F.col("a").alias("node"), "deal", "root")
    mixed = crowded.groupBy("deal").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("deal")
    crowded = kept(crowded.join(mixed, "deal", "left_semi"), "crowded")
    edges, sets = alike(found.where("b is not null").select("a", "b"), crowded.select("node"))
    members = crowded.join(nodes.select("node", *parts), "node").join(sets, "node").repartition(n, "deal").sortWithinPartitions("deal", "node")
    joined = map_arrow(members.select("deal", "node", "root", *parts, "shingles"), lambda b: _crowds(b, limit, similarity), "a long, b long")
    links_of = begun.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots, _ = write_table(connected_components(links_of.unionByName(edges).unionByName(joined)), "roots")
    for path in used:
        remove(prints.sparkSession, path)
    return prints, nodes, roots
