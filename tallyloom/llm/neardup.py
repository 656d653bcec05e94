"""Near-duplicates by ProbMinHash.

A text's five-word shingles, each weighted by 1 + the logarithm of how often
it occurs (so that one line repeated a thousand times doesn't stand for the
text), are sketched by ProbMinHash: every shingle is a Poisson process whose rate is its
weight; each arrival falls into one of the sketch's registers, and a register
keeps the shingle that arrives first. A shingle stops once its next arrival
is later than every register's first. Two sketches agree in a register with
the probability Jaccard similarity of the texts. A second sketch of the same
kind, with all weights 1, agrees with the Jaccard similarity of the shingle
sets; it is the first one wherever no shingle repeats. Bands of registers of
either sketch give candidate pairs, of which those are likely that agree often
enough in either; each such pair is verified on the shingles themselves.

Texts with the same words in the same order are copies: they form one class
from the start, and only classes are compared. In a band's bucket the classes
meet a pivot drawn by a hash of its own; links verified so join classes to
components. A bucket whose members are then in several components is compared
in full between components, so that no link between different texts is lost;
pairs within a component add nothing to it. Members outside the bucket's
largest component are its probes; probes and members meet in chunks of
bounded size. Where a probe has but few likely partners these are verified
as pairs; where it has many, it is compared on the shingles themselves within
the chunk, and only the best link to each component leaves the task.

Similarity: probability Jaccard of the weighted shingles or Jaccard of the
shingle sets, whichever is larger; both are 1 for copies.

Defined cases: a text of fewer than five words is one shingle; null texts and
texts without words are never duplicates; case, punctuation and spacing don't
count; repeated rows are copies; a null doc_id is a document, and a class of
such only has a null class_id. Extra columns are ignored (``near_classes``) or
kept (``drop_near_copies``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bytetext import mix64, shingles, utf8_buffers, words
from tallyloom.llm.graph import components
from tallyloom.session import Scratch, bound_arrow_batches

WIDTH = 5
THRESHOLD = 0.8
#: Registers of a sketch: bands times rows. A pair at the threshold is a candidate with chance 1 - (1 - 0.8^5)^20 > 0.9996.
BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
#: Candidates whose sketches agree in a smaller share aren't verified: nearly four standard errors below the threshold.
LIKELY = 0.65
#: Members and probes of a bucket that are compared at once, and likely partners that a probe brings as pairs.
CHUNK, PROBES, FEW = 256, 1024, 4
#: Bytes of text sketched at once (a longer text is taken whole).
SLICE = 3 << 20

_NO_ID = -(1 << 63)


def slices(offsets: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out


def weighed(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and occurrences of each distinct shingle, by row."""
    of, sh = shingles(hashes, row, rows, WIDTH)
    key = np.sort((of.astype(np.uint64) << np.uint64(48)) | sh)
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def sketch(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash sketches, 16 bits of the first shingle of each register; a row without shingles is all 0."""
    first = np.full(rows * registers, np.inf)
    owner = np.zeros(rows * registers, dtype=np.uint16)
    latest = np.full(rows, np.inf)
    clock, drawn, burst = np.zeros(len(row)), 0, 1
    while len(row):
        for at in range(0, len(row), 200_000 // burst + 1):
            part = slice(at, at + 200_000 // burst + 1)
            seed = mix64(shingle[part, None] + (np.arange(drawn, drawn + burst, dtype=np.uint64) << np.uint64(48))[None, :])
            gap = -np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[part, None]
            arrival = clock[part, None] + np.cumsum(gap, axis=1)
            clock[part] = arrival[:, -1]
            at_register = row[part, None] * registers + (mix64(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
            early = arrival < latest[row[part], None]
            slot, when = at_register[early], arrival[early]
            what = np.broadcast_to(shingle[part, None], arrival.shape)[early]
            np.minimum.at(first, slot, when)
            won = first[slot] == when
            owner[slot[won]] = (mix64(what[won]) & np.uint64(0xFFFF)).astype(np.uint16)
        latest = first.reshape(rows, registers).max(axis=1)
        on = clock < latest[row]
        row, shingle, weight, clock = row[on], shingle[on], weight[on], clock[on]
        drawn += burst
        burst = min(burst * 2, 128)
    return owner.reshape(rows, registers)


def text_keys(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each row's words in order, and their number."""
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(row)) - begin[row]
    terms = mix64(hashes + mix64(place.astype(np.uint64)))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return mix64(run[begin[1:]] - run[begin[:-1]] + count.astype(np.uint64)).view(np.int64), count


def pack_sketches(of: np.ndarray, sh: np.ndarray, seen: np.ndarray, rows: int) -> list[bytes]:
    """Each row's sketch by set, and after it the one by weights where a shingle repeats."""
    plain = sketch(of, sh, np.ones(len(of)), rows)
    more = np.zeros(rows, dtype=bool)
    more[of[seen > 1]] = True
    at, some = np.cumsum(more) - 1, more[of]
    weighted = sketch(at[of[some]], sh[some], 1 + np.log(seen[some]), int(more.sum()))
    return [x.tobytes() + (weighted[k].tobytes() if m else b"") for x, k, m in zip(plain, at, more, strict=True)]


def unpack_sketches(packed: list[bytes]) -> np.ndarray:
    """The registers of both sketches, by set and by weights, of each row."""
    return np.frombuffer(b"".join(x if len(x) == 4 * REGISTERS else x + x for x in packed), dtype=np.uint16).reshape(-1, 2 * REGISTERS)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of registers in which rows agree, by the sketch in which it is larger."""
    return (x == y).reshape(-1, 2, REGISTERS).mean(axis=2).max(axis=1)


def _sign(batches):
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(2))
        for lo, hi in slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            hashes, row, _, _ = words(part, at)
            key, count = text_keys(hashes, row, hi - lo)
            of, sh, seen = weighed(hashes, row, hi - lo)
            some = pa.array(count == 0)
            packed = pa.array(pack_sketches(of, sh, seen, hi - lo), pa.binary())
            node = pa.array(key, mask=np.asarray(some))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), batch.column(3).slice(lo, hi - lo), node, packed], names=["d", "th", "rh", "node", "sketch"])


def sign(docs: DataFrame, row_hash: bool = False) -> DataFrame:
    """A row for each document: d (its id), th and rh (hashes of its text and row), node (its class of copies; null without words) and its sketches."""
    text = F.col("text").cast("string")
    # The text's hash tells rows of the same id apart; the row's also counts the other columns.
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]) if row_hash else F.lit(0).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), row.alias("rh"))
    return keyed.mapInArrow(_sign, "d long, th long, rh long, node long, sketch binary")


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A key of each band of both sketches: those by set, then those by weights, the same where the registers are."""
    parts = drawn.reshape(-1, 2, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:3], dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key + parts[:, :, :, k] + np.uint64(1))
    return mix64(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64).reshape(-1, 2 * BANDS)


def _bands(batches):
    for batch in batches:
        key = band_keys(unpack_sketches(batch.column(1).to_pylist()))
        once = np.ones(key.shape, dtype=bool)
        once[:, BANDS:] = key[:, BANDS:] != key[:, :BANDS]
        yield pa.RecordBatch.from_arrays([pa.array(key[once]), pa.array(np.repeat(batch.column(0).to_numpy(), once.sum(axis=1)))], names=["band", "node"])


def _agreement(batches):
    """Keeps the pairs whose sketches agree often enough, and by how much."""
    for batch in batches:
        if batch.num_rows:
            share = agreement(*(unpack_sketches(batch.column(k).to_pylist()) for k in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= LIKELY))


def _pack(batches):
    """Shingles of each text whose class is the one asked for, the occurrences in the upper 16 bits."""
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(1))
        asked = batch.column(0).to_numpy()
        for lo, hi in slices(offsets):
            hashes, row, _, _ = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            key, _ = text_keys(hashes, row, hi - lo)
            of, sh, count = weighed(hashes, row, hi - lo)
            packed = sh | (np.minimum(count, 65535).astype(np.uint64) << np.uint64(48))
            cuts = np.searchsorted(of, np.arange(hi - lo + 1))
            sets = [packed[cuts[i] : cuts[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sets, pa.binary())], names=["node", "set"]).filter(pa.array(key == asked[lo:hi]))


def similarity(x: bytes, y: bytes) -> float:
    """The larger of set Jaccard and probability Jaccard of two packed shingle sets."""
    low = np.uint64((1 << 48) - 1)
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    sa, sb = a & low, b & low
    common, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    both = len(common)
    union = len(sa) + len(sb) - both
    plain = both / union if union else 0.0
    if plain >= THRESHOLD or not both:
        return plain
    wa, wb = (1 + np.log((x >> np.uint64(48)).astype(float)) for x in (a, b))
    # For each common shingle d: the sum over all e of max(a_e / a_d, b_e / b_d); e counts by a where b_e / a_e <= b_d / a_d.
    ratio = wb[ib] / wa[ia]
    order = np.argsort(ratio, kind="stable")
    r, ca, cb = ratio[order], wa[ia][order], wb[ib][order]
    upto = np.searchsorted(r, r, side="right")
    sum_a = np.concatenate(([0.0], np.cumsum(ca)))[upto] + wa.sum() - wa[ia].sum()
    sum_b = cb.sum() - np.concatenate(([0.0], np.cumsum(cb)))[upto] + wb.sum() - wb[ib].sum()
    return max(plain, float((1.0 / (sum_a / ca + sum_b / cb)).sum()))


def _verify(batches):
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        like = [similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        hit = [i for i, s in enumerate(like) if s >= THRESHOLD]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()), pa.array([b[i] for i in hit], pa.int64()), pa.array([like[i] for i in hit], pa.float64())], names=["a", "b", "similarity"])


def _groups(batches, width: int):
    """Whole groups of rows that come sorted by their first three columns, as arrays; binary columns as lists."""

    def columns(batch):
        return [batch.column(k).to_numpy() for k in range(6)] + [np.array(batch.column(k).to_pylist(), dtype=object) for k in range(6, width)]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key = np.stack(cols[:3])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for s, e in zip(edges, edges[1:], strict=False):
            yield [c[s:e] for c in cols]
        held = [c[edges[-1] :] for c in cols]
    if held is not None:
        yield held


def _likely_partners(drawn: np.ndarray, label: np.ndarray, probe: np.ndarray, members: np.ndarray, band: np.ndarray, band_keys: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which members of other components a probe should meet here: likely ones that share no earlier band with it."""
    share = agreement(drawn[members], drawn[probe])
    same = band_keys[members] == band_keys[probe]
    first = band_keys[probe][same.argmax(axis=1)] == band
    return members[(share >= LIKELY) & first & same.any(axis=1) & (label[members] != label[probe]) & (node[members] != node[probe])]


def _grid(group: list[np.ndarray]):
    """A group's sketches, band keys, probes and members. Columns: band, cm, cp, role, node, label, sketch."""
    drawn = unpack_sketches(group[6])
    probes, members = np.flatnonzero(group[3] == 1), np.flatnonzero(group[3] == 0)
    return drawn, band_keys(drawn), probes, members


def _cross(batches):
    """(band, probe, other): the likely pairs of probes with few; for those with more, the probe alone."""
    for group in _groups(batches, 7):
        drawn, keys, probes, members = _grid(group)
        node, label = group[4], group[5]
        band, one, two = [], [], []
        for p in probes:
            found = _likely_partners(drawn, label, p, members, group[0][0], keys, node)
            if not len(found):
                continue
            others = node[found].tolist() if len(found) <= FEW else [None]
            band += [int(group[0][0])] * len(others)
            one += [int(node[p])] * len(others)
            two += others
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (band, one, two)], names=["band", "probe", "other"])


def _compare(batches):
    """Verified links of probes to members of other components, the best for each component; column 7 has the shingles."""
    low = np.uint64((1 << 48) - 1)
    for group in _groups(batches, 8):
        drawn, keys, probes, members = _grid(group)
        node, label, sets = group[4], group[5], [np.frombuffer(x, np.uint64) for x in group[7]]
        plain = [x & low for x in sets]
        once = np.array([not (x >> np.uint64(48) > 1).any() for x in sets])
        size = np.array([len(x) for x in sets])
        every = np.concatenate([plain[m] for m in members]) if len(members) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), size[members])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out = []
        for p in probes:
            found = _likely_partners(drawn, label, p, members, group[0][0], keys, node)
            if not len(found):
                continue
            lo, hi = np.searchsorted(every, plain[p], side="left"), np.searchsorted(every, plain[p], side="right")
            runs = hi - lo
            hits = owner[np.repeat(lo, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)]
            common = np.bincount(hits, minlength=len(members))[np.searchsorted(members, found)]
            like = common / (size[found] + size[p] - common)
            best: dict[int, tuple[float, int]] = {}
            for m, s in zip(found.tolist(), like.tolist(), strict=True):
                if s < THRESHOLD and not (once[m] and once[p]):
                    s = similarity(group[7][m], group[7][p])
                if s >= THRESHOLD:
                    best[int(label[m])] = max(best.get(int(label[m]), (0.0, 0)), (s, int(node[m])))
            out += [(min(int(node[p]), m), max(int(node[p]), m), s) for s, m in best.values()]
        if out:
            a, b, like = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], names=["a", "b", "similarity"])


def _chunks(rows: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Rows (band, node, label, n) of mixed buckets dealt into chunks: band, cm, cp, role, node, label.

    Each of a bucket's members (role 0) goes to every chunk of probes, each
    probe (role 1) to every chunk of members. Probes are the members outside
    the largest component. ``busy``: band and node of those whose links are
    still to be found: other probes needn't ask, unless a busy one is in what
    is now the largest component, to which all others then put the question.
    """
    by_label = rows.groupBy("band", "label").agg(F.count("*").alias("own"))
    mixed = by_label.groupBy("band").agg(F.sum("own").alias("members"), F.max(F.struct("own", "label")).alias("main")).filter(F.col("members") > F.col("main.own"))
    mixed = mixed.select("band", "members", F.col("main.label").alias("main"), (F.col("members") - F.col("main.own")).alias("probes"))
    known = rows.select("band", "node", "label").join(mixed, "band")
    known = known.withColumn("km", F.ceil(F.col("members") / CHUNK).cast("int")).withColumn("kp", F.ceil(F.col("probes") / PROBES).cast("int"))
    cm, cp = F.pmod(F.xxhash64("node", F.lit(1)), F.col("km")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("kp")).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = known.select("band", cm.alias("cm"), along("kp").alias("cp"), F.lit(0).alias("role"), "node", "label")
    asking = known.filter(F.col("label") != F.col("main"))
    if busy is not None:
        waiting = known.join(busy, ["band", "node"], "left_semi")
        settled = waiting.filter(F.col("label") == F.col("main")).select("band", F.lit(True).alias("__all")).distinct()
        own = busy.select("band", "node", F.lit(True).alias("__own"))
        asking = asking.join(own, ["band", "node"], "left").join(settled, "band", "left").filter("__own or __all").drop("__own", "__all")
    asking = asking.select("band", along("km").alias("cm"), cp.alias("cp"), F.lit(1).alias("role"), "node", "label")
    return members.unionByName(asking)


def near_links(docs: DataFrame, scratch: Scratch, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links between classes of copies (a, b, similarity), and the components they form (node, label)."""
    one = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("d", "th", "sketch")).alias("one"))
    nodes = scratch.table(one.select("node", "one.d", "one.th", "one.sketch"), "nodes")
    bands = scratch.table(nodes.select("node", "sketch").mapInArrow(_bands, "band long, node long"), "bands")
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "band"), F.col("node").alias("pivot"))).alias("first")).filter("n > 1")
    crowded = scratch.table(bands.join(buckets.select("band", "first.pivot"), "band").select("band", "node", "pivot"), "crowded")
    scratch.drop(bands)
    members = crowded.select("node").distinct()
    drawn = scratch.table(nodes.join(members, "node", "left_semi"), "drawn")

    # The shingles of the members, from one text each.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    packed = texts.join(drawn.select("node", "d", "th"), ["d", "th"]).select("node", "text").mapInArrow(_pack, "node long, set binary")
    sets = scratch.table(packed.groupBy("node").agg(F.first("set").alias("set")), "sets")
    sketches = drawn.select("node", "sketch")

    def sides(pairs, of, column):
        return pairs.join(of.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def verify(pairs):
        return scratch.table(sides(pairs, sets, "set").mapInArrow(_verify, "a long, b long, similarity double"), "links")

    # First each class's most similar pivot, which settles most.
    stars = crowded.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    likely = sides(stars, sketches, "sketch").mapInArrow(_agreement, "a long, b long, share double")
    ends = likely.select("a", "b", "share", F.explode(F.array("a", "b")).alias("node"))
    best = scratch.table(ends.groupBy("node").agg(F.max(F.struct("share", "a", "b")).alias("best")).select("best.a", "best.b").distinct(), "best")
    links = verify(best)
    labels = components(links, scratch)

    # Then all pairs of a bucket between components.
    def named(rows):
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def dealt(rows):
        return rows.repartition("band", "cm", "cp").sortWithinPartitions("band", "cm", "cp")

    grid = _chunks(named(crowded.select("band", "node"))).join(sketches, "node")
    crossed = scratch.table(dealt(grid.select("band", "cm", "cp", "role", "node", "label", "sketch")).mapInArrow(_cross, "band long, probe long, other long"), "crossed")
    fresh = crossed.filter("other is not null").select(F.least("probe", "other").alias("a"), F.greatest("probe", "other").alias("b")).distinct()
    links = scratch.table(links.unionByName(verify(fresh.join(best, ["a", "b"], "left_anti"))), "links")
    busy = crossed.filter("other is null").select("band", F.col("probe").alias("node")).distinct()
    if busy.limit(1).count():
        labels = components(links, scratch)
        there = crowded.join(busy.select("band").distinct(), "band", "left_semi").select("band", "node")
        grid = _chunks(named(there), busy).join(sketches, "node").join(sets, "node")
        compared = dealt(grid.select("band", "cm", "cp", "role", "node", "label", "sketch", "set")).mapInArrow(_compare, "a long, b long, similarity double")
        compared = compared.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
        links = scratch.table(links.unionByName(compared), "links")
    return links, components(links, scratch)


def _signed(docs: DataFrame, scratch: Scratch, row_hash: bool = False) -> DataFrame:
    bound_arrow_batches(docs.sparkSession)
    return scratch.table(sign(docs, row_hash), "signed")


def near_classes(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id among its near copies), the size of its class, and how many verified links of its text
    hold the class together (n_links; not every pair within a class is verified)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = _signed(docs, scratch)
    links, labels = near_links(docs, scratch, signed)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    own = signed.filter("node is not null").groupBy("node").agg(F.min(F.nullif(F.col("d"), F.lit(_NO_ID))).alias("least"), F.count("*").alias("copies"))
    own = own.join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = own.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = own.join(ids, "label").select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("d", "node").join(classes, "node", "left").withColumn("doc_id", F.nullif(F.col("d"), F.lit(_NO_ID)))
    return out.select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class with all its columns: the least doc_id (nulls last), on ties by hashes of text and row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    signed = _signed(docs, scratch, row_hash=True)
    _, labels = near_links(docs, scratch, signed)
    rows = signed.groupBy("node", "d", "th", "rh").agg(F.count("*").alias("rows"))
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chosen = named.filter("node is not null").groupBy("label").agg(F.min(F.struct(F.col("d") == _NO_ID, "d", "th", "rh", "rows")).alias("one")).select("one.d", "one.th", "one.rh", "one.rows")
    wordless = rows.filter("node is null").select("d", "th", "rh", F.lit(1).cast("long").alias("rows"))
    kept = scratch.table(chosen.unionByName(wordless), "kept").select(F.col("d").alias("__kept_d"), F.col("th").alias("__kept_th"), F.col("rh").alias("__kept_rh"), F.col("rows").alias("__kept_rows"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == kept["__kept_d"]) & (F.xxhash64(docs["text"].cast("string")) == kept["__kept_th"]) & (hashed == kept["__kept_rh"])
    found = docs.join(kept, on)
    columns = [docs[c] for c in docs.columns]
    out = found.filter("__kept_rows = 1").select(*columns)
    if kept.filter("__kept_rows > 1").limit(1).count():
        again = found.filter("__kept_rows > 1").dropDuplicates(["__kept_d", "__kept_th", "__kept_rh"]).select(*columns)
        out = out.unionByName(again)
    return out


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
