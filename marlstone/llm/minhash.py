"""Near-duplicates by MinHash with tensored banding, links verified on full sets.

A document is its set of distinct word shingles. Instead of a table for each
of many independent bands, there are two small collections of bands; a table's
key combines a band of one with a band of the other. m * m tables then cost
2 * m bands of hashes. A pair of similarity s shares a key unless it differs
in all bands of a collection: with 16 bands of 3 hashes in each, a pair at 0.8
is missed with a chance of about 2e-5, one at 0.3 is a candidate with 0.13.

1. Documents with equal sets are one class, and go on as their least id.
2. Bands that no other class has are dropped, then the keys of the rest are
   formed. Classes that share a key are candidates for one another: they are
   put together in groups by stars from each key's least class.
3. Within a group all links are verified on full sets. No pair leaves a task.
4. Groups of many documents, as around a passage that many share, are first
   split by the prefix filter: linked sets have a shingle in common among the
   rarest fifth of each. A group that is still large is worked on in blocks;
   members linked with its least member need not be compared among
   themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, written
from .components import by_key, connected, star_edges

MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles of ``size`` words."""

    def __init__(self, size: int = 4, remembered: int = 100_000):
        self.size, self.bound = size, remembered
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and white space of ASCII alone
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > self.bound:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            h = np.array([known[w] for w in words], np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = _mixed(out * MIX + h[j : len(h) - k + 1 + j])
        return np.unique(out)


def band_values(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, bands) values of both collections; each combines ``rows`` minima and its number."""
    rng = np.random.default_rng(20_240_229)
    n_hash = 2 * bands * rows
    mult = rng.integers(0, 2**63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n_hash, dtype=np.uint64)
    mins = np.zeros((n_hash, len(sets)), np.uint64)
    k = 0
    while k < len(sets):  # as many sets as stay in the processor's cache
        size, e = 0, k
        while e < len(sets) and (e == k or size + len(sets[e]) <= 16_384):
            size += len(sets[e])
            e += 1
        flat = np.concatenate(sets[k:e])
        at = np.cumsum([0] + [len(s) for s in sets[k : e - 1]])
        for j in range(n_hash):
            v = flat * mult[j] + add[j]
            mins[j, k:e] = np.minimum.reduceat(v ^ (v >> np.uint64(29)), at)
        k = e
    out = []
    for side in range(2):
        cols = []
        for b in range(bands):
            v = np.full(len(sets), np.uint64(side * bands + b + 1))
            for r in range(rows):
                v = _mixed(v * MIX + mins[(side * bands + b) * rows + r])
            cols.append(v)
        out.append(np.stack(cols, 1).view(np.int64) if sets else np.zeros((0, bands), np.int64))
    return out[0], out[1]


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(size)
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                sets = [shingler.hashes(t if isinstance(t, str) else None) for t in part["text"]]
                full = [s for s in sets if len(s)]
                left, right = band_values(full, bands, rows)
                at = iter(range(len(full)))
                pos = [next(at) if len(s) else None for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n": [len(s) for s in sets],
                        "cls": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "a": [left[p] if p is not None else None for p in pos],
                        "b": [right[p] if p is not None else None for p in pos],
                    }
                )

    return run


def _links(sets: list[np.ndarray], num: int, den: int, old: int | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) that span the components of sets with den * |both| >= num * |any|.

    ``old``: sets from this one on need no comparison among themselves.
    """
    n = len(sets)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1  # what one set alone has is in no intersection
    column = np.cumsum(counts > 1) - 1
    cols, own = column[inverse[keep]], owner[keep]
    order = np.argsort(cols, kind="stable")
    cols, own = cols[order], own[order]
    width = int((counts > 1).sum())
    top = n if old is None else old
    both = np.zeros((top, n), np.float32)
    for c in range(0, width, 4096):
        lo, hi = np.searchsorted(cols, [c, c + 4096])
        x = np.zeros((n, min(4096, width - c)), np.float32)
        x[own[lo:hi], cols[lo:hi] - c] = 1
        both += x[:top] @ x.T  # whole numbers below 2**24 are exact
    both = both.astype(np.int64)
    linked = den * both >= num * (sizes[:top, None] + sizes[None, :] - both)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in np.argwhere(linked):
        if i != j and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
            out.append((int(i), int(j)))
    return out


def _own_sets(b: pd.DataFrame, shingler: Shingler) -> tuple[list[int], list[np.ndarray]]:
    """Ids and sets of the rows whose set is that of their class, each once."""
    ids, sets, seen = [], [], set()
    for d, c, t in zip(b["doc_id"], b["cls"], b["text"]):
        if (d, bytes(c)) in seen:
            continue
        s = shingler.hashes(t if isinstance(t, str) else None)
        if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == bytes(c):
            seen.add((d, bytes(c)))
            ids.append(int(d))
            sets.append(s)
    return ids, sets


#: Rows up to which a table of candidates (some 60 bytes a row) is sent to all tasks rather than all texts to it.
BROADCAST_ROWS = 400_000


def with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members``, a written table or a part of one, with their documents' columns; texts of others don't move while members are few."""
    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(members) if few else members, "doc_id")


def near_duplicates(docs: DataFrame, *, batch_rows: int = 1000, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Sets are of ``size`` words; sets are linked if their intersection is at
    least similar[0] / similar[1] of their union. A text of fewer words is one
    shingle; one without words, or null, is linked with nothing. component_id
    is the least doc_id that links lead to; ``kept`` marks it. A row without
    doc_id has no component and is kept. Rows that repeat a doc_id are one
    document with the links of all its texts, and each gives a row. Further
    columns are ignored. ``batch_rows`` texts at most are in a worker's memory
    at once; options: see ``_components``.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    try:
        if int(before) <= 0 or int(before) > batch_rows:
            conf.set(name, str(batch_rows))
        return _components(docs, **options)  # all that reads texts has run when it returns
    finally:
        conf.set(name, before)


def _components(docs: DataFrame, *, size: int = 4, similar: tuple[int, int] = (80, 100), bands: int = 16, rows: int = 3, group_docs: int = 1024, group_shingles: int = 2_000_000, order_bits: int = 16) -> DataFrame:
    spark = docs.sparkSession
    num, den = similar
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed, _ = written(typed.mapInPandas(lean(_signed(size, bands, rows)), "doc_id long, n long, cls binary, a array<long>, b array<long>"))
    sets = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes, _ = written(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.count("*").alias("copies")))

    # Bands that some other class has too.
    values = classes.select("rep", F.posexplode(F.concat("a", "b")).alias("pos", "v"))
    shared = values.groupBy("v").agg(F.count("*").alias("__n")).where("__n > 1")
    mine = by_key(values, shared, "v", classes.count() * 2 * bands)
    mine = mine.groupBy("rep").agg(F.collect_list(F.when(F.col("pos") < bands, F.col("v"))).alias("a"), F.collect_list(F.when(F.col("pos") >= bands, F.col("v"))).alias("b"))
    keys = mine.select(F.col("rep").alias("node"), F.col("b").alias("b"), F.explode("a").alias("x")).select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    keys, key_path = written(keys)
    groups = connected(star_edges(keys))
    drop(spark, key_path)
    members = groups.join(classes.select(F.col("rep").alias("node"), "cls", "n"), "node").select(F.col("node").alias("doc_id"), F.col("component").alias("grp"), "cls", "n")
    members, member_path = written(members)

    def sized(m: DataFrame) -> DataFrame:
        total = m.groupBy("grp").agg(F.count("*").alias("__n"), F.sum("n").alias("g_n")).withColumn("g_docs", F.col("__n"))
        return by_key(m, total, "grp", m.count()).withColumn("large", (F.col("g_docs") > group_docs) | (F.col("g_n") > group_shingles))

    edge = "u long, v long"

    def within(m: DataFrame) -> DataFrame:
        """Edges that span the components of each group, found in one task."""

        def run(b: pd.DataFrame) -> pd.DataFrame:
            ids, found = _own_sets(b, Shingler(size))
            return pd.DataFrame([(ids[i], ids[j]) for i, j in _links(found, num, den)], columns=["u", "v"])

        return with_texts(m, typed).select("grp", "doc_id", "cls", "text").groupBy("grp").applyInPandas(run, edge)

    first = sized(members)
    small, small_path = written(first.where("NOT large").select("doc_id", "cls", "grp"))
    found = within(small)
    hot, hot_path = written(first.where("large").select("doc_id", "cls", "n", "grp"))
    used = [member_path, small_path, hot_path]
    if not hot.isEmpty():
        more, paths = _large(hot, typed, sized, within, size, num, den, group_docs, group_shingles, order_bits)
        found, used = found.unionByName(more), used + paths
    # Rows that repeat an id with another text: one document.
    texts_of = sets.select("doc_id", "cls").distinct()
    several = texts_of.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again, again_path = written(texts_of.join(several, "doc_id", "left_semi").join(classes.select("cls", "rep"), "cls").select(F.col("doc_id").alias("key"), F.col("rep").alias("node")))
    edges, edge_path = written(found.unionByName(star_edges(again)))
    joined = connected(edges)
    drop(spark, edge_path, again_path, *used)
    home = classes.select("cls", "rep", F.col("copies").alias("__n")).join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"), "__n")
    out = by_key(signed.select("doc_id", "n", "cls"), home, "cls", signed.count(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _large(hot: DataFrame, typed: DataFrame, sized, within, size: int, num: int, den: int, group_docs: int, group_shingles: int, order_bits: int) -> tuple[DataFrame, list[str]]:
    """Edges within groups too large for a task, and the scratch tables that they are read from."""
    spark = hot.sparkSession
    buckets = 1 << order_bits
    texts = with_texts(hot, typed).select("grp", "doc_id", "cls", "text")

    def counts(batches):
        shingler, total = Shingler(size), np.zeros(buckets, np.int64)
        for b in batches:
            for s in _own_sets(b, shingler)[1]:
                total += np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    # Any one order of shingles will do; this one puts rare ones first. Its table has a fixed size.
    order = np.zeros(buckets, np.int64)
    for r in texts.mapInPandas(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        order[r["bucket"]] = r["n"]
    shared = spark.sparkContext.broadcast(order)

    def prefixes(batches):
        shingler = Shingler(size)
        for b in batches:
            nodes, tokens = [], []
            for d, s in zip(*_own_sets(b, shingler)):
                p = len(s) - -(-len(s) * num // den) + 1
                rare = s[np.lexsort((s, shared.value[(s & np.uint64(buckets - 1)).astype(np.int64)]))[:p]]
                nodes.append(np.full(len(rare), d))
                tokens.append(rare.view(np.int64))
            yield pd.DataFrame({"node": np.concatenate(nodes) if nodes else np.zeros(0, np.int64), "key": np.concatenate(tokens) if tokens else np.zeros(0, np.int64)})

    tokens, path = written(texts.mapInPandas(prefixes, "node long, key long"))
    parts = connected(star_edges(tokens))
    drop(spark, path)
    again, again_path = written(sized(parts.join(hot.drop("grp"), F.col("node") == F.col("doc_id")).select("doc_id", F.col("component").alias("grp"), "cls", "n")))
    out = within(again.where("NOT large"))
    big = again.where("large")
    if big.isEmpty():
        return out, [again_path]
    # The group's least member against all others.
    leaders = with_texts(big.where("doc_id = grp"), typed).select("grp", F.col("cls").alias("l_cls"), F.col("text").alias("l_text")).dropDuplicates(["grp"])
    pairs = with_texts(big, typed).join(leaders, "grp").select("grp", "doc_id", "cls", "text", "l_text", "g_docs", "g_n")

    def tested(batches):
        shingler = Shingler(size)
        for b in batches:
            ok = []
            last, lead = None, None
            for d, g, t, lt in zip(b["doc_id"], b["grp"], b["text"], b["l_text"]):
                if lt != last:
                    last, lead = lt, shingler.hashes(lt)
                s = shingler.hashes(t)
                both = len(np.intersect1d(s, lead, assume_unique=True))
                ok.append(d == g or den * both >= num * (len(s) + len(lead) - both))
            yield pd.DataFrame({"grp": b["grp"], "doc_id": b["doc_id"], "cls": b["cls"], "text": b["text"], "g_docs": b["g_docs"], "g_n": b["g_n"], "ok": ok})

    marked, marked_path = written(pairs.mapInPandas(tested, "grp long, doc_id long, cls binary, text string, g_docs long, g_n long, ok boolean"))
    out = out.unionByName(marked.where("ok AND doc_id <> grp").select(F.col("grp").alias("u"), F.col("doc_id").alias("v")))
    n_blocks = F.greatest(F.ceil(F.col("g_docs") * 2 / group_docs), F.ceil(F.col("g_n") * 2 / group_shingles)).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), n_blocks).cast("int")
    every = F.sequence(F.lit(0), n_blocks - 1)
    placed = marked.withColumn("block", block).withColumn("every", every)
    # Blocks of members that are not linked with the least one meet all blocks; the others don't meet each other.
    loose = placed.where("NOT ok").select("grp", "doc_id", "cls", "text", "ok", F.explode(F.transform("every", lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.lit(False).alias("mixed")))).alias("p"))
    loose = loose.unionByName(placed.where("NOT ok").select("grp", "doc_id", "cls", "text", "ok", F.explode(F.transform("every", lambda k: F.struct(F.col("block").alias("i"), k.alias("j"), F.lit(True).alias("mixed")))).alias("p")))
    tied = placed.where("ok").select("grp", "doc_id", "cls", "text", "ok", F.explode(F.transform("every", lambda k: F.struct(k.alias("i"), F.col("block").alias("j"), F.lit(True).alias("mixed")))).alias("p"))

    def blocks(b: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(size)
        new, old = _own_sets(b[~b["ok"]], shingler), _own_sets(b[b["ok"]], shingler)
        ids = new[0] + old[0]
        edges = _links(new[1] + old[1], num, den, len(new[0])) if new[0] else []
        return pd.DataFrame([(ids[i], ids[j]) for i, j in edges], columns=["u", "v"])

    return out.unionByName(loose.unionByName(tied).groupBy("grp", "p").applyInPandas(lambda b: blocks(b), "u long, v long")), [again_path, marked_path]
