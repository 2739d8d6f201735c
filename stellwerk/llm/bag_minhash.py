"""MinHash near-dedup with BagMinHash signatures of the multiset of 5-word shingles.

Weights are the shingles' counts, discretised to the integers. For each shingle, every unit of
weight is the source of a Poisson process over (time, signature place). The processes are kept in a
hierarchy: one for the first unit, one for the second, one for units 3 and 4, one for 5 to 8, and so
on; a point of a wide one falls on one of its units and counts only if the shingle has that many. The
earliest point at each place is the signature. Two signatures agree at a place with a probability
equal to the weighted Jaccard similarity. Points later than any that can still be the earliest are
never generated, so most shingles cost one hash.

Documents whose words are the same form one class at once, and from there on only classes are looked at. Rows are
signed where they are read, each text once in a batch, however many copies the batch holds: to sign only one row of a
class would take a shuffle of all texts. Classes whose signatures agree on all rows of a band are candidates. All pairs of a small bucket are
compared. In a large bucket no pairs are made: all members are compared with its hub, the member that
shares most buckets with others (the text from which a family of copies was made, or the one next to
it). Links are joined into components, and rounds follow: in each bucket that still holds several
components, members outside the largest one become hubs (one, then 8, then 64, and so on) and are
compared with all members, in blocks of bounded size of which each text is shingled once. A hub has then
met the whole bucket and leaves it; the rounds end when no bucket holds two components, so no link within
a bucket is lost. Of the near pairs of a block only those that join components are written. Every
comparison is exact: the overlap of the shingle multisets of whole texts.

Defined results: null text counts as empty; texts without a word are one class and near nothing else;
a text of one to four words is one shingle; texts are told apart by their hash, never by their id:
rows with a null id are compared like all others but stand for a class only if it has no other id, and
of equal ids on texts of one class the one with the least hash stays; rows that repeat id and text are
the same document;
empty tables give empty results; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import TEXT_ROWS, first_of, hash_128, one_space, stored, text_of, unused
from stellwerk.llm.components import components
from stellwerk.llm.textarrays import U, Bytes, mixed, shingles, slices

BANDS, ROWS, WIDTH, THRESHOLD = 28, 5, 5, 0.8
#: Buckets of at most so many classes are compared in pairs; larger ones with hubs, each round with so many times more.
SMALL, HUBS_GROW = 24, 8
#: Mean sizes of the blocks in which hubs and members are compared.
BLOCK_TEXTS, BLOCK_BYTES = 512, 1 << 20


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((h >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _processes(doc: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The hierarchy's processes: document, seed, width, and how many of its units the shingle has."""
    parts, low, width = [], 0, 1
    while len(doc):
        parts.append((doc, mixed(key + U((low + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))), np.full(len(doc), width), np.minimum(count - low, width)))
        low, width = low + width, max(1, low + width)
        more = count > low
        doc, key, count = doc[more], key[more], count[more]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (doc, key, count, count)


def signatures(docs: int, doc: np.ndarray, key: np.ndarray, count: np.ndarray, places: int) -> np.ndarray:
    """BagMinHash of each document's multiset: 64-bit values by document and place; 0 where there is no shingle."""
    out = np.zeros((docs, places), dtype=U)
    weight = np.bincount(doc, weights=count, minlength=docs)
    limit = np.divide(places * (np.log(places) + 3.0), weight, out=np.zeros(docs), where=weight > 0)
    todo = weight > 0
    owner, seed, width, has = _processes(doc, key, count)
    while todo.any():
        on = todo[owner]
        best, name = _race(docs, owner[on], seed[on], width[on], has[on], limit, places)
        full = todo & np.isfinite(best).all(axis=1)
        out[full] = name[full]
        todo &= ~full
        limit = limit * 2
    return out


def _race(docs, owner, seed, width, has, limit, places):
    """The earliest point at each place, of all points up to each document's limit."""
    best, name = np.full(docs * places, np.inf), np.zeros(docs * places, dtype=U)
    time, step = np.zeros(len(owner)), 0
    while len(owner):
        step += 1
        h = mixed(seed + U(step * 0xA0761D6478BD642F & (2**64 - 1)))
        time = time - np.log(_uniform(h)) / width
        on = time <= limit[owner]
        owner, seed, width, has, time, h = owner[on], seed[on], width[on], has[on], time[on], h[on]
        where = mixed(h ^ U(0xE7037ED1A0B428DB))
        unit = ((where >> U(32)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
        hit = unit < has
        at = owner[hit] * places + (where[hit] & U(0xFFFFFFFF)).astype(np.int64) % places
        np.minimum.at(best, at, time[hit])
        first = time[hit] == best[at]
        name[at[first]] = h[hit][first]
    return best.reshape(docs, places), name.reshape(docs, places)


def _band_keys(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # each text is signed once, at its first row; the others take its keys
        nth: dict[bytes, int] = {}
        of_row = [nth.setdefault(h, len(nth)) for h in batch.column(1).to_pylist()]
        column, found = batch.column(batch.schema.get_field_index("norm")), []
        if len(nth) < len(of_row):
            column = column.take(pa.array(np.unique(of_row, return_index=True)[1]))
        for a, b in slices(column, BLOCK_BYTES):
            text = Bytes(column.slice(a, b - a))
            sig = signatures(text.docs, *shingles(text, width), bands * rows)
            keys = np.zeros((text.docs, bands), dtype=U)
            for r in range(rows):
                keys = mixed(keys + sig.reshape(text.docs, bands, rows)[:, :, r])
            keys = mixed(keys + np.arange(bands, dtype=U)[None, :]).view(np.int64)
            empty = ~sig.any(axis=1)
            found.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]), pa.int32()), pa.array(keys[~empty].ravel())))
        if found:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.concat_arrays(found).take(pa.array(of_row, pa.int64()))], names=["doc_id", "hash", "bands"])


def weighted_jaccard(left: pa.Array, right: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Of the shingle multisets of each two texts."""
    n = len(left)
    a, b = shingles(Bytes(left), width), shingles(Bytes(right), width)
    doc = np.concatenate([a[0], b[0]])
    key = np.concatenate([a[1], b[1]])
    count = np.concatenate([a[2], b[2]])
    order = np.lexsort((key, doc))
    doc, key, count = doc[order], key[order], count[order]
    pair = np.flatnonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1])) if len(doc) else np.zeros(0, np.int64)
    shared = np.bincount(doc[pair], weights=np.minimum(count[pair], count[pair + 1]), minlength=n) if len(pair) else np.zeros(n)
    total = np.bincount(doc, weights=count, minlength=n) if len(doc) else np.zeros(n)
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = batch.columns
        for i, j in slices(right, BLOCK_BYTES, left):
            near = weighted_jaccard(left.slice(i, j - i), right.slice(i, j - i), width) >= threshold - 1e-12
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([a.slice(i, j - i).filter(keep), b.slice(i, j - i).filter(keep)], names=["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts are near."""
    left, right = (texts.select(F.col("id").alias(f"{x}_id"), F.col("norm").alias(f"{x}_norm")) for x in "lr")
    found = pairs.join(right, F.col("b") == F.col("r_id")).join(left, F.col("a") == F.col("l_id")).select("a", "b", "l_norm", "r_norm")
    return stored(found.mapInArrow(lambda it: _verify(it, width, threshold), "a long, b long"), "links", TEXT_ROWS)


def node_of(text_hash: Column) -> Column:
    """A text as a node of the graph: 64 bits made from its 128-bit hash; two of n texts share one with a chance of about n**2 / 2**65."""
    return F.xxhash64(text_hash)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, hash (of the words), rep_id (least id with the same words), cluster_id (least id of the class), kept for each row.

    kept: whether the row has the words and the id by which its class stays.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.trim(one_space(text_of(text_col))).alias("norm")).withColumn("hash", hash_128(F.col("norm")))
    signed = stored(
        source.select("doc_id", "hash", "norm").mapInArrow(lambda it: _band_keys(it, width, bands, rows), "doc_id long, hash binary, bands array<long>"),
        "signatures",
        TEXT_ROWS,
    )
    #: The keys of a class are alike in all its rows; as numbers, not as an array, they are aggregated by hash.
    each = [F.min(F.get(F.col("bands"), F.lit(b))).alias(f"band_{b}") for b in range(bands)]
    reps = signed.groupBy("hash").agg(F.min("doc_id").alias("rep_id"), *each).withColumn("id", node_of(F.col("hash")))
    reps = stored(reps.select("id", "hash", "rep_id", F.array(*[f"band_{b}" for b in range(bands)]).alias("bands")), "classes")
    spread = reps.select("id", F.explode("bands").alias("bucket")).filter("bucket is not null")
    full = spread.groupBy(F.col("bucket").alias("f_bucket")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(spread.join(full, F.col("bucket") == F.col("f_bucket")).select("bucket", "id", "n"), "buckets")
    wanted = members.select(F.col("id").alias("m_id")).distinct()
    #: One row of each wanted text: those with its least id, of which one is taken.
    texts = stored(
        source.select("doc_id", "hash", "norm")
        .join(reps.join(wanted, F.col("id") == F.col("m_id"), "left_semi").select("id", F.col("rep_id").alias("w_id"), F.col("hash").alias("w_hash")),
              (F.col("hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
        .groupBy("id").agg(F.first("norm").alias("norm")).withColumn("size", F.octet_length("norm").cast("long")),
        "texts",
    )
    found = _classes(members, texts, width, threshold)
    placed = stored(reps.select("hash", "rep_id", "id").join(found, F.col("id") == F.col("node")).select("hash", "rep_id", "component"), "placed")
    first = placed.groupBy(F.col("component").alias("f_component")).agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "hash")).alias("f"))
    placed = placed.join(first, F.col("component") == F.col("f_component")).select(F.col("hash").alias("p_hash"), F.col("f.rep_id").alias("least"), F.col("f.hash").alias("stays"))
    labels = reps.select(F.col("hash").alias("c_hash"), "rep_id").join(placed, F.col("c_hash") == F.col("p_hash"), "left")
    linked = F.col("p_hash").isNotNull()
    labels = labels.select("c_hash", "rep_id", F.when(linked, F.col("least")).otherwise(F.col("rep_id")).alias("cluster_id"), (~linked | (F.col("stays") == F.col("c_hash"))).alias("first"))
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    return signed.select("doc_id", "hash").join(labels, F.col("hash") == F.col("c_hash")).select("doc_id", "hash", "rep_id", "cluster_id", kept.alias("kept"))


def _classes(members: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """node, component of the classes that have links."""
    small = members.filter(F.col("n") <= SMALL)
    other = small.select(F.col("bucket").alias("o_bucket"), F.col("id").alias("o_id"))
    within = small.join(other, (F.col("bucket") == F.col("o_bucket")) & (F.col("id") < F.col("o_id"))).select(F.col("id").alias("a"), F.col("o_id").alias("b"))
    rank = members.groupBy(F.col("id").alias("r_id")).agg(F.sum("n").alias("rank")).join(texts.select(F.col("id").alias("s_id"), "size"), F.col("r_id") == F.col("s_id"))
    left = stored(members.filter(F.col("n") > SMALL).join(rank, F.col("id") == F.col("r_id")).select("bucket", "id", "rank", "size"), "large-buckets")
    first = left.groupBy(F.col("bucket").alias("h_bucket")).agg(F.max(F.struct("rank", "id"))["id"].alias("h_id"))
    with_first = left.join(first, (F.col("bucket") == F.col("h_bucket")) & (F.col("id") != F.col("h_id"))).select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b"))
    found = components(_linked(stored(within.unionByName(with_first).distinct(), "tested"), texts, width, threshold))
    now = F.coalesce("component", "id").alias("component")
    left = stored(left.join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", "rank", "size", now), "placed")
    hubs = first.select(F.col("h_bucket").alias("bucket"), F.col("h_id").alias("id")).join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", now)
    joined, links, hubs_each = None, None, 1
    while not (left := stored(_open(left, hubs, links), "open")).isEmpty():
        nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("rank"), "id"))
        hubs = stored(left.filter("component != main").withColumn("nth", nth).filter(F.col("nth") <= hubs_each).select("bucket", "id", "component", "size"), "hubs")
        links = _hub_links(hubs, left.select("bucket", "id", "component", "size"), texts, width, threshold)
        joined = links if joined is None else joined.unionByName(links)
        hubs_each *= HUBS_GROW
    if joined is None:
        return found
    #: The links of the rounds join components; the nodes are told once, at the end. A text without a link before is its own component.
    merged = components(joined)
    alone = merged.join(found.select(F.col("node").alias("f_node")), F.col("node") == F.col("f_node"), "left_anti")
    return _relabelled(found, merged).unionByName(alone)


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with the components that theirs are part of now."""
    by = merged.select(F.col("node").alias("g_node"), F.col("component").alias("g_component"))
    return rows.join(by, F.col("component") == F.col("g_node"), "left").withColumn("component", F.coalesce("g_component", "component")).drop("g_node", "g_component")


def _hub_links(hubs: DataFrame, members: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of the components of the hubs and of the members of their buckets that near texts join, compared block by block."""
    sides = []
    for name, rows in (("h", hubs), ("m", members)):
        sizes = rows.groupBy(F.col("bucket").alias(f"{name}_bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias(f"{name}_blocks")
        rows = rows.drop("size").join(texts.select(F.col("id").alias("t_id"), "norm"), F.col("id") == F.col("t_id"))
        sides.append((rows, stored(sizes.select(f"{name}_bucket", blocks), "blocks")))
    (h_rows, h_blocks), (m_rows, m_blocks) = sides
    blocks = h_blocks.join(m_blocks, F.col("h_bucket") == F.col("m_bucket")).drop("m_bucket")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    both = h_rows.join(blocks, F.col("bucket") == F.col("h_bucket")).select("bucket", own("h_blocks").alias("h"), numbers("m_blocks").alias("m"), "id", "component", "norm", F.lit(True).alias("hub"))
    both = both.unionByName(m_rows.join(blocks, F.col("bucket") == F.col("h_bucket")).select("bucket", numbers("h_blocks").alias("h"), own("m_blocks").alias("m"), "id", "component", "norm", F.lit(False).alias("hub")))
    return stored(both.groupBy("bucket", "h", "m").applyInArrow(lambda t: _block_links(t, width, threshold), "a long, b long").distinct(), "links", TEXT_ROWS)


def _block_links(block: pa.Table, width: int, threshold: float) -> pa.Table:
    """The pairs of components that near pairs of a hub and a member of one block join, as many as it takes (a spanning forest)."""
    hub = block["hub"].to_numpy()
    names = block["component"].to_numpy()
    _, group = np.unique(names, return_inverse=True)
    out: list[tuple[int, int]] = []
    if hub.any() and not hub.all():
        text = Bytes(block["norm"].combine_chunks())
        doc, key, count = shingles(text, width)
        _, code = np.unique(key, return_inverse=True)
        total = np.bincount(doc, weights=count, minlength=text.docs)
        start = np.searchsorted(doc, np.arange(text.docs + 1))
        of_member = ~hub[doc]
        m_doc, m_code, m_count = doc[of_member], code[of_member], count[of_member]
        weight = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=count.dtype)
        for h in np.flatnonzero(hub):
            span = slice(start[h], start[h + 1])
            weight[code[span]] = count[span]
            shared = np.bincount(m_doc, weights=np.minimum(m_count, weight[m_code]), minlength=text.docs)
            weight[code[span]] = 0
            near = ~hub & (shared >= (threshold - 1e-12) * (total + total[h] - shared)) & (shared > 0)
            for m in np.flatnonzero(near & (group != group[h])):
                if group[m] != group[h]:
                    out.append((min(names[h], names[m]), max(names[h], names[m])))
                    group[group == group[m]] = group[h]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _open(members: DataFrame, hubs: DataFrame, links: DataFrame | None) -> DataFrame:
    """The members, but for the hubs that have met all others, of the buckets in which two components or more are left, with main, the bucket's largest.

    links join components. They are told, and hubs taken off, in the few (bucket, component); only members of open buckets are read on.
    """
    met = hubs.groupBy(F.col("bucket").alias("g_bucket"), F.col("component").alias("g_was")).agg(F.count(F.lit(1)).alias("met"))
    parts = members.groupBy("bucket", F.col("component").alias("was")).agg(F.count(F.lit(1)).alias("all"))
    parts = parts.join(met, (F.col("bucket") == F.col("g_bucket")) & (F.col("was") == F.col("g_was")), "left").withColumn("n", F.col("all") - F.coalesce("met", F.lit(0))).filter("n > 0")
    parts = parts.select("bucket", "was", "n", F.col("was").alias("component"))
    parts = stored(parts if links is None else _relabelled(parts, components(links)), "parts")
    now = parts.groupBy(F.col("bucket").alias("m_bucket"), "component").agg(F.sum("n").alias("n"))
    main = now.groupBy("m_bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    by = parts.join(main, F.col("bucket") == F.col("m_bucket")).select("m_bucket", "was", F.col("component").alias("is"), "main")
    rows = members.drop("main").join(by, (F.col("bucket") == F.col("m_bucket")) & (F.col("component") == F.col("was")))
    rows = rows.select("bucket", "id", "rank", "size", F.col("is").alias("component"), "main")
    gone = hubs.select(F.col("bucket").alias("h_bucket"), F.col("id").alias("h_id"))
    return rows.join(gone, (F.col("bucket") == F.col("h_bucket")) & (F.col("id") == F.col("h_id")), "left_anti")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with the least id of each class, with all their columns; of repeated rows, one."""
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").select("doc_id", "hash").distinct()
    h, nth, k_id, k_hash = unused(docs, "h", "nth", "k_id", "k_hash")
    rows = docs.withColumn(h, hash_128(F.trim(one_space(text_of(text_col)))))
    rows = rows.join(kept.toDF(k_id, k_hash), (F.col(h) == F.col(k_hash)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(k_id)))
    return first_of(rows, [h, k_id], docs.columns, nth)
