"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents can only be similar if they share a number of shingles T that follows from their sizes. A document's
shingles are put in order of rarity and divided: the lists of the rare ones are short and are merged, the lists of the
frequent ones are skipped. The short lists are as many as it takes that similar documents meet in at least ``SHARED`` of
them; what meets there is probed, shingle by shingle in sorted arrays, for the rest of T. Shingles of one document need
no list. Documents with equal shingles are one entry of a list.

A list is not paired with itself. Its members stand in the order of their hashes, and in each round the first of them
are pivots that all later members are compared with, but for those that are by then linked with the pivot over any
documents. A list is done when all members behind its pivots are linked with each other. So a group of n copies costs
about n comparisons; rounds have one pivot a list, then ``MORE`` times as many each time, and no link between different
sets is lost. That gives components only: members that are linked by then are not compared, so links inside a component
are neither found nor counted. ``similar_pairs`` compares all members of the short lists and gives every link.

There are no heap merge and no probing of long lists: documents that meet in short lists come from a join on their rare
shingles, at least ``SHARED`` of them, and one whole sorted set is probed in the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise, scope
from .chunks import answered, bucket_count, by_bucket, chunk_table, deal, in_order, opened, pack, row_numbers, unpack
from .components import components
from .texts import NOT_BLANK, Slab, Words, mix, running, span_hash, window_hash

#: Short lists in which similar documents meet at least.
SHARED = 2
#: Longs of the bits that tell for parts of all hashes whether a set has an odd number of shingles there.
PARITY = 4
#: Ids of sets that are sent to all tasks at most: 32 MB.
BROADCAST_IDS = 4_000_000
#: Pivots of a list in a round, as a multiple of those in the round before.
MORE = 8
CHUNK = 4 << 20
QUESTION = "bucket int, chunk long, keys binary, counts binary"
SETS = "n_shingles long, n_alone long, set_id binary, row long, short array<long>, parity array<long>, shingles binary"


class Shingles:
    """The distinct shingles of a chunk's documents, by document and hash, and the chunk's distinct shingles."""

    def __init__(self, slab: Slab, size: int):
        found = []
        for _, part in slab.parts():
            words = part.words(NOT_BLANK)
            first, hashes = words.windows(size)
            short = np.flatnonzero((words.counts > 0) & (words.counts < size))
            whole = _whole(words, short)
            found.append((np.concatenate([hashes, whole]), np.concatenate([words.doc[first], short]) + part.first))
        hashes, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))[: len(hashes)]
        self.hash, self.doc = hashes[fresh], doc[fresh]
        self.first = np.searchsorted(self.doc, np.arange(slab.n + 1))
        self.distinct, self.number, self.times = np.unique(self.hash, return_inverse=True, return_counts=True)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the distinct shingles by bucket and key, where the buckets begin, keys of 32 bits."""
        order, cuts = deal(self.distinct, buckets)
        keys = (self.distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bucket = np.repeat(np.arange(buckets), np.diff(cuts))
        order = order[np.argsort((bucket << 32) | keys[order], kind="stable")]
        return order, cuts, keys

    def parity(self) -> np.ndarray:
        """PARITY longs for each document. Two sets differ in at least as many shingles as in bits."""
        bits = 64 * PARITY
        part = (self.hash >> np.uint64(32)).astype(np.int64) % bits
        odd = np.bincount(self.doc * bits + part, minlength=(len(self.first) - 1) * bits) & 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64).reshape(-1, PARITY)

    def set_ids(self) -> list[bytes]:
        """128 bits that are equal for equal sets."""
        size = np.diff(self.first).astype(np.uint64)
        halves = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(salt)))])
            halves.append(mix(upto[self.first[1:]] - upto[self.first[:-1]] + size * np.uint64(salt)))
        raw = np.stack(halves, axis=1).astype(">u8").tobytes()
        return [raw[16 * k : 16 * k + 16] for k in range(len(size))]


def _whole(words: Words, docs: np.ndarray) -> np.ndarray:
    """Hash of all words of some documents."""
    sums = running(mix(words.hash))
    return span_hash(sums, words.first[docs], words.first[docs + 1])


def _asker(size: int, buckets: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Shingles(opened(batch, row, lower_case=True), size)
                order, cuts, keys = s.dealt(buckets)
                own = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                parts = [order[cuts[k] : cuts[k + 1]] for k in own]
                steps = [np.diff(keys[p], prepend=0).astype(np.uint32) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int32()),
                        pa.array([batch.column("chunk")[row].as_py()] * len(own), pa.int64()),
                        pa.array([pack(x.view(np.uint8).reshape(-1, 4).T) for x in steps], pa.binary()),
                        pa.array([pack(s.times[p].astype(np.uint32).view(np.uint8).reshape(-1, 4).T) for p in parts], pa.binary()),
                    ],
                    ["bucket", "chunk", "keys", "counts"],
                )

    return asked


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _rarity(questions: pa.Table) -> pa.Table:
    """Of each shingle the class of its number of documents: 0 for one document, four classes for each doubling."""
    chunks = questions.column("chunk").to_pylist()
    parts = [np.cumsum(_numbers(b), dtype=np.uint64).astype(np.uint32) for b in questions.column("keys").to_pylist()]
    counts = np.concatenate([_numbers(b) for b in questions.column("counts").to_pylist()])
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(number, weights=counts)
    classes = np.minimum(np.floor(4 * np.log2(total)), 255).astype(np.uint8)[number]
    ends = np.cumsum([len(p) for p in parts])
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "bucket": pa.array([questions.column("bucket")[0].as_py()] * len(chunks), pa.int32()),
            "answer": pa.array([pack(c) for c in np.split(classes, ends[:-1])], pa.binary()),
        }
    )


def _divider(size: int, percent: int, buckets: int):
    """Divides each document's shingles. Documents that meet no other in enough short lists get none."""

    def divided(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s = Shingles(opened(chunk, 0, lower_case=True), size)
        order, _, _ = s.dealt(buckets)
        rarity = np.empty(len(s.distinct), np.uint8)
        rarity[order] = in_order(answers, np.uint8)
        rarity = rarity[s.number]
        by_rarity = np.lexsort((s.hash, rarity, s.doc))
        n = np.diff(s.first)
        needed = -(-n * percent // 100)
        n_short = n - needed + np.minimum(needed, SHARED)
        place = np.arange(len(s.hash)) - s.first[s.doc]
        shared = (place < n_short[s.doc]) & (rarity[by_rarity] > 0)
        meets = np.bincount(s.doc[shared], minlength=len(n))
        asks = (n > 0) & (meets >= np.minimum(needed, SHARED))
        parity = s.parity()
        short, shingles = [], []
        for k in range(len(n)):
            own = slice(s.first[k], s.first[k + 1])
            short.append(s.hash[by_rarity[own][shared[own]]].view(np.int64) if asks[k] else None)
            shingles.append(s.hash[own].tobytes() if asks[k] else None)
        row = row_numbers(chunk.column("chunk")[0].as_py(), len(n))
        return pa.table(
            {
                "doc_id": chunk.column("doc_id").combine_chunks().flatten(),
                "text_key": chunk.column("text_key").combine_chunks().flatten(),
                "n_shingles": n.astype(np.int64),
                "n_alone": np.bincount(s.doc[rarity == 0], minlength=len(n)),
                "set_id": pa.array(s.set_ids(), pa.binary()),
                "row": row,
                "short": pa.array(short, pa.list_(pa.int64())),
                "parity": pa.FixedSizeListArray.from_arrays(pa.array(parity.reshape(-1)), PARITY).cast(pa.list_(pa.int64())),
                "shingles": pa.array(shingles, pa.binary()),
            }
        )

    return divided


def shingle_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, set_id, row, short, shingles for every row; stored."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = chunk_table(own.withColumn("text_key", F.xxhash64("text")), "shingle-chunks", limit=CHUNK)
    buckets = bucket_count(table)
    asked = table.select("chunk", "bounds", "data").mapInArrow(_asker(size, buckets), QUESTION)
    answers = by_bucket(asked, _rarity, "chunk long, bucket int, answer binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(
        answered(table, answers, _divider(size, percent, buckets), f"doc_id {kind}, text_key long, {SETS}"), "shingle-sets"
    )


def _prober(percent: int):
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("a_shingles"), batch.column("b_shingles")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                few, many = (x, y) if len(x) < len(y) else (y, x)
                place = np.searchsorted(many, few)
                overlap = int((many[np.minimum(place, len(many) - 1)] == few).sum())
                linked.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))

    return probed


def _can_link(percent: int) -> Column:
    """Whether sets of n and p_n shingles that meet in a list can be similar.

    n_alone and p_alone of the shingles are in one document only, and stand first in the order of rarity; at is the
    list's place behind them. What is shared stands before it in both sets, or behind it in both. And the shingles that
    only one of the sets has are at least as many as the bits in which their parities differ.
    """
    before, behind = "least(at, p_at)", "least(n - n_alone - at, p_n - p_alone - p_at)"
    differ = " + ".join(f"bit_count(parity[{k}] ^ p_parity[{k}])" for k in range(PARITY))
    return F.expr(
        f"100 * ({before} + {behind}) >= {percent} * (n + p_n - {before} - {behind})"
        f" and {100 + percent} * ({differ}) <= {100 - percent} * (n + p_n)"
    )


def _only(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` with one of the stored, distinct ``ids``; these are sent to the tasks if they are few enough."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) of nodes that are similar. ``sets``: node, n, short, shingles."""
    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    own = _only(sets, asked, "node")
    x, y = (own.select(F.col("node").alias(c), *(F.col(f).alias(f"{c}_{f}") for f in ("n", "short", "shingles"))) for c in ("a", "b"))
    least = F.least(F.lit(SHARED), *(F.ceil(F.col(n) * percent / 100) for n in ("a_n", "b_n")))
    met = pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect("a_short", "b_short")) >= least)
    return met.select("a", "b", "a_shingles", "b_shingles").mapInArrow(_prober(percent), "a long, b long")


def _short_lists(stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``shingle_sets``: set_id and row (its node) of each set; the short lists with several nodes; the sets in them."""
    asking = stored.where("short is not null")
    # one row stands for all documents of a set, and its number for the set
    nodes = materialise(asking.groupBy("set_id").agg(F.min("row").alias("row")), "nodes")
    place = F.xxhash64("row") / F.lit(2.0**64) + 0.5
    lists = _only(asking, nodes.select("row"), "row").select(
        F.posexplode("short").alias("at", "token"), F.col("row").alias("node"), place.alias("place"),
        F.col("n_shingles").alias("n"), "n_alone", "parity",
    )
    lists = materialise(lists, "lists")
    several = lists.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    lists = materialise(lists.join(several.select("token"), "token", "left_semi").withColumn("label", F.col("node")), "lists")
    met = materialise(lists.select(F.col("node").alias("row")).distinct(), "met")
    sets = _only(asking, met, "row").select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "short", "shingles")
    return nodes, lists, materialise(sets, "probed-sets")


def similar_sets(stored: DataFrame, percent: int, more: int = MORE) -> DataFrame:
    """set_id, label: components of the similar sets of ``shingle_sets``; sets without a partner are left out."""
    nodes, lists, sets = _short_lists(stored)
    labels = compared = None
    pivots = 1
    own = ("at", "place", "n", "n_alone", "parity", "label")
    while True:
        # places are even between the first one left and 1, so this part of them holds ``pivots`` members on the average
        cut = F.min("place") + (1 - F.min("place")) * (pivots - 0.5) / F.count(F.lit(1))
        placed = lists.join(lists.groupBy("token").agg(cut.alias("cut")), "token")
        chosen = placed.where("place <= cut").select(
            F.col("token").alias("p_token"), F.col("node").alias("a"),
            *(F.col(c).alias({"n_alone": "p_alone"}.get(c, f"p_{c}")) for c in own),
        )
        meets = F.expr("token = p_token and label <> p_label and (place > p_place or place = p_place and node > a)")
        pairs = lists.join(chosen, meets & _can_link(percent)).select("a", F.col("node").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        compared = pairs if compared is None else compared.unionAll(pairs)
        links = _linked(pairs, sets, percent)
        if labels is not None:
            links = links.unionAll(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(links)
        named = labels.select("node", F.col("label").alias("of"))
        rest = placed.where("place > cut").drop("cut").join(named, "node", "left")
        rest = materialise(rest.withColumn("label", F.coalesce("of", "node")).drop("of"), "lists")
        mixed = rest.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        lists = materialise(rest.join(mixed.select("token"), "token", "left_semi"), "lists")
        if lists.isEmpty():
            return labels.join(nodes, F.col("node") == F.col("row")).select("set_id", "label")
        pivots *= more


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, is_first for every row of ``docs``.

    A document's set: its distinct shingles of ``size`` words without blanks, A-Z lower-cased; with fewer words all of
    them are one shingle. Two documents are linked if 100 times the shingles they share are at least ``percent`` times
    those of either; component_id is the smallest doc_id that links lead to, the own one included. text_key is the hash
    of the text. is_first: the row is kept when one row of each component is; it has the smallest doc_id, then text_key.
    Null and empty texts have no shingles and are linked with nothing, equal ones neither. A null doc_id comes last; a
    component without ids has none. Repeated rows are linked; other columns are not looked at; an empty table gives no
    rows.
    """
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent must lie in 1 to 100, size must be positive")
    with scope(docs.sparkSession):
        stored = shingle_sets(docs, size, percent)
        labels = similar_sets(stored, percent)
        alone = F.col("n_shingles") == 0
        own = stored.select("doc_id", "text_key", "n_shingles", "set_id", "row").join(labels, "set_id", "left")
        key = F.when(alone, F.concat(F.lit("row"), "row")).otherwise(F.coalesce(F.col("label").cast("string"), F.base64("set_id")))
        own = materialise(own.select("doc_id", "text_key", "n_shingles", "row", key.alias("component")), "components", keep=True)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "row")
    firsts = own.groupBy("component").agg(F.min(place).alias("place"))
    joined = own.join(firsts, "component")
    return joined.select(
        "doc_id", "text_key", "n_shingles", F.col("place.doc_id").alias("component_id"),
        (F.col("row") == F.col("place.row")).alias("is_first"),
    )


def similar_pairs(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """a_id, a_key, b_id, b_key, n_links for every linked pair of sets; what ``similar_documents`` links, without components.

    A set is named by the smallest doc_id of its rows, null last, and the hash of that row's text. n_links: pairs of rows
    that the pair of sets stands for; with a = b, of rows with equal sets. So all n_links together are all links, and no
    link is left out; the rows of large groups of near copies grow with the square of the group.
    """
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent must lie in 1 to 100, size must be positive")
    stored = shingle_sets(docs, size, percent)
    nodes, lists, sets = _short_lists(stored)
    own = ("at", "n", "n_alone", "parity")
    others = lists.select(
        F.col("token").alias("p_token"), F.col("node").alias("a"),
        *(F.col(c).alias({"n_alone": "p_alone"}.get(c, f"p_{c}")) for c in own),
    )
    meets = F.expr("token = p_token and node > a")
    pairs = lists.join(others, meets & _can_link(percent)).select("a", F.col("node").alias("b")).distinct()
    links = _linked(materialise(pairs, "pairs"), sets, percent)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    rows = stored.where("n_shingles > 0").groupBy("set_id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    rows = materialise(rows.join(nodes, "set_id", "left"), "set-rows")
    x, y = (rows.select(F.col("row").alias(c), F.col("place").alias(f"{c}_place"), F.col("n").alias(f"{c}_n")) for c in ("a", "b"))
    different = links.join(x, "a").join(y, "b").withColumn("n_links", F.col("a_n") * F.col("b_n"))
    ordered = F.col("a_place") < F.col("b_place")
    first, last = F.when(ordered, F.col("a_place")).otherwise(F.col("b_place")), F.when(ordered, F.col("b_place")).otherwise(F.col("a_place"))
    different = different.select(first.alias("a"), last.alias("b"), "n_links")
    equal = rows.where("n > 1").select(F.col("place").alias("a"), F.col("place").alias("b"), F.expr("n * (n - 1) div 2").alias("n_links"))
    return different.unionAll(equal).select(
        F.col("a.doc_id").alias("a_id"), F.col("a.text_key").alias("a_key"),
        F.col("b.doc_id").alias("b_id"), F.col("b.text_key").alias("b_key"), "n_links",
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of ``similar_documents``; all columns as they are."""
    found = similar_documents(docs, size, percent).groupBy("doc_id", "text_key").agg(
        F.sum(F.col("is_first").cast("long")).alias("kept"), F.count(F.lit(1)).alias("copies")
    )
    found = materialise(found.where("kept > 0").withColumnsRenamed({"doc_id": "kept_id", "text_key": "kept_key"}), "kept")
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    whole = whole.withColumn("key", F.xxhash64(F.col("row.text").cast("string")))
    same = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    single = whole.join(found.where("kept = copies"), same, "left_semi")
    repeated = found.where("kept < copies")
    if not repeated.isEmpty():  # repeated rows: of equal ids and texts one row stays
        again = whole.join(repeated, same, "left_semi").withColumn("doc_id", F.col("row.doc_id"))
        single = single.unionAll(again.dropDuplicates(["doc_id", "key"]).select("row", "key"))
    return single.select("row.*")
